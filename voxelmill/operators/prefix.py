"""Running sums and dense numbering over a whole table without one-task windows.

A window without partitionBy sends every row to one task. Here rows are range
partitioned, each part is summed on its own, and only the totals of the parts
(one row for each partition) pass through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str, inclusive: bool = True) -> DataFrame:
    """df with `out`: the sum of `value` over all rows up to this one in `order`.

    Ties in `order` get distinct sums in an arbitrary order; nulls count as 0.
    inclusive=False leaves this row's own value out. An empty df stays empty.
    """
    kept = df.columns
    parts = cut(
        df.withColumn("__v", F.coalesce(value, F.lit(0)))
        .repartitionByRange(*order)
        .withColumn("__part", F.spark_partition_id())
    )
    totals = parts.groupBy("__part").agg(F.sum("__v").alias("__t"))
    before = totals.select(
        "__part",
        (F.sum("__t").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).alias("__before"),
    )
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("__in", F.sum("__v").over(inside))
    total = F.col("__in") + F.col("__before")
    # one row for each partition: at most spark.sql.shuffle.partitions rows
    joined = local.join(F.broadcast(before), "__part")
    return joined.select(*kept, (total if inclusive else total - F.col("__v")).alias(out))


def dense_index(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with `out`: 0, 1, 2, ... in `order`."""
    return running_sum(df, order, F.lit(1).cast("long"), out, inclusive=False)


def group_index(df: DataFrame, group: str | list[str], order: list[Column], out: str) -> DataFrame:
    """df with `out`: 0, 1, 2, ... in `order` within each group, whatever a group's size."""
    keys = [group] if isinstance(group, str) else group
    placed = cut(dense_index(df, [*map(F.col, keys), *order], "__at"))
    first = placed.groupBy(*keys).agg(F.min("__at").alias("__first"))
    return placed.join(first, keys).select(*df.columns, (F.col("__at") - F.col("__first")).alias(out))


def running_last(df: DataFrame, group: str, order: str, values: dict[str, Column]) -> DataFrame:
    """df with each of `values`, named by its key: the last one that isn't null in
    the row's group up to this row, by `order`; null before the first.

    A group may span parts. Only a part's first and last groups can, so two rows
    for each part carry what is handed on. (group, order) tells rows apart; a
    null group is a group.
    """
    names = {f"__v{i}": name for i, name in enumerate(values)}
    marked = df.withColumns(dict(zip(names, values.values(), strict=True)))
    parts = cut(marked.repartitionByRange(group, order).withColumn("__part", F.spark_partition_id()))
    own = F.struct(group)
    ends = parts.groupBy("__part").agg(F.min(own).alias("__lo"), F.max(own).alias("__hi"))
    # one row for each partition: at most spark.sql.shuffle.partitions rows
    rim = parts.join(F.broadcast(ends), "__part").filter((own == F.col("__lo")) | (own == F.col("__hi")))
    lasts = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in names]
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = rim.groupBy("__part", group).agg(*lasts)
    handed = handed.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), *[F.last(v, ignorenulls=True).over(before).alias(f"{v}_before") for v in names])
    inside = Window.partitionBy("__part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in names})
    met = local.join(F.broadcast(handed), (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return met.select(*df.columns, *[F.coalesce(v, f"{v}_before").alias(name) for v, name in names.items()])
