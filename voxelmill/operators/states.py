"""A run's state from its dimension tables: precedence of sources, scatter into grids, cases and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_precedence(sources: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """(key, value, source_no): for each key of any source the value of the
    first source that has one that isn't null."""
    tagged = None
    for n, df in enumerate(sources):
        part = df.filter(F.col(value).isNotNull()).select(*key, F.col(value).alias(value), F.lit(n).alias("source_no"))
        tagged = part if tagged is None else tagged.union(part)
    best = tagged.groupBy(*key).agg(F.min(F.struct("source_no", value)).alias("b"))
    return best.select(*key, F.col(f"b.{value}").alias(value), F.col("b.source_no").alias("source_no"))


def scatter(grid: DataFrame, updates: DataFrame, at: list[str], value: str) -> DataFrame:
    """grid (at, value) with the values of updates (at, value) where they have one."""
    new = updates.select(*at, F.col(value).alias("__new"))
    return grid.join(new, at, "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def grid_shape(nodes: DataFrame, group: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(group, n_<axis>...): voxels along each axis of one-based node coordinates;
    a coordinate below 1 is an error."""
    low = [F.min(a) for a in axes]
    count = [F.when(lo >= 1, F.max(a) - 1).otherwise(F.raise_error(F.lit("node coordinates begin at 1")).cast("long")).alias(f"n_{a}") for lo, a in zip(low, axes, strict=True)]
    return nodes.groupBy(*group).agg(*count)


def anchors(elements: DataFrame, nodes: DataFrame, group: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """(group, element_id, axes): the voxel of each element (group, element_id,
    first_node), that of its first node (group, node_id, axes), from 0. An
    element whose node is missing is an error."""
    at = nodes.select(*group, F.col("node_id").alias("first_node"), *[F.col(a).alias(f"__{a}") for a in axes])
    t = elements.join(at, [*group, "first_node"], "left")
    known = F.col(f"__{axes[0]}").isNotNull()
    return t.select(*group, "element_id", *[F.when(known, F.col(f"__{a}") - 1).otherwise(F.raise_error(F.lit("an element's node is missing")).cast("long")).alias(a) for a in axes])


def numbered_cases(cases: DataFrame, name: str = "name") -> DataFrame:
    """cases with case_no: the number behind the name's last underscore, by which they stand."""
    return cases.withColumn("case_no", F.substring_index(name, "_", -1).cast("int"))


def case_values(cases: DataFrame, own: DataFrame, shared: DataFrame, key: list[str]) -> DataFrame:
    """(case, key, value, is_own): each case's own values (case, key, value), or,
    for a case that has none at all, the shared ones (key, value)."""
    has = own.select("case").distinct()
    mine = own.join(cases, "case", "left_semi").select("case", *key, "value", F.lit(True).alias("is_own"))
    # cases are few: those without values of their own come to each shared row as a list, a scalar of the plan
    rest = cases.join(has, "case", "left_anti").agg(F.array_sort(F.collect_list("case")).alias("c")).scalar()
    common = shared.withColumn("case", F.explode(rest))
    return mine.union(common.select("case", *key, "value", F.lit(False).alias("is_own")))


def key_mismatches(own: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """(key, status): keys on one side only, as `missing` or `unknown`."""
    a, b = own.select(*key).distinct().withColumn("__a", F.lit(1)), wanted.select(*key).distinct().withColumn("__b", F.lit(1))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__b").isNull(), "unknown")
    return a.join(b, key, "full").withColumn("status", status).filter("status IS NOT NULL").select(*key, "status")


def case_records(histories: DataFrame, cases: DataFrame, reservations: DataFrame, fallback: float) -> DataFrame:
    """(case, step, value, force, reserved): histories (case, step, value) with
    their case (case, force) and its reservation (case, reserved), if there is one."""
    t = histories.join(cases, "case").join(reservations, "case", "left")
    return t.select("case", "step", "value", "force", F.coalesce("reserved", F.lit(fallback)).alias("reserved"))


def step_counts(histories: DataFrame, expected: DataFrame) -> DataFrame:
    """(case, n_steps, expected, status): steps found for each expected case."""
    n = histories.groupBy("case").agg(F.count_distinct("step").alias("n_steps"))
    t = expected.join(n, "case", "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0)))
    status = F.when(F.col("n_steps") == 0, "missing").when(F.col("n_steps") != F.col("expected"), "fail").otherwise("pass")
    return t.select("case", "n_steps", "expected", status.alias("status"))


def payload_status(text: Column) -> Column:
    """What a JSON text is: missing, invalid, not_object or readable."""
    body = F.trim(text)
    valid = F.try_parse_json(body).isNotNull()
    return F.when(text.isNull(), "missing").when(~valid, "invalid").when(~body.startswith("{"), "not_object").otherwise("readable")


def initial_state(elements: DataFrame, constant: float, buckets: int) -> DataFrame:
    """elements (element_id, design: whether it is designed, value) with density
    (its own value if designed, else the constant), bucket and milli."""
    t = elements.withColumn("density", F.when(F.col("design"), F.greatest(F.least("value", F.lit(1.0)), F.lit(0.0))).otherwise(F.lit(constant)))
    return t.withColumns({"bucket": F.rint(F.col("density") * buckets).cast("int"), "milli": F.rint(F.col("density") * 1000).cast("int")})


def canonical_planes(planes: DataFrame, axes: tuple[str, ...] = ("nx", "ny", "nz"), rhs: str = "rhs", least: float = 1e-12) -> DataFrame:
    """planes with their equation over the normal's length, turned so that the
    first component that isn't zero is positive; planes without a normal go."""
    n = F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))
    t = planes.withColumn("__n", n).filter(F.col("__n") > least)
    unit = {a: F.try_divide(F.col(a), F.col("__n")) for a in (*axes, rhs)}
    t = t.withColumns(unit)
    sign = F.coalesce(*[F.when(F.abs(a) > least, F.signum(a)) for a in axes])
    return t.withColumn("__s", sign).withColumns({a: F.col(a) * F.col("__s") for a in (*axes, rhs)}).drop("__n", "__s")


def mirrored(seeds: DataFrame, low: float, high: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """seeds with copy: 0 for themselves, 1 to 6 for their images in a box's sides."""
    out = seeds.withColumn("copy", F.lit(0))
    n = 0
    for a in axes:
        for side in (low, high):
            n += 1
            out = out.union(seeds.withColumn(a, 2 * side - F.col(a)).withColumn("copy", F.lit(n)))
    return out


def snapped(points: DataFrame, key: list[Column], order: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """points with the axes of the first point, by `order`, that shares their key."""
    named = points.withColumns({f"__k{i}": k for i, k in enumerate(key)})
    keys = [f"__k{i}" for i in range(len(key))]
    first = named.groupBy(*keys).agg(F.min_by(F.struct(*axes), F.struct(*order)).alias("__p"))
    return named.drop(*axes).join(first, keys).select(*[c for c in points.columns if c not in axes], *[F.col(f"__p.{a}").alias(a) for a in axes])
