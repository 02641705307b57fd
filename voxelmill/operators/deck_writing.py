"""Writing keyword decks: line tables (deck, part, n, sub, line) in order of part, n, sub.

A deck is a union of blocks; nothing is concatenated in one row or one task. A
block's n numbers its rows, sub the lines of a row. write_lines sorts by range
and writes text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .prefix import group_index

LINES = ["deck", "part", "n", "sub", "line"]


@F.pandas_udf(StringType())
def number_text(values: pd.Series) -> pd.Series:
    """An integer if the number is one, else up to 15 significant digits of its
    exact value (the JVM's formatting rounds the shortest text instead)."""
    return pd.Series([None if pd.isna(v) else str(int(v)) if float(v).is_integer() else f"{v:.15g}" for v in values])


def whole_number(value: Column, label: str) -> Column:
    """value as a long; an error names `label` where it isn't a whole number."""
    v = value.cast("double")
    return F.when(v == F.floor(v), v.cast("long")).otherwise(F.raise_error(F.lit(f"{label} contains non-integer values.")).cast("long"))


def millimetres(coordinate: Column, size: float | Column = 0.6) -> Column:
    """One-based voxel coordinates as lengths."""
    return (coordinate.cast("double") - 1.0) * size


def voxel_size(volume: Column) -> Column:
    return F.cbrt(volume.cast("double"))


def _lines(df: DataFrame, part: int, n: Column, line: Column, sub: Column | None = None) -> DataFrame:
    return df.select("deck", F.lit(part).alias("part"), n.cast("long").alias("n"), (F.lit(0) if sub is None else sub).cast("int").alias("sub"), line.alias("line"))


def text_block(decks: DataFrame, part: int, *lines: str | Column) -> DataFrame:
    """The same lines for each deck of decks (deck, others)."""
    made = F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    return decks.select("deck", F.posexplode(made).alias("n", "line")).select("deck", F.lit(part).alias("part"), F.col("n").cast("long").alias("n"), F.lit(0).alias("sub"), "line")


def node_block(nodes: DataFrame, part: int, id: str, coordinates: tuple[str, str, str], size: float | None = None) -> DataFrame:
    """*Node and a row for each node of (deck, id, coordinates) in order of id,
    numbered from 1; with `size`, one-based voxel coordinates become lengths."""
    if size is not None and size <= 0:
        raise ValueError("the voxel size must be positive")
    value = (lambda c: F.col(c)) if size is None else (lambda c: millimetres(F.col(c), size))
    rows = group_index(nodes, "deck", [F.col(id)], "__i")
    line = F.concat_ws(",", (F.col("__i") + 1).cast("string"), *[number_text(value(c).cast("double")) for c in coordinates])
    return text_block(nodes.select("deck").distinct(), part, "*Node").withColumn("n", F.lit(-1).cast("long")).union(_lines(rows, part, F.col("__i"), line))


def element_block(elements: DataFrame, part: int, id: str, corners: str, kind: str = "C3D8R") -> DataFrame:
    """*Element and a row for each element of (deck, id, corners: array of 8)."""
    rows = group_index(elements, "deck", [F.col(id)], "__i")
    ids = F.transform(corners, lambda v: whole_number(v, corners).cast("string"))
    eight = F.when(F.size(corners) == 8, F.array_join(ids, ",")).otherwise(F.raise_error(F.lit("each element has 8 nodes")).cast("string"))
    line = F.concat_ws(",", (F.col("__i") + 1).cast("string"), eight)
    head = text_block(elements.select("deck").distinct(), part, f"*Element, type={kind}").withColumn("n", F.lit(-1).cast("long"))
    return head.union(_lines(rows, part, F.col("__i"), line))


def set_blocks(names: DataFrame, members: DataFrame, part: int, per_line: int = 10, blank: bool = False) -> DataFrame:
    """*Elset blocks: names (deck, set_no, name), members (deck, set_no, id).
    A block is its header, then rows of per_line ids in order, seven wide and
    parted by tabs; a set without members is a header alone. blank: an empty
    line follows each block."""
    most = 1 << 40
    head = _lines(names, part, F.col("set_no") * most, F.concat(F.lit("*Elset,elset="), "name"))
    placed = group_index(members.select("deck", "set_no", "id"), ["deck", "set_no"], [F.col("id")], "__i")
    rows = placed.groupBy("deck", "set_no", F.floor(F.col("__i") / per_line).alias("row")).agg(F.array_sort(F.collect_list(whole_number(F.col("id"), "set"))).alias("ids"))
    line = F.array_join(F.transform("ids", lambda v: F.format_string("%7d,", v)), "\t")
    out = head.union(_lines(rows, part, F.col("set_no") * most + F.col("row") + 1, line))
    return out.union(_lines(names, part, F.col("set_no") * most + (most - 1), F.lit(""))) if blank else out


def generated_set(decks: DataFrame, part: int, keyword: str, name: str, start: Column, stop: Column, step: int = 1) -> DataFrame:
    """A set given by a range, as two lines."""
    rule = F.concat_ws(",", start.cast("string"), stop.cast("string"), F.lit(str(step)))
    return text_block(decks, part, f"*{keyword}, {keyword.lower()}={name}, generate", rule)


def load_block(forces: DataFrame, part: int, node: str = "node_id", values: tuple[str, str, str] = ("fx", "fy", "fz"), instance: str = "VERT-1") -> DataFrame:
    """Five lines for each node with a force that isn't zero, in order of node."""
    some = forces.filter(" OR ".join(f"{v} <> 0" for v in values))
    rows = group_index(some, "deck", [F.col(node)], "__i")
    at = F.concat(F.lit(f"{instance}."), F.col(node).cast("string"))
    title = F.concat(F.lit("** Name: CFORCE-"), (F.col("__i") + 1).cast("string"), F.lit("Type: Concentrated force"))
    own = [F.concat(at, F.lit(f", {d + 1}, "), number_text(F.col(v).cast("double"))) for d, v in enumerate(values)]
    made = rows.select("deck", "__i", F.posexplode(F.array(title, F.lit("*Cload, op=NEW"), *own)).alias("sub", "line"))
    return made.select("deck", F.lit(part).alias("part"), F.col("__i").alias("n"), F.col("sub").cast("int").alias("sub"), "line")


def model_lines(decks: DataFrame, nodes: DataFrame, elements: DataFrame, names: DataFrame, members: DataFrame, head: tuple[str, ...]) -> DataFrame:
    """The model's own part of a deck: given head lines, nodes, elements, the two
    generated sets of all of them, and named element sets."""
    counts = nodes.groupBy("deck").agg(F.count("*").alias("n_nodes")).join(elements.groupBy("deck").agg(F.count("*").alias("n_elements")), "deck", "full")
    counts = decks.select("deck").join(counts, "deck", "left").na.fill(0)
    parts = [
        text_block(decks, 0, *head, ""),
        node_block(nodes, 1, "node_id", ("x", "y", "z")),
        element_block(elements, 2, "element_id", "corners"),
        generated_set(counts, 3, "Nset", "alln", F.lit(1), F.col("n_nodes")),
        text_block(counts, 4, "*Elset, elset=alle, generate", F.concat(F.lit("1,"), F.col("n_elements").cast("string"), F.lit(",1"))),
        set_blocks(names, members, 5),
    ]
    return _union(parts)


def with_buckets(model: DataFrame, names: DataFrame, members: DataFrame, part: int) -> DataFrame:
    """model, an empty line, and a further run of element sets with empty lines between."""
    gap = text_block(model.select("deck").distinct(), part, "")
    return _union([model, gap, set_blocks(names, members, part + 1, blank=True)])


def with_step(model: DataFrame, decks: DataFrame, lines: tuple[str, ...], part: int) -> DataFrame:
    """model and a step's own lines behind it."""
    return _union([model, text_block(decks, part, *lines)])


def with_loads(model: DataFrame, decks: DataFrame, prefix: tuple[str, ...], forces: DataFrame, suffix: tuple[str, ...], part: int) -> DataFrame:
    """model, prefix lines, the loads of its nodes, an empty line, suffix lines."""
    return _union([model, text_block(decks, part, *prefix), load_block(forces, part + 1), text_block(decks, part + 2, "", *suffix)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select(*LINES)
    for p in parts[1:]:
        out = out.union(p.select(*LINES))
    return out


def write_lines(lines: DataFrame, path: str, newline: str = "\r\n") -> None:
    """The lines of each deck as text files below deck=..., whose order of names
    is the order of the lines; lines end with `newline`."""
    rows = lines.repartitionByRange("deck", "part", "n", "sub").sortWithinPartitions("deck", "part", "n", "sub")
    rows.select("deck", "line").write.partitionBy("deck").option("lineSep", newline).text(path)
