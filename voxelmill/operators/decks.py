"""Keyword decks: text tables of `*Keyword, a=b` headers and comma-separated data lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import group_index


def normalised(text: Column) -> Column:
    """Lower-case lines, trimmed, blank ones out, runs of blanks one, none about commas."""
    lines = F.transform(F.split(F.regexp_replace(F.lower(text), "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), "[ \t]+", " "), " ?, ?", ","))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tokens(line: Column) -> Column:
    """What stands between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")


def keyword(line: Column) -> Column:
    """The keyword of a header line in lower case; null for other lines."""
    return F.when(line.startswith("*") & ~line.startswith("**"), F.lower(F.trim(F.regexp_extract(line, r"^\*([^,]*)", 1))))


def parameters(line: Column) -> Column:
    """The a=b parameters of a header line, keys in lower case; flags map to ''."""
    parts = F.slice(F.split(line, ","), 2, 1000)
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.when(F.instr(p, "=") > 0, F.trim(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    pairs = F.filter(pairs, lambda e: e["k"] != "")
    return F.map_from_arrays(F.transform(pairs, lambda e: e["k"]), F.transform(pairs, lambda e: e["v"]))


def sections(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> DataFrame:
    """Data lines with their header's keyword and number: the last header before
    them in their deck. Comments and blank lines go."""
    w = Window.partitionBy(deck).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    key = keyword(F.trim(F.col(text)))
    marked = lines.withColumn("keyword", F.last(key, ignorenulls=True).over(w)).withColumn("section", F.sum(key.isNotNull().cast("int")).over(w))
    body = F.trim(F.col(text))
    return marked.filter((body != "") & ~body.startswith("*")).select(deck, n, "section", "keyword", tokens(F.col(text)).alias("tokens"))


def comma_block(ids: DataFrame, group: str, id: str, per_line: int = 10) -> DataFrame:
    """Lines of per_line ids, seven wide, in order of id: group, line_no, line."""
    placed = group_index(ids.select(group, id), group, [F.col(id)], "__i")
    t = placed.withColumn("line_no", F.floor(F.col("__i") / per_line).cast("int"))
    cells = F.transform(F.array_sort(F.collect_list(id)), lambda v: F.format_string("%7d,", v))
    return t.groupBy(group, "line_no").agg(F.array_join(cells, "\t").alias("line"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def materials(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> DataFrame:
    """(deck, material, density, modulus, ratio): the data lines below *Density
    and *Elastic, of the last *Material before them in their deck."""
    w = Window.partitionBy(deck).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    line = F.trim(F.col(text))
    key = keyword(line)
    name = F.when(key == "material", F.element_at(parameters(line), "name"))
    marked = lines.withColumn("material", F.last(name, ignorenulls=True).over(w)).withColumn("keyword", F.last(key, ignorenulls=True).over(w))
    values = tokens(F.col(text))
    rows = marked.filter((line != "") & ~line.startswith("*") & F.col("material").isNotNull() & F.col("keyword").isin("density", "elastic"))
    number = lambda i: F.get(values, F.lit(i)).cast("double")
    rows = rows.select(deck, "material", "keyword", F.col(n).alias("n"), number(0).alias("a"), number(1).alias("b"))
    first = lambda k, v: F.min(F.when(F.col("keyword") == k, F.struct("n", v)))[v]
    return rows.groupBy(deck, "material").agg(first("density", "a").alias("density"), first("elastic", "a").alias("modulus"), first("elastic", "b").alias("ratio"))


def solid_sections(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> DataFrame:
    """(deck, n, elset, material), upper case, of *Solid Section headers."""
    line = F.trim(F.col(text))
    p = parameters(line)
    found = lines.filter(keyword(line) == "solid section")
    return found.select(deck, n, F.upper(F.element_at(p, "elset")).alias("elset"), F.upper(F.element_at(p, "material")).alias("material"))


def load_rows(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> DataFrame:
    """(deck, n, target, dof, magnitude) of the data lines below *Cload."""
    rows = sections(lines, deck, n, text).filter("keyword = 'cload' AND size(tokens) >= 3")
    return rows.select(deck, n, F.col("tokens")[0].alias("target"), F.col("tokens")[1].cast("int").alias("dof"), F.col("tokens")[2].cast("double").alias("magnitude"))


def bucket_of(material: Column) -> Column:
    """The number behind the last underscore of a material's name."""
    return F.substring_index(material, "_", -1).cast("int")
