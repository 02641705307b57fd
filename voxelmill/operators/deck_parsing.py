"""What keyword decks say: assembly, boundaries, steps, and whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .decks import keyword, load_rows, materials, parameters, solid_sections, tokens
from .prefix import running_last


def headed(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> DataFrame:
    """Each line with its last header: deck, n, line, keyword, header, at (the
    header's number), is_header, inside (whether it stands in *Assembly)."""
    line = F.trim(F.col(text))
    marked = lines.select(F.col(deck).alias("deck"), F.col(n).alias("n"), line.alias("line"), keyword(line).alias("__key"))
    key = F.col("__key")
    head = F.when(key.isNotNull(), F.struct(key.alias("keyword"), F.col("line").alias("header"), F.col("n").alias("at")))
    gate = F.when(key == "assembly", True).when(key == "end assembly", False)
    found = running_last(marked, "deck", "n", {"__head": head, "__gate": gate})
    # several tables are made from these rows, and no cast may be moved before the test of its header
    return cut(found.select("deck", "n", "line", "__head.*", key.isNotNull().alias("is_header"), F.coalesce("__gate", F.lit(False)).alias("inside")))


def _data(marked: DataFrame, key: str) -> DataFrame:
    body = marked.filter(~F.col("is_header") & (F.col("keyword") == key) & (F.col("line") != "") & ~F.col("line").startswith("*"))
    return body.withColumn("t", tokens(F.col("line")))


def _parameter(name: str) -> Column:
    return F.upper(F.coalesce(F.element_at(parameters(F.col("header")), name), F.lit("")))


def assembly(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> dict[str, DataFrame]:
    """Inside *Assembly: reference_nodes (deck, node_id, x, y, z), node_sets
    (deck, name, n, member), surfaces (deck, name, type, source: its first data
    line) and couplings (deck, name, reference_node_set, surface)."""
    marked = headed(lines, deck, n, text).filter("inside")
    number = lambda i: F.get(F.col("t"), F.lit(i)).cast("double")
    nodes = _data(marked, "node").filter(F.size("t") >= 4)
    sets = _data(marked, "nset").select("deck", _parameter("nset").alias("name"), "n", "t").select("deck", "name", "n", F.explode("t").alias("v"))
    surface = marked.filter("keyword = 'surface'").groupBy("deck", "at", "header").agg(
        F.min(F.when(~F.col("is_header") & (F.col("line") != "") & ~F.col("line").startswith("*"), F.struct("n", "line"))).alias("first")
    )
    coupling = marked.filter("is_header AND keyword = 'coupling'")
    return {
        "reference_nodes": nodes.select("deck", number(0).cast("long").alias("node_id"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z")),
        "node_sets": sets.select("deck", "name", "n", F.col("v").cast("double").cast("long").alias("member")),
        "surfaces": surface.select("deck", "at", _parameter("name").alias("name"), _parameter("type").alias("type"), F.upper(F.coalesce(F.col("first.line"), F.lit(""))).alias("source")),
        "couplings": coupling.select("deck", "at", _parameter("constraint name").alias("name"), _parameter("ref node").alias("reference_node_set"), _parameter("surface").alias("surface")),
    }


def boundaries(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> DataFrame:
    """(deck, n, target, constraint, dof_start, dof_end, value) of the data lines
    below *Boundary: two tokens name a constraint, more give a range of dofs."""
    rows = _data(headed(lines, deck, n, text), "boundary").filter(F.size("t") >= 2)
    t = lambda i: F.get(F.col("t"), F.lit(i))
    named = F.size("t") == 2
    return rows.select(
        "deck", "n", F.upper(t(0)).alias("target"), F.when(named, F.upper(t(1))).alias("constraint"),
        F.when(~named, t(1).cast("double").cast("int")).alias("dof_start"), F.when(~named, t(2).cast("double").cast("int")).alias("dof_end"), F.when(~named, t(3).cast("double")).alias("value"),
    )


def first_steps(lines: DataFrame, deck: str = "deck", n: str = "n", text: str = "line") -> DataFrame:
    """(deck, name, nlgeom, solver, numbers) of each deck's first *Step and the
    first data line of the next *Static; numbers are empty without one."""
    marked = headed(lines, deck, n, text)
    step = marked.filter("is_header AND keyword = 'step'").groupBy("deck").agg(F.min(F.struct("n", "header")).alias("s")).select("deck", F.col("s.n").alias("from"), F.col("s.header").alias("header"))
    static = marked.filter("is_header AND keyword = 'static'").select("deck", "n").join(step.select("deck", "from"), "deck").filter(F.col("n") > F.col("from"))
    static = static.groupBy("deck").agg(F.min("n").alias("static_at"))
    data = _data(marked, "static").select("deck", "n", "at", "t").join(static, "deck").filter("at = static_at").groupBy("deck").agg(F.min(F.struct("n", "t"))["t"].alias("t"))
    plain = F.coalesce(F.element_at(parameters(F.col("header")), "name"), F.lit(""))
    out = step.join(data, "deck", "left")
    numbers = F.coalesce(F.transform("t", lambda v: v.cast("double")), F.array().cast("array<double>"))
    return out.select("deck", plain.alias("name"), _parameter("nlgeom").alias("nlgeom"), _parameter("solver").alias("solver"), numbers.alias("numbers"))


def bucket_catalog(found: DataFrame, prefix: str, low: int, high: int) -> DataFrame:
    """found (deck, material, density, modulus, ratio) of a family prefix_low to
    prefix_high: deck, bucket and the rest; a missing bucket has nulls."""
    rows = found.filter(F.upper("material").rlike(f"^{prefix.upper()}_[0-9]+$")).withColumn("bucket", F.substring_index("material", "_", -1).cast("int"))
    all_ = found.select("deck").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return all_.join(rows, ["deck", "bucket"], "left")


def inventory(lines: DataFrame) -> DataFrame:
    """(deck, n_lines, n_headers, n_keywords, n_materials, n_loads, n_boundaries):
    counts of what each deck holds; lines: deck, n, line."""
    marked = headed(lines)
    own = marked.groupBy("deck").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("is_header").cast("long")).alias("n_headers"), F.count_distinct(F.when(F.col("is_header"), F.col("keyword"))).alias("n_keywords")
    )
    count = lambda df, name: df.groupBy("deck").agg(F.count("*").alias(name))
    for df, name in ((materials(lines), "n_materials"), (load_rows(lines), "n_loads"), (boundaries(lines), "n_boundaries")):
        own = own.join(count(df, name), "deck", "left")
    return own.na.fill(0)


def documents(lines: DataFrame) -> DataFrame:
    """(deck, document): what each deck says, as one JSON text: its materials,
    sections, step and boundaries, each in order. A deck's headers are as many as
    its author wrote, so they meet in one row; its meshes do not."""
    m = materials(lines).groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("material", "density", "modulus", "ratio"))).alias("materials"))
    s = solid_sections(lines).groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("elset", "material"))).alias("sections"))
    b = boundaries(lines).groupBy("deck").agg(F.array_sort(F.collect_list(F.struct("n", "target", "constraint", "dof_start", "dof_end", "value"))).alias("boundaries"))
    step = first_steps(lines).select("deck", F.struct("name", "nlgeom", "solver", "numbers").alias("step"))
    out = lines.select("deck").distinct()
    for df in (m, s, b, step):
        out = out.join(df, "deck", "left")
    return out.select("deck", F.to_json(F.struct("materials", "sections", "boundaries", "step")).alias("document"))
