"""Queries that write keyword decks from the tables, and read decks back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deck_parsing, deck_writing
from ..session import cut
from .tables import table

QUERIES, ORACLE_SQL = {}, {}
HEAD = ("*Heading", "** model")
STEP = ("*Step, name=Load, nlgeom=NO", "*Static", "1., 1., 1e-05, 1.", "*End Step")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nodes of their nation's deck."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("deck"), k.alias("node_id"), (k % 97 + 1).alias("i"), (k % 41 + 1).alias("j"), (k % 13 + 1).alias("l"), F.col("c_acctbal").cast("double").alias("w"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as elements of 8 nodes."""
    k = F.col("o_custkey")
    corners = F.array(*[k + d for d in range(8)])
    return table(spark, sf_dir, "orders").select((k % 25).alias("deck"), F.col("o_orderkey").alias("element_id"), corners.alias("corners"))


def _buckets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts in sets by price; some sets are empty."""
    p = table(spark, sf_dir, "part")
    members = p.select((F.col("p_partkey") % 25).alias("deck"), F.floor(F.col("p_size") / 6).cast("int").alias("set_no"), F.col("p_partkey").alias("id"))
    return _names(spark, "desi_ele", 11), members


def _names(spark: SparkSession, prefix: str, count: int) -> DataFrame:
    return spark.range(25).select(F.col("id").alias("deck"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("set_no")).withColumn("name", F.concat(F.lit(prefix), F.col("set_no").cast("string")))


_NODES = "nod AS (SELECT c_nationkey::BIGINT AS deck, c_custkey AS node_id, c_custkey % 97 + 1 AS i, c_custkey % 41 + 1 AS j, c_custkey % 13 + 1 AS l, c_acctbal::DOUBLE AS w FROM customer)"
_ELEMENTS = "ele AS (SELECT o_custkey % 25 AS deck, o_orderkey AS element_id, o_custkey AS c FROM orders)"
_MEMBERS = "mem AS (SELECT p_partkey % 25 AS deck, p_size // 6 AS set_no, p_partkey AS id FROM part)"
_DECKS = "dk AS (SELECT unnest(range(25)) AS deck)"


def _num(x: str) -> str:
    return f"CASE WHEN ({x}) = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE printf('%.15g', ({x})::DOUBLE) END"


def _node_lines(part: int, xyz: tuple[str, str, str]) -> str:
    row = f"(row_number() OVER (PARTITION BY deck ORDER BY node_id))::VARCHAR || ',' || {_num(xyz[0])} || ',' || {_num(xyz[1])} || ',' || {_num(xyz[2])}"
    return f"SELECT DISTINCT deck, {part} AS part, -1 AS n, 0 AS sub, '*Node' AS line FROM nod UNION ALL SELECT deck, {part}, row_number() OVER (PARTITION BY deck ORDER BY node_id) - 1, 0, {row} FROM nod"


def _element_lines(part: int) -> str:
    ids = " || ',' || ".join(f"(c + {d})::VARCHAR" for d in range(8))
    n = "row_number() OVER (PARTITION BY deck ORDER BY element_id)"
    return f"SELECT DISTINCT deck, {part} AS part, -1 AS n, 0 AS sub, '*Element, type=C3D8R' AS line FROM ele UNION ALL SELECT deck, {part}, {n} - 1, 0, ({n})::VARCHAR || ',' || {ids} FROM ele"


def _set_lines(part: int, prefix: str, count: int, blank: bool) -> str:
    most = 1 << 40
    tail = f" UNION ALL SELECT deck, {part}, k * {most} + {most - 1}, 0, '' FROM dk, (SELECT unnest(range({count})) AS k)" if blank else ""
    return f"""SELECT deck, {part} AS part, k * {most} AS n, 0 AS sub, '*Elset,elset={prefix}' || k AS line FROM dk, (SELECT unnest(range({count})) AS k)
UNION ALL SELECT deck, {part}, set_no * {most} + r + 1, 0, string_agg(printf('%7d,', id), chr(9) ORDER BY id) FROM (SELECT *, (row_number() OVER (PARTITION BY deck, set_no ORDER BY id) - 1) // 10 AS r FROM mem WHERE set_no < {count}) GROUP BY deck, set_no, r{tail}"""


_LOADS = """SELECT deck, {part} AS part, r AS n, sub, CASE sub WHEN 0 THEN '** Name: CFORCE-' || (r + 1) || 'Type: Concentrated force' WHEN 1 THEN '*Cload, op=NEW'
  ELSE 'VERT-1.' || node_id || ', ' || (sub - 1) || ', ' || CASE sub WHEN 2 THEN {x} WHEN 3 THEN {y} ELSE '0' END END AS line
FROM (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY node_id) - 1 AS r FROM nod WHERE w < 0), (SELECT unnest(range(5)) AS sub)""".replace("{x}", _num("w")).replace("{y}", _num("w / 7"))


@query(f"WITH {_NODES} {_node_lines(0, ('(i - 1.0::DOUBLE) * 0.6::DOUBLE', '(j - 1.0::DOUBLE) * 0.6::DOUBLE', '(l - 1.0::DOUBLE) * 0.6::DOUBLE'))}")
def deck_node_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_writing.node_block(_nodes(spark, sf_dir), 0, "node_id", ("i", "j", "l"), size=0.6)


@query(f"WITH {_ELEMENTS} {_element_lines(0)}")
def deck_element_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_writing.element_block(_elements(spark, sf_dir), 0, "element_id", "corners")


@query(f"WITH {_DECKS}, {_MEMBERS} {_set_lines(0, 'desi_ele', 11, False)}")
def deck_set_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_writing.set_blocks(*_buckets(spark, sf_dir), 0)


def _forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).filter("w < 0").select("deck", "node_id", F.col("w").alias("fx"), (F.col("w") / 7).alias("fy"), F.lit(0.0).alias("fz"))


@query(f"WITH {_NODES} {_LOADS.format(part=0)}")
def deck_load_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_writing.load_block(_forces(spark, sf_dir), 0)


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    decks = spark.range(25).select(F.col("id").alias("deck"))
    nodes = _nodes(spark, sf_dir).select("deck", "node_id", F.col("i").alias("x"), F.col("j").alias("y"), (F.col("l") * 0.5).alias("z"))
    names, members = _buckets(spark, sf_dir)
    model = deck_writing.model_lines(decks, nodes, _elements(spark, sf_dir), _names(spark, "NODESI_ELE_", 2), members.filter("set_no < 2"), HEAD)
    return decks, deck_writing.with_buckets(model, names, members, 6)


def _text(part: int, lines: tuple[str, ...]) -> str:
    rows = ",".join(f"({k}, '{x}')" for k, x in enumerate(lines))
    return f"SELECT deck, {part} AS part, n, 0 AS sub, line FROM dk, (VALUES {rows}) v(n, line)"


_COUNTS = "cnt AS (SELECT deck, (SELECT count(*) FROM nod WHERE nod.deck = dk.deck) AS nn, (SELECT count(*) FROM ele WHERE ele.deck = dk.deck) AS ne FROM dk)"
_MODEL = f"""{_DECKS}, {_NODES}, {_ELEMENTS}, {_MEMBERS}, {_COUNTS}, lns AS (
{_text(0, (*HEAD, ''))} UNION ALL SELECT * FROM ({_node_lines(1, ('i', 'j', 'l * 0.5::DOUBLE'))}) UNION ALL SELECT * FROM ({_element_lines(2)})
UNION ALL SELECT deck, 3, 0, 0, '*Nset, nset=alln, generate' FROM dk UNION ALL SELECT deck, 3, 1, 0, '1,' || nn || ',1' FROM cnt
UNION ALL SELECT deck, 4, 0, 0, '*Elset, elset=alle, generate' FROM dk UNION ALL SELECT deck, 4, 1, 0, '1,' || ne || ',1' FROM cnt
UNION ALL SELECT * FROM ({_set_lines(5, 'NODESI_ELE_', 2, False)}) UNION ALL SELECT deck, 6, 0, 0, '' FROM dk UNION ALL SELECT * FROM ({_set_lines(7, 'desi_ele', 11, True)})"""


@query(f"WITH {_MODEL} UNION ALL {_text(8, STEP)}) SELECT deck, part, n, sub, line FROM lns")
def deck_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole decks of a forward run: model, sets and step."""
    decks, model = _model(spark, sf_dir)
    return deck_writing.with_step(model, decks, STEP, 8)


@query(f"WITH {_MODEL} UNION ALL {_text(8, STEP[:3])} UNION ALL SELECT * FROM ({_LOADS.format(part=9)}) UNION ALL {_text(10, ('', STEP[3]))}) SELECT deck, part, n, sub, line FROM lns")
def deck_adjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole decks of an adjoint run: model, sets, step, and the loads of nodes."""
    decks, model = _model(spark, sf_dir)
    return deck_writing.with_loads(model, decks, STEP[:3], _forces(spark, sf_dir), STEP[3:], 8)


def _control_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lines of their nation's deck: an assembly around a coupled
    node, set and surface for each supplier, then boundaries and steps."""
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    say: list[Column] = [
        F.lit("*Node"), F.concat(s, F.lit(", "), (k % 7).cast("string"), F.lit(".5, 2., -1e-3")), F.concat(F.lit("*Nset, nset=rp_"), s, F.lit(", internal")),
        F.concat(s, F.lit(", "), (k + 1).cast("string"), F.lit(",")), F.concat(F.lit("*Surface, type=NODE, name=surf_"), s), F.concat(F.lit("side_"), s, F.lit(", 1.")),
        F.concat(F.lit("*Coupling, constraint name=c_"), s, F.lit(", ref node=rp_"), s, F.lit(", surface=surf_"), s), F.lit("*Kinematic"),
    ]
    after: list[Column] = [
        F.lit("*Boundary"), F.concat(F.lit("rp_"), s, F.when(k % 2 == 0, ", encastre").otherwise(", 1, 3, 0.25")), F.concat(F.lit("*Step, name=Load-"), s, F.lit(", nlgeom=no, solver=ITERATIVE")),
        F.lit("** a note"), F.lit("*Static"), F.concat(F.lit("0.1, "), s, F.lit(", 1e-05")), F.lit("*End Step"),
    ]
    t = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("deck"), k.alias("k"), F.array(*say).alias("a"), F.array(*after).alias("b"))
    decks = t.select("deck").distinct()
    row = lambda c, base: t.select("deck", (F.lit(base) + F.col("k") * 10).alias("n"), F.posexplode(c).alias("at", "line")).select("deck", (F.col("n") + F.col("at")).alias("n"), "line")
    edge = lambda n, line: decks.select("deck", F.lit(n).cast("long").alias("n"), F.lit(line).alias("line"))
    return row("a", 0).union(row("b", 1 << 41)).union(edge(-1, "*Assembly, name=Assembly")).union(edge(1 << 40, "*End Assembly"))


@query(
    """SELECT s_nationkey::BIGINT AS deck, s_suppkey AS node_id, s_suppkey % 7 + 0.5::DOUBLE AS x, 2.0::DOUBLE AS y, -0.001::DOUBLE AS z, 2 AS n_members, 'RP_' || s_suppkey AS ref_node,
  'NODE' AS surface_type, 'SIDE_' || s_suppkey || ', 1.' AS source, 'C_' || s_suppkey AS coupling FROM supplier"""
)
def deck_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference nodes, sets, surfaces and couplings, joined by their names."""
    a = {k: v for k, v in deck_parsing.assembly(cut(_control_lines(spark, sf_dir))).items()}
    sets = a["node_sets"].groupBy("deck", F.col("name").alias("reference_node_set")).agg(F.min("member").alias("node_id"), F.count("*").cast("int").alias("n_members"))
    surface = a["surfaces"].select("deck", F.col("name").alias("surface"), F.col("type").alias("surface_type"), "source")
    t = a["couplings"].select("deck", F.col("name").alias("coupling"), "reference_node_set", "surface").join(sets, ["deck", "reference_node_set"]).join(surface, ["deck", "surface"])
    return t.join(a["reference_nodes"], ["deck", "node_id"]).select("deck", "node_id", "x", "y", "z", "n_members", F.col("reference_node_set").alias("ref_node"), "surface_type", "source", "coupling")


@query(
    """SELECT s_nationkey::BIGINT AS deck, 'RP_' || s_suppkey AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'ENCASTRE' END AS "constraint", CASE WHEN s_suppkey % 2 <> 0 THEN 1 END AS dof_start,
  CASE WHEN s_suppkey % 2 <> 0 THEN 3 END AS dof_end, CASE WHEN s_suppkey % 2 <> 0 THEN 0.25::DOUBLE END AS "value" FROM supplier"""
)
def deck_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_parsing.boundaries(_control_lines(spark, sf_dir)).drop("n")


@query(
    """SELECT s_nationkey::BIGINT AS deck, 'Load-' || min(s_suppkey) AS name, 'NO' AS nlgeom, 'ITERATIVE' AS solver, 0.1::DOUBLE AS first_number, min(s_suppkey)::DOUBLE AS second_number, 3 AS n_numbers
FROM supplier GROUP BY s_nationkey"""
)
def deck_first_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = deck_parsing.first_steps(_control_lines(spark, sf_dir))
    return s.select("deck", "name", "nlgeom", "solver", F.col("numbers")[0].alias("first_number"), F.col("numbers")[1].alias("second_number"), F.size("numbers").alias("n_numbers"))


@query(
    """SELECT s_nationkey::BIGINT AS deck, count(*) * 15 + 2 AS n_lines, count(*) * 9 + 2 AS n_headers, 11 AS n_keywords, 0 AS n_materials, 0 AS n_loads, count(*) AS n_boundaries
FROM supplier GROUP BY s_nationkey"""
)
def deck_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deck_parsing.inventory(cut(_control_lines(spark, sf_dir)))


@query()
def deck_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each deck says as one JSON text."""
    return deck_parsing.documents(cut(_control_lines(spark, sf_dir)))
