"""Queries on elements, load cases and time steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mechanics as me
from ..session import cut
from .tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LAW = me.RateLaw()
_C1, _C2, _C3 = (repr(c) + "::DOUBLE" for c in LAW.slopes)
_LO, _HI, _MID = (repr(v) + "::DOUBLE" for v in (LAW.low, LAW.high, (LAW.high + LAW.full) / 2))


def _rate_sql(s: str) -> str:
    return (
        f"CASE WHEN {s} < {_LO} THEN {_C1} * ({s} - {_LO}) WHEN {s} <= {_HI} THEN 0 WHEN {s} <= 0.03::DOUBLE THEN {_C2} * pow({s} - {_MID}, 2) + 0.014::DOUBLE "
        f"WHEN {s} <= 0.1::DOUBLE THEN {_C3} * pow({s} - 0.1::DOUBLE, 2) - 0.05::DOUBLE ELSE -0.05::DOUBLE END"
    )


def _slope_sql(s: str) -> str:
    return (
        f"CASE WHEN {s} < {_LO} THEN {_C1} WHEN {s} <= {_HI} THEN 0 WHEN {s} <= 0.03::DOUBLE THEN 2 * {_C2} * ({s} - {_MID}) "
        f"WHEN {s} <= 0.1::DOUBLE THEN 2 * {_C3} * ({s} - 0.1::DOUBLE) ELSE 0 END"
    )


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_S = "(l_discount * 1.3::DOUBLE + l_quantity * 1e-5::DOUBLE)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _stim():
    return F.col("l_discount") * 1.3 + F.col("l_quantity") * 1e-5


@query(f"SELECT {_KEYS}, round({_rate_sql(_S)}, 9) + 0.0 AS rate, round({_slope_sql(_S)}, 6) + 0.0 AS slope FROM lineitem")
def bone_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stim()
    return _lines(spark, sf_dir).select(*_KEYS.split(", "), (F.round(me.rate(s), 9) + 0.0).alias("rate"), (F.round(me.rate_slope(s), 6) + 0.0).alias("slope"))


_X = "greatest(least((l_tax + l_discount) * 5, 1), 0.001)"


@query(
    f"SELECT {_KEYS}, round(least(110000, 11 + 110000 * pow({_X}, 3)), 4) AS modulus, CAST(greatest(least(round_even({_X} * 100, 0), 100), 0) AS INT) AS bucket FROM lineitem"
)
def simp_modulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_tax") + F.col("l_discount")) * 5
    e = me.modulus(x, 110000.0, 11.0)
    return _lines(spark, sf_dir).select(*_KEYS.split(", "), F.round(e, 4).alias("modulus"), me.bucket(me.clip(x, 0.001, 1.0), 1.0, 100).alias("bucket"))


@query(
    """WITH c AS (SELECT p_partkey, CAST(greatest(least(round_even(p_retailprice / 2100 * 100, 0), 100), 0) AS INT) AS bucket FROM part),
m AS (SELECT s_suppkey AS bucket, s_name AS material, round(s_acctbal, 2) AS modulus FROM supplier WHERE s_suppkey % 3 <> 0)
SELECT p_partkey, c.bucket, coalesce(material, 'CAGE_' || c.bucket) AS material, coalesce(modulus, c.bucket * 1100.0::DOUBLE) AS modulus FROM c LEFT JOIN m ON m.bucket = c.bucket"""
)
def modulus_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket of each element, with its catalogue entry or a fallback."""
    c = table(spark, sf_dir, "part").select("p_partkey", me.bucket(F.col("p_retailprice"), 2100.0, 100).alias("bucket"))
    m = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("int").alias("bucket"), F.col("s_name").alias("material"), F.round("s_acctbal", 2).alias("modulus"))
    return c.join(m, "bucket", "left").select(
        "p_partkey", "bucket", F.coalesce("material", F.concat(F.lit("CAGE_"), F.col("bucket").cast("string"))).alias("material"), F.coalesce("modulus", F.col("bucket") * F.lit(1100.0)).alias("modulus")
    )


@query(
    f"""WITH e AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS q, {_X} AS x FROM lineitem)
SELECT l_returnflag, round(sum(q * least(110000, 11 + 110000 * pow(x, 3))) / 1e6, 3) AS compliance, round(sum(-q * 3 * 110000 * x * x) / 1e6, 3) AS sensitivity, count(*) AS n FROM e GROUP BY 1"""
)
def compliance_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = me.clip((F.col("l_tax") + F.col("l_discount")) * 5, 0.001, 1.0)
    e = _lines(spark, sf_dir).select("l_returnflag", F.col("l_quantity").alias("q"), x.alias("x"))
    return e.groupBy("l_returnflag").agg(
        F.round(F.sum(F.col("q") * me.modulus(F.col("x"), 110000.0, 11.0)) / 1e6, 3).alias("compliance"),
        F.round(F.sum(-F.col("q") * 3 * 110000.0 * F.col("x") * F.col("x")) / 1e6, 3).alias("sensitivity"),
        F.count("*").alias("n"),
    )


_CORNERS = [(i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1)]


def _node(x, y, z):
    return (x * 41 + y) * 21 + z


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = F.col("l_partkey") % 40, F.col("l_suppkey") % 40, F.col("l_quantity").cast("long") % 20
    nodes = F.array(*[_node(x + i, y + j, z + k) for i, j, k in _CORNERS])
    return _lines(spark, sf_dir).select(nodes.alias("nodes"), F.col("l_linenumber").cast("long").alias("fx"), F.col("l_quantity").cast("long").alias("fy"), (F.col("l_orderkey") % 7 - 3).alias("fz"))


@query(
    """WITH e AS (SELECT l_partkey % 40 AS x, l_suppkey % 40 AS y, CAST(trunc(l_quantity) AS BIGINT) % 20 AS z, CAST(l_linenumber AS BIGINT) AS fx, CAST(trunc(l_quantity) AS BIGINT) AS fy, l_orderkey % 7 - 3 AS fz FROM lineitem),
o AS (SELECT i, j, k FROM (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j), (SELECT unnest(range(2)) AS k)),
n AS (SELECT ((x + i) * 41 + y + j) * 21 + z + k AS node_id, fx, fy, fz FROM e, o)
SELECT node_id, CAST(sum(fx) AS BIGINT) AS fx, CAST(sum(fy) AS BIGINT) AS fy, CAST(sum(fz) AS BIGINT) AS fz FROM n GROUP BY 1 HAVING sum(fx) <> 0 OR sum(fy) <> 0 OR sum(fz) <> 0"""
)
def scatter_add_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.scatter_add(_elements(spark, sf_dir), ["fx", "fy", "fz"])


@query(
    """WITH m AS (SELECT count(*) AS n FROM supplier), v AS (SELECT s_suppkey AS node_id, [CAST(round(s_acctbal * 100) AS BIGINT), CAST(s_nationkey AS BIGINT), s_suppkey * 3] AS u FROM supplier),
e AS (SELECT p_partkey AS element_id, unnest(range(8)) AS c FROM part), x AS (SELECT element_id, c, (element_id * 7 + c * 13) % n AS node_id FROM e, m)
SELECT element_id, string_agg(CAST(u[1] AS VARCHAR) || ',' || CAST(u[2] AS VARCHAR) || ',' || CAST(u[3] AS VARCHAR), ',' ORDER BY c) AS u FROM x JOIN v USING (node_id) GROUP BY 1"""
)
def gather_element_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    nodes = s.select(F.col("s_suppkey").alias("node_id"), F.round(F.col("s_acctbal") * 100).cast("long").alias("ux"), F.col("s_nationkey").cast("long").alias("uy"), (F.col("s_suppkey") * 3).alias("uz"))
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.array(*[(F.col("p_partkey") * 7 + c * 13) % n for c in range(8)]).alias("nodes"))
    return me.gather(e, nodes, ["ux", "uy", "uz"]).select("element_id", F.array_join(F.transform("u", lambda v: v.cast("string")), ",").alias("u"))


@query(
    """WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS step, CAST(round(value * 100) AS BIGINT) AS v, user_id FROM events WHERE value IS NOT NULL),
s AS (SELECT event_type, step, CAST(sum(v) AS BIGINT) AS total, count(*) AS n FROM e GROUP BY 1, 2)
SELECT event_type, step, total, n, CAST(sum(total) OVER (PARTITION BY event_type ORDER BY step) AS BIGINT) AS upto, CAST(-sum(total) OVER (PARTITION BY step) AS BIGINT) AS objective FROM s"""
)
def case_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by load case and step, running by case, and each step's objective over the cases."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("step"), F.round(F.col("value") * 100).cast("long").alias("v"))
    s = e.groupBy("event_type", "step").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
    objective = s.groupBy("step").agg((-F.sum("total")).alias("objective"))
    # a case has one row for each day
    upto = Window.partitionBy("event_type").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("upto", F.sum("total").over(upto)).join(objective, "step").select("event_type", "step", "total", "n", "upto", "objective")


@query(
    """SELECT p_size AS radius, count(*) AS n, min(CAST(l_quantity AS BIGINT)) AS q_min, max(CAST(l_quantity AS BIGINT)) AS q_max, round(avg(l_quantity), 5) AS q_mean,
  round(min(l_extendedprice), 2) AS e_min, round(max(l_extendedprice), 2) AS e_max, round(avg(l_extendedprice), 3) AS e_mean,
  min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey)).a AS first_order FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1"""
)
def radius_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("radius"))
    li = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").join(part, "l_partkey")
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return li.groupBy("radius").agg(
        F.count("*").alias("n"), F.min(q.cast("long")).alias("q_min"), F.max(q.cast("long")).alias("q_max"), F.round(F.avg(q), 5).alias("q_mean"),
        F.round(F.min(e), 2).alias("e_min"), F.round(F.max(e), 2).alias("e_max"), F.round(F.avg(e), 3).alias("e_mean"),
        F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))["l_orderkey"].alias("first_order"),
    )


@query(
    """WITH t AS (SELECT s_suppkey, CAST(s_suppkey % 9 - 4 AS DOUBLE) AS x, CAST(s_nationkey % 7 - 3 AS DOUBLE) AS y, CAST(s_suppkey % 5 AS DOUBLE) AS z FROM supplier)
SELECT s_suppkey, round(0.01 + 0.002 * (z - 2) - 0.003 * (y - 0.5), 9) AS ux, round(-0.02 + 0.003 * (x - 1) - 0.001 * (z - 2), 9) AS uy, round(0.005 + 0.001 * (y - 0.5) - 0.002 * (x - 1), 9) AS uz FROM t"""
)
def rigid_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    p = {"x": (F.col("s_suppkey") % 9) - 4.0, "y": (F.col("s_nationkey") % 7) - 3.0, "z": (F.col("s_suppkey") % 5) * F.lit(1.0)}
    u = me.rigid_move(p, (1.0, 0.5, 2.0), (0.01, -0.02, 0.005), (0.001, 0.002, 0.003))
    return s.select("s_suppkey", *[F.round(u[a], 9).alias(f"u{a}") for a in "xyz"])


@query(
    f"""WITH t AS (SELECT {_KEYS}, l_quantity AS xx, l_discount * 100 AS yy, l_tax * 100 AS zz, l_linenumber AS xy, l_quantity / 5 AS yz, l_discount * 7 AS zx FROM lineitem)
SELECT {_KEYS}, round(sqrt(0.5 * (pow(xx - yy, 2) + pow(yy - zz, 2) + pow(zz - xx, 2)) + 3 * (xy * xy + yz * yz + zx * zx)), 6) AS von_mises FROM t"""
)
def von_mises(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = {"xx": F.col("l_quantity"), "yy": F.col("l_discount") * 100, "zz": F.col("l_tax") * 100, "xy": F.col("l_linenumber").cast("double"), "yz": F.col("l_quantity") / 5, "zx": F.col("l_discount") * 7}
    return _lines(spark, sf_dir).select(*_KEYS.split(", "), F.round(me.von_mises(s), 6).alias("von_mises"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 12 AS px, l_suppkey % 12 AS py, l_quantity AS pz, l_orderkey % 12 AS ax, 3.0 AS ay, 4.0 AS az, l_linenumber * 2.0 AS bx, 9.0 AS by_, 20.0 AS bz FROM lineitem),
c AS (SELECT *, greatest(least(((px-ax)*(bx-ax) + (py-ay)*(by_-ay) + (pz-az)*(bz-az)) / (pow(bx-ax,2) + pow(by_-ay,2) + pow(bz-az,2)), 1), 0) AS t FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(pow(px-ax-t*(bx-ax),2) + pow(py-ay-t*(by_-ay),2) + pow(pz-az-t*(bz-az),2), 5) AS d2 FROM c"""
)
def segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda e: e.cast("double")
    d = me.segment_distance2(
        [c(F.col("l_partkey") % 12), c(F.col("l_suppkey") % 12), F.col("l_quantity")],
        [c(F.col("l_orderkey") % 12), F.lit(3.0), F.lit(4.0)],
        [F.col("l_linenumber") * 2.0, F.lit(9.0), F.lit(20.0)],
    )
    return _lines(spark, sf_dir).select(*_KEYS.split(", "), F.round(d, 5).alias("d2"))


def kernel(n: int = 24) -> np.ndarray:
    """A banded positive matrix: 2.5 on the diagonal, -1 and 0.25 beside it."""
    return 2.5 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1) + 0.25 * (np.eye(n, k=3) + np.eye(n, k=-3))


_U = "CAST(embedding[{0}] AS DOUBLE)"
_TERMS = " + ".join(f"({float(kernel()[i, j])}) * {_U.format(i + 1)} * {_U.format(j + 1)}" for i in range(24) for j in range(24) if kernel()[i, j])


@query(f"SELECT vec_id, round(0.5 * ({_TERMS}), 6) AS energy FROM embeddings")
def quad_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    u = F.transform(F.slice("embedding", 1, 24), lambda v: v.cast("double"))
    return e.select("vec_id", u.alias("u")).select("vec_id", F.round(me.quadratic_form(F.col("u"), kernel()), 6).alias("energy"))


def _history_sql() -> str:
    e = "least(12000, 1.2::DOUBLE + 12000 * pow(greatest(least(rho, 1.86::DOUBLE), 0.001::DOUBLE) / 1.86::DOUBLE, 3))"
    out = "WITH h0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1e-7::DOUBLE AS q, 0.36::DOUBLE AS rho FROM lineitem)"
    for t in range(3):
        out += f""", s{t} AS (SELECT *, q * {e} / rho AS s FROM h{t}), h{t + 1} AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, greatest(least(rho + {_rate_sql('s')}, 1.86::DOUBLE), 0.001::DOUBLE) AS rho FROM s{t})"""
    return out + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(rho, 7) AS density FROM h3"


@query(_history_sql())
def density_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of the density recurrence, one projection each."""
    state = _lines(spark, sf_dir).select(*_KEYS.split(", "), (F.col("l_quantity") * 1e-7).alias("q"), F.lit(0.36).alias("rho"))
    for _ in range(3):
        e = me.modulus(F.col("rho"), 12000.0, 1.2, 1.86)
        state = state.withColumn("s", me.stimulus(F.col("q"), e, F.col("rho")))
        state = state.withColumn("rho", me.advance(F.col("rho"), F.col("s"), 1.0, 1.86)).drop("s")
    return state.select(*_KEYS.split(", "), F.round("rho", 7).alias("density"))


_SS = "(CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) * 0.02::DOUBLE)"


@query(
    f"""WITH t AS (SELECT vec_id, embedding, {_SS} AS s, CAST(embedding[2] AS DOUBLE) * 0.001::DOUBLE AS lku FROM embeddings),
g AS (SELECT vec_id, 1 + 2 * ({_slope_sql('s')}) * (s * 0.36::DOUBLE) / (0.216::DOUBLE * 0.36::DOUBLE * 0.36::DOUBLE) AS growth, lku * 3 * 0.36::DOUBLE * 0.36::DOUBLE * 12000 / pow(1.86::DOUBLE, 3) AS drop_ FROM t)
SELECT vec_id, round(growth - drop_, 5) AS first, round(24 * (growth - drop_), 4) AS total FROM g"""
)
def adjoint_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    s = F.col("a") * F.col("a") * 0.02
    rho = F.lit(0.36)
    phi = me.adjoint_step(F.array_repeat(F.lit(1.0), 24), me.rate_slope(s), s, rho, 0.216, F.col("b") * 0.001, 12000.0, 1.86)
    t = e.select("vec_id", phi.alias("phi"))
    return t.select("vec_id", F.round(F.col("phi")[0], 5).alias("first"), F.round(F.aggregate("phi", F.lit(0.0), lambda x, y: x + y), 4).alias("total"))


@query(
    """WITH e AS (SELECT DISTINCT least(l_partkey, -l_suppkey) AS a, greatest(l_partkey, -l_suppkey) AS b FROM lineitem WHERE l_partkey <> -l_suppkey),
d AS (SELECT a AS node, b AS other FROM e UNION ALL SELECT b, a FROM e)
SELECT node, count(*) AS degree, CAST(min(other) AS BIGINT) AS least FROM d GROUP BY node"""
)
def neighbour_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_partkey"), -F.col("l_suppkey")
    e = _lines(spark, sf_dir).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).union(e.select("b", "a"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.min("other").alias("least"))


@query()
def cg_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjugate gradients for (diagonal + graph) u = f on the parts-suppliers
    graph, matrix-free: each product is a gather join and a scatter sum."""
    from ..operators.solvers import conjugate_gradients

    li = _lines(spark, sf_dir)
    a, b = F.col("l_partkey"), -F.col("l_suppkey")
    e = li.select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).filter("i <> j").distinct()
    off = e.select("i", "j", F.lit(-1.0).alias("v"))
    off = off.union(off.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    diag = off.groupBy("i").agg(F.count("*").alias("n")).select("i", F.col("i").alias("j"), (F.col("n") + 0.5).alias("v"))
    load = li.groupBy(a.alias("i")).agg(F.sum(F.col("l_quantity")).alias("f"))
    return conjugate_gradients(cut(off.union(diag)), load, tol=1e-6)
