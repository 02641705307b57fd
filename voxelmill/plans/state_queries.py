"""Queries on a run's state: sources by precedence, scatter, cases, planes, images, checks of checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deck_parsing, neighbours, states
from .tables import SEGMENTS, SUPPLIER_SEEDS, VOXELS, segments, supplier_seeds, table, voxels

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
c AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)
SELECT c.k AS c_custkey, coalesce(a.v, b.v, c.v) AS value, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 ELSE 2 END AS source_no FROM c LEFT JOIN a USING (k) LEFT JOIN b USING (k)"""
)
def resolved_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for each customer: of open orders, else of filled ones, else the balance."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("value"))
    asked = [o.filter(F.col("o_orderstatus") == s).join(own.select("c_custkey"), "c_custkey", "left_semi").groupBy("c_custkey").agg(F.max("o_totalprice").alias("value")) for s in "OF"]
    return states.by_precedence([*asked, own], ["c_custkey"], "value")


@query(
    f"""WITH {VOXELS}, u AS (SELECT CAST(p_partkey % 40 AS INT) AS x, CAST(p_partkey % 37 AS INT) AS y, CAST(p_size % 20 AS INT) AS z, max(p_size) AS v FROM part GROUP BY 1, 2, 3)
SELECT x, y, z, coalesce(u.v, density_milli) AS density_milli FROM vox LEFT JOIN u USING (x, y, z)"""
)
def scatter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes put into the grid at their anchors."""
    u = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).cast("int").alias("x"), (F.col("p_partkey") % 37).cast("int").alias("y"), (F.col("p_size") % 20).cast("int").alias("z"), F.col("p_size").cast("long").alias("density_milli"))
    return states.scatter(voxels(spark, sf_dir).select("x", "y", "z", "density_milli"), u.groupBy("x", "y", "z").agg(F.max("density_milli").alias("density_milli")), ["x", "y", "z"], "density_milli")


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as nodes of their nation, orders as elements about their customer."""
    k = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select("c_nationkey", k.alias("node_id"), (k % 31 + 1).alias("x"), (k % 17 + 1).alias("y"), (k % 7 + 1).alias("z"))
    o = table(spark, sf_dir, "orders").join(nodes.select("c_nationkey", F.col("node_id").alias("o_custkey")), "o_custkey")
    return nodes, o.select("c_nationkey", F.col("o_orderkey").alias("element_id"), F.col("o_custkey").alias("first_node"))


@query("SELECT c_nationkey, max(c_custkey % 31 + 1) - 1 AS n_x, max(c_custkey % 17 + 1) - 1 AS n_y, max(c_custkey % 7 + 1) - 1 AS n_z FROM customer GROUP BY c_nationkey")
def mesh_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.grid_shape(_mesh(spark, sf_dir)[0], ["c_nationkey"])


@query("SELECT c_nationkey, o_orderkey AS element_id, c_custkey % 31 AS x, c_custkey % 17 AS y, c_custkey % 7 AS z FROM orders JOIN customer ON o_custkey = c_custkey")
def element_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, elements = _mesh(spark, sf_dir)
    return states.anchors(elements, nodes, ["c_nationkey"])


@query(
    """WITH h AS (SELECT 'force_case_' || (o_custkey % 3 + 1) AS "case", o_orderkey AS step, o_totalprice AS value FROM orders),
c AS (SELECT 'force_case_' || n AS "case", n * 100.0::DOUBLE AS force FROM (VALUES (1), (2), (3)) v(n))
SELECT "case", CAST(split_part("case", '_', 3) AS INT) AS case_no, count(*) AS n, round(sum(value), 2) AS total, force, CASE WHEN "case" = 'force_case_2' THEN 7.0::DOUBLE ELSE 1.5::DOUBLE END AS reserved
FROM h JOIN c USING ("case") GROUP BY ALL"""
)
def case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as steps of three load cases, with the cases' forces and reservations."""
    h = table(spark, sf_dir, "orders").select(F.concat(F.lit("force_case_"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("case"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("value"))
    cases = spark.range(1, 4).select(F.concat(F.lit("force_case_"), F.col("id").cast("string")).alias("case"), (F.col("id") * 100.0).alias("force"))
    kept = cases.filter("case = 'force_case_2'").select("case", F.lit(7.0).alias("reserved"))
    r = states.numbered_cases(states.case_records(h, cases, kept, 1.5), "case")
    return r.groupBy("case", "case_no", "force", "reserved").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH c AS (SELECT unnest(['a', 'b', 'c']) AS "case"), own AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS "case", o_orderkey AS k, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P'),
r AS (SELECT "case", value, true AS is_own FROM own UNION ALL SELECT 'c', c_acctbal, false FROM customer)
SELECT "case", is_own, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY 1, 2"""
)
def initial_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's own initial values, or the shared ones."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    own = o.select(F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("case"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    shared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case string")
    v = states.case_values(cases, own, shared, ["k"])
    return v.groupBy("case", "is_own").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k, 'unknown' AS status FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'missing' FROM o WHERE k NOT IN (SELECT k FROM c)"""
)
def key_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit without a pending order, and customers with one who are not in credit."""
    c, o = table(spark, sf_dir, "customer").filter("c_acctbal > 0"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return states.key_mismatches(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")), ["k"])


@query(
    """WITH h AS (SELECT o_custkey AS c, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS "case", coalesce(n, 0) AS n_steps, c_custkey % 20 AS expected, CASE WHEN n IS NULL THEN 'missing' WHEN n <> c_custkey % 20 THEN 'fail' ELSE 'pass' END AS status FROM customer LEFT JOIN h ON c = c_custkey"""
)
def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps found against steps expected, for each case."""
    h = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("step"))
    return states.step_counts(h, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case"), (F.col("c_custkey") % 20).alias("expected")))


@query(
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"price": ' || o_totalprice || '}' WHEN 2 THEN '[' || o_custkey || ', 2]' WHEN 3 THEN '{"price": ' || o_totalprice ELSE ' {} ' END AS payload FROM orders)
SELECT o_orderkey, CASE WHEN payload IS NULL THEN 'missing' WHEN NOT json_valid(payload) THEN 'invalid' WHEN NOT starts_with(trim(payload), '{') THEN 'not_object' ELSE 'readable' END AS status FROM t"""
)
def payload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the orders' payloads is: missing, invalid, no object, readable."""
    price, k = F.col("o_totalprice").cast("string"), F.col("o_orderkey") % 5
    text = F.when(k == 1, F.concat(F.lit('{"price": '), price, F.lit("}"))).when(k == 2, F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(", 2]")))
    text = text.when(k == 3, F.concat(F.lit('{"price": '), price)).when(k == 4, F.lit(" {} "))
    return table(spark, sf_dir, "orders").select("o_orderkey", states.payload_status(text).alias("status"))


@query(
    """SELECT p_partkey AS element_id, CASE WHEN p_size > 10 THEN greatest(least(p_retailprice / 2000.0::DOUBLE, 1), 0) ELSE 0.36::DOUBLE END AS density,
  CAST(round_even(CASE WHEN p_size > 10 THEN greatest(least(p_retailprice / 2000.0::DOUBLE, 1), 0) ELSE 0.36::DOUBLE END * 100, 0) AS INT) AS bucket,
  CAST(round_even(CASE WHEN p_size > 10 THEN greatest(least(p_retailprice / 2000.0::DOUBLE, 1), 0) ELSE 0.36::DOUBLE END * 1000, 0) AS INT) AS milli FROM part"""
)
def initial_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), (F.col("p_size") > 10).alias("design"), (F.col("p_retailprice") / 2000.0).alias("value"))
    return states.initial_state(p, 0.36, 100).select("element_id", "density", "bucket", "milli")


@query(
    f"""WITH {SEGMENTS}, h AS (SELECT l_suppkey, x1 - x0 AS nx, y1 - y0 AS ny, z1 - z0 AS nz, (x1*x1 + y1*y1 + z1*z1 - x0*x0 - y0*y0 - z0*z0) / 2.0::DOUBLE AS rhs FROM seg WHERE (x0, y0, z0) <> (x1, y1, z1)),
u AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS n, CASE WHEN nx <> 0 THEN sign(nx) WHEN ny <> 0 THEN sign(ny) ELSE sign(nz) END AS sg FROM h)
SELECT l_suppkey AS g, round(nx / n * sg, 5) + 0.0 AS nx, round(ny / n * sg, 5) + 0.0 AS ny, round(nz / n * sg, 5) + 0.0 AS nz, round(rhs / n * sg, 5) + 0.0 AS rhs, CAST(count(*) AS INT) AS uses FROM u GROUP BY ALL"""
)
def merged_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bisecting planes of each supplier's segments in canonical form, equal
    ones made one, with how many segments use each."""
    ends = segments(spark, sf_dir).select(F.col("l_suppkey").alias("g"), *[F.col(f"{a}{e}").cast("double").alias(f"{p}{a}") for p, e in (("a", 0), ("b", 1)) for a in "xyz"])
    p = states.canonical_planes(ends.select("g", *neighbours.bisector()))
    key = [(F.round(c, 5) + 0.0).alias(c) for c in ("nx", "ny", "nz", "rhs")]
    return p.groupBy("g", *key).agg(F.count("*").cast("int").alias("uses"))


@query(
    f"""WITH {SUPPLIER_SEEDS}, m AS (SELECT id, x, y, z FROM s UNION ALL SELECT id, -24 - x, y, z FROM s UNION ALL SELECT id, 24 - x, y, z FROM s UNION ALL SELECT id, x, -24 - y, z FROM s
  UNION ALL SELECT id, x, 24 - y, z FROM s UNION ALL SELECT id, x, y, -24 - z FROM s UNION ALL SELECT id, x, y, 24 - z FROM s)
SELECT id AS seed_id, count(*) AS copies, round(sum(x * x + y * y + z * z), 4) AS r2 FROM m GROUP BY id"""
)
def mirrored_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = states.mirrored(supplier_seeds(spark, sf_dir).select("seed_id", "x", "y", "z"), -12.0, 12.0)
    return m.groupBy("seed_id").agg(F.count("*").alias("copies"), F.round(F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 4).alias("r2"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 9 + l_quantity / 100.0::DOUBLE AS x, l_suppkey % 9 + l_quantity / 200.0::DOUBLE AS y, l_quantity AS q FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY floor(x), floor(y) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, q) AS n FROM p)
SELECT a.l_orderkey, count(*) AS n, round(sum(b.x), 4) AS x, round(sum(b.y), 4) AS y FROM p a JOIN f b ON b.n = 1 AND floor(a.x) = floor(b.x) AND floor(a.y) = floor(b.y) GROUP BY a.l_orderkey"""
)
def snapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line points moved to the first point of their square."""
    q = F.col("l_quantity")
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), (F.col("l_partkey") % 9 + q / 100.0).alias("x"), (F.col("l_suppkey") % 9 + q / 200.0).alias("y"))
    s = states.snapped(p, [F.floor("x"), F.floor("y")], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q"], ("x", "y"))
    return s.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("y"), 4).alias("y"))


@query(
    """WITH b AS (SELECT DISTINCT p_brand AS deck, unnest(range(0, 101)) AS bucket FROM part), m AS (SELECT p_brand AS deck, CAST(p_partkey % 150 AS INT) AS bucket, count(*) AS n, sum(p_size * 0.5::DOUBLE) AS d FROM part GROUP BY 1, 2)
SELECT deck, CAST(bucket AS INT) AS bucket, coalesce(n, 0) AS n, d AS density FROM b LEFT JOIN m USING (deck, bucket)"""
)
def bucket_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as materials CAGE_0 to CAGE_100 of their brand's deck; missing ones have nulls."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("deck"), F.concat(F.lit("Cage_"), (F.col("p_partkey") % 150).cast("string")).alias("material"), (F.col("p_size") * 0.5).alias("density"), F.lit(1.0).alias("modulus"), F.lit(0.3).alias("ratio")
    )
    c = deck_parsing.bucket_catalog(p, "CAGE", 0, 100)
    return c.groupBy("deck", "bucket").agg(F.count("material").alias("n"), F.sum("density").alias("density"))
