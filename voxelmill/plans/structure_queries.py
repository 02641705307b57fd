"""Queries on points, edges, meshes, sets, text decks and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import checks, decks, diagram, geometry, neighbours, ordered
from ..operators.prefix import group_index
from ..session import cut
from .tables import SEGMENTS, label_seeds, label_seeds_sql, points, segments, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ends(prefix: str):
    return F.struct(*[F.col(f"{a}{prefix}").alias(a) for a in "xyz"])


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x0", "y0", "z0", "x1", "y1", "z1"]


@query(
    f"""WITH {SEGMENTS}, k AS (SELECT *, (x0, y0, z0) > (x1, y1, z1) AS flip FROM seg),
u AS (SELECT CASE WHEN flip THEN x1 ELSE x0 END AS lx, CASE WHEN flip THEN y1 ELSE y0 END AS ly, CASE WHEN flip THEN z1 ELSE z0 END AS lz,
             CASE WHEN flip THEN x0 ELSE x1 END AS hx, CASE WHEN flip THEN y0 ELSE y1 END AS hy, CASE WHEN flip THEN z0 ELSE z1 END AS hz, * FROM k)
SELECT lx, ly, lz, hx, hy, hz, l_orderkey, l_linenumber FROM u
QUALIFY row_number() OVER (PARTITION BY lx, ly, lz, hx, hy, hz ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1"""
)
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    key = ordered.unordered_key(_ends("0"), _ends("1"))
    first = ordered.first_wins(seg.withColumn("key", key), ["key"], ORDER[:4], ["l_orderkey", "l_linenumber"])
    ends = [F.col(f"key.{e}.{a}").alias(f"{e[0]}{a}") for e in ("lo", "hi") for a in "xyz"]
    return first.select(*ends, "l_orderkey", "l_linenumber")


@query(
    f"""WITH {SEGMENTS}, o AS (SELECT i, j FROM (SELECT unnest(range(2)) AS i), (SELECT unnest(range(2)) AS j)),
t AS (SELECT x0 + 12 * i AS ax, y0 + 12 * j AS ay_, z0 AS az, x1 + 12 * i AS bx, y1 + 12 * j AS by_, z1 AS bz FROM seg, o WHERE l_quantity_ok),
d AS (SELECT DISTINCT CASE WHEN f THEN bx ELSE ax END AS lx, CASE WHEN f THEN by_ ELSE ay_ END AS ly, CASE WHEN f THEN bz ELSE az END AS lz,
             CASE WHEN f THEN ax ELSE bx END AS hx, CASE WHEN f THEN ay_ ELSE by_ END AS hy, CASE WHEN f THEN az ELSE bz END AS hz
      FROM (SELECT *, (ax, ay_, az) > (bx, by_, bz) AS f FROM t))
SELECT CAST(lx AS INT) AS lx, CAST(ly AS INT) AS ly, count(*) AS edges, CAST(sum(hx + hy + hz - lz) AS BIGINT) AS total FROM d GROUP BY lx, ly""".replace(" WHERE l_quantity_ok", "")
)
def tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments repeated in a 2 x 2 tiling, those on common walls once; by the tile point they begin in."""
    seg = segments(spark, sf_dir).select("x0", "y0", "z0", "x1", "y1", "z1").distinct()
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = seg.withColumn("o", shift)
    moved = lambda e: F.struct((F.col(f"x{e}") + F.col("o.i") * 12).alias("x"), (F.col(f"y{e}") + F.col("o.j") * 12).alias("y"), F.col(f"z{e}").alias("z"))
    keys = t.select(ordered.unordered_key(moved("0"), moved("1")).alias("k")).distinct()
    total = F.col("k.hi.x") + F.col("k.hi.y") + F.col("k.hi.z") - F.col("k.lo.z")
    return keys.groupBy(F.col("k.lo.x").alias("lx"), F.col("k.lo.y").alias("ly")).agg(F.count("*").alias("edges"), F.sum(total.cast("long")).alias("total"))


@query(
    f"""WITH {SEGMENTS}, f AS (SELECT *, list_filter([CASE WHEN x0=0 THEN 'x0' END, CASE WHEN x0=11 THEN 'x1' END, CASE WHEN y0=0 THEN 'y0' END, CASE WHEN y0=11 THEN 'y1' END, CASE WHEN z0=0 THEN 'z0' END, CASE WHEN z0=11 THEN 'z1' END], lambda v: v IS NOT NULL) AS fa,
  list_filter([CASE WHEN x1=0 THEN 'x0' END, CASE WHEN x1=11 THEN 'x1' END, CASE WHEN y1=0 THEN 'y0' END, CASE WHEN y1=11 THEN 'y1' END, CASE WHEN z1=0 THEN 'z0' END, CASE WHEN z1=11 THEN 'z1' END], lambda v: v IS NOT NULL) AS fb FROM seg)
SELECT CASE WHEN len(list_intersect(fa, fb)) >= 2 THEN 'cube_edge' WHEN len(list_intersect(fa, fb)) = 1 THEN 'face_edge' WHEN len(fa) > 0 OR len(fb) > 0 THEN 'half_face' ELSE 'interior' END AS role,
       count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM f GROUP BY 1"""
)
def edge_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    at = lambda e: geometry.faces_of([F.col(f"{a}{e}") for a in "xyz"], 0.0, 11.0)
    seg = seg.withColumn("fa", at("0")).withColumn("fb", at("1"))
    return seg.groupBy(geometry.edge_role(F.col("fa"), F.col("fb")).alias("role")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def cell_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports of each seed's cell in its label's diagram: bisectors with its
    neighbours (key 7 on), and the box -12..12 (keys 1 to 6)."""
    seeds = cut(label_seeds(spark, sf_dir, (0.0, 0.0, 0.0)).withColumnRenamed("g", "label"))
    graph = diagram.neighbour_graph(seeds, "label", diagram.box_about(seeds, ((-12.0,) * 3, (12.0,) * 3)))
    half = diagram.bisectors(graph, seeds, "label").select("label", "seed_id", (F.col("neighbour_id") + 7).alias("key"), "nx", "ny", "nz", "rhs")
    sides = [(i + 1, *[s if a == axis else 0.0 for a in range(3)], 12.0) for i, (axis, s) in enumerate((a, s) for a in range(3) for s in (1.0, -1.0))]
    rows = [F.struct(F.lit(k).cast("long").alias("key"), F.lit(x).alias("nx"), F.lit(y).alias("ny"), F.lit(z).alias("nz"), F.lit(r).alias("rhs")) for k, x, y, z, r in sides]
    box = seeds.select("label", "seed_id", F.explode(F.array(*rows)).alias("b")).select("label", "seed_id", "b.*")
    return cut(half.union(box))


#: All planes of a label's seeds, the vertices of each cell (v), and the planes that touch it (near).
_PLANES = f"""{label_seeds_sql((0.0, 0.0, 0.0)).replace("s AS (", "s0 AS (", 1)}, s AS (SELECT g AS label, id AS seed_id, x, y, z FROM s0), h AS (
  SELECT a.label, a.seed_id, b.seed_id + 7 AS key, 2 * (b.x - a.x) AS nx, 2 * (b.y - a.y) AS ny, 2 * (b.z - a.z) AS nz,
         b.x * b.x + b.y * b.y + b.z * b.z - a.x * a.x - a.y * a.y - a.z * a.z AS rhs
  FROM s a JOIN s b ON a.label = b.label AND a.seed_id <> b.seed_id),
box(key, nx, ny, nz, rhs) AS (VALUES (1, 1, 0, 0, 12), (2, -1, 0, 0, 12), (3, 0, 1, 0, 12), (4, 0, -1, 0, 12), (5, 0, 0, 1, 12), (6, 0, 0, -1, 12)),
pl AS (SELECT * FROM h UNION ALL SELECT label, seed_id, key, nx, ny, nz, rhs FROM s, box),
t AS (SELECT a.seed_id, a.key AS ak, b.key AS bk, c.key AS ck,
  a.nx * (b.ny * c.nz - b.nz * c.ny) - a.ny * (b.nx * c.nz - b.nz * c.nx) + a.nz * (b.nx * c.ny - b.ny * c.nx) AS det,
  a.rhs * (b.ny * c.nz - b.nz * c.ny) - a.ny * (b.rhs * c.nz - b.nz * c.rhs) + a.nz * (b.rhs * c.ny - b.ny * c.rhs) AS dx,
  a.nx * (b.rhs * c.nz - b.nz * c.rhs) - a.rhs * (b.nx * c.nz - b.nz * c.nx) + a.nz * (b.nx * c.rhs - b.rhs * c.nx) AS dy,
  a.nx * (b.ny * c.rhs - b.rhs * c.ny) - a.ny * (b.nx * c.rhs - b.rhs * c.nx) + a.rhs * (b.nx * c.ny - b.ny * c.nx) AS dz
  FROM pl a JOIN pl b ON b.seed_id = a.seed_id AND b.key > a.key JOIN pl c ON c.seed_id = a.seed_id AND c.key > b.key),
q AS (SELECT seed_id, ak, bk, ck, dx / det AS x, dy / det AS y, dz / det AS z FROM t WHERE abs(det) > 1e-12),
b12 AS (SELECT * FROM q WHERE abs(x) <= 12 + 1e-6 AND abs(y) <= 12 + 1e-6 AND abs(z) <= 12 + 1e-6),
dozen AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY nx*nx + ny*ny + nz*nz) <= 12),
few AS (SELECT * FROM b12 p ANTI JOIN dozen d ON d.seed_id = p.seed_id AND d.nx * p.x + d.ny * p.y + d.nz * p.z - d.rhs > 1e-6),
v AS (SELECT * FROM few q WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.seed_id = q.seed_id AND pl.nx * q.x + pl.ny * q.y + pl.nz * q.z - pl.rhs > 1e-6))"""


@query(
    f"""WITH {_PLANES}, near AS (SELECT DISTINCT seed_id, unnest([ak, bk, ck]) AS key FROM v UNION SELECT s.seed_id, box.key FROM s, box)
SELECT t.seed_id, count(*) AS triples FROM t JOIN near a ON a.seed_id = t.seed_id AND a.key = ak JOIN near b ON b.seed_id = t.seed_id AND b.key = bk
JOIN near c ON c.seed_id = t.seed_id AND c.key = ck WHERE abs(det) > 1e-12 GROUP BY t.seed_id"""
)
def plane_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.plane_triples(cell_planes(spark, sf_dir), ["label", "seed_id"]).groupBy("seed_id").agg(F.count("*").alias("triples"))


@query(
    f"""WITH {_PLANES},
d AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY seed_id, round_even(x * 1e5, 0), round_even(y * 1e5, 0), round_even(z * 1e5, 0) ORDER BY ak, bk, ck) = 1)
SELECT seed_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z FROM d"""
)
def voronoi_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = geometry.cell_vertices(cell_planes(spark, sf_dir), ["label", "seed_id"])
    return v.select("seed_id", *[(F.round(a, 3) + 0.0).alias(a) for a in "xyz"])


@query(
    """WITH r AS (SELECT s_nationkey AS g, cos(CAST(s_suppkey AS DOUBLE)) AS a, sin(CAST(s_suppkey AS DOUBLE)) AS b, -0.2 - (s_suppkey % 7) / 10.0::DOUBLE AS c FROM supplier),
m AS (SELECT g, a, b, c, hypot FROM (SELECT *, sqrt(a*a + b*b) AS hypot FROM r)),
z AS (SELECT g, unnest([((atan2(b, a) - acos(-c / hypot)) % (2*pi()) + 2*pi()) % (2*pi()), ((atan2(b, a) + acos(-c / hypot)) % (2*pi()) + 2*pi()) % (2*pi())]) AS t FROM m WHERE abs(c) <= hypot),
e AS (SELECT g, t FROM z UNION SELECT DISTINCT g, 0.0::DOUBLE FROM r UNION SELECT DISTINCT g, 2*pi() FROM r),
p AS (SELECT g, t AS lo, lead(t) OVER (PARTITION BY g ORDER BY t) AS hi FROM e)
SELECT g AS s_nationkey, round(lo, 6) AS lo, round(hi, 6) AS hi FROM p WHERE hi - lo > 1e-9
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.g = p.g AND r.a * cos((lo + hi) / 2) + r.b * sin((lo + hi) / 2) + r.c > 1e-9)"""
)
def trig_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("double")
    rows = s.select("s_nationkey", F.cos(key).alias("a"), F.sin(key).alias("b"), (F.lit(-0.2) - (F.col("s_suppkey") % 7) / 10.0).alias("c"))
    found = geometry.trig_intervals(rows, "s_nationkey")
    return found.select("s_nationkey", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's distinct line points, ordered by line number, part and supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") % 40).cast("double").alias("x"), (F.col("l_suppkey") % 40).cast("double").alias("y"), F.col("l_quantity").alias("z"),
    ).distinct()


_LINES = """ln AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 40 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, l_quantity AS z FROM lineitem)"""
_SEQ = ["l_linenumber", "l_partkey", "l_suppkey", "z"]
_SEQ_SQL = "l_linenumber, l_partkey, l_suppkey, z"


@query(
    f"""WITH {_LINES}, g AS (SELECT l_orderkey, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d
  FROM ln WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_SEQ_SQL}))
SELECT l_orderkey, count(*) AS n, round(coalesce(sum(d), 0), 5) AS length FROM g GROUP BY l_orderkey"""
)
def polyline_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.polyline_length(_line_points(spark, sf_dir), "l_orderkey", _SEQ)
    return out.select("l_orderkey", "n", F.round("length", 5).alias("length"))


@query(
    f"""WITH {_LINES}, g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, z, lag(z) OVER w AS b, lead(z) OVER w AS a
  FROM ln WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_SEQ_SQL}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN b IS NULL THEN a - z WHEN a IS NULL THEN z - b ELSE (a - b) / 2 END, 6) AS dz FROM g"""
)
def curve_tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.central_differences(_line_points(spark, sf_dir), "l_orderkey", _SEQ, "z", "dz")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("dz", 6).alias("dz"))


@query(
    f"""WITH {_LINES}, r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ_SQL}) AS n FROM ln)
SELECT a.l_orderkey, f.l_partkey AS i0, a.l_partkey AS i1, b.l_partkey AS i2 FROM r a JOIN r b ON b.l_orderkey = a.l_orderkey AND b.n = a.n + 1
JOIN r f ON f.l_orderkey = a.l_orderkey AND f.n = 1 WHERE a.n >= 2"""
)
def fan_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _line_points(spark, sf_dir)
    loops = pts.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_SEQ))).alias("s"))
    t = loops.select("l_orderkey", F.explode(ordered.fan(F.transform("s", lambda e: e["l_partkey"]))).alias("t"))
    return t.select("l_orderkey", *[F.col("t")[i].alias(f"i{i}") for i in range(3)])


@query(
    f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM ln WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_SEQ_SQL}))
SELECT a.l_orderkey, CAST(sum(a.y * b.z - a.z * b.y) AS BIGINT) AS ax, CAST(sum(a.z * b.x - a.x * b.z) AS BIGINT) AS ay, CAST(sum(a.x * b.y - a.y * b.x) AS BIGINT) AS az
FROM r a JOIN r b ON b.l_orderkey = a.l_orderkey AND b.n = a.n % a.m + 1 GROUP BY a.l_orderkey"""
)
def loop_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    loops = _line_points(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_SEQ, "x", "y"))).alias("s"))
    area = loops.select("l_orderkey", ordered.area_vector(F.col("s")).alias("a"))
    return area.select("l_orderkey", *[F.col(f"a.{c}").cast("long").alias(f"a{c}") for c in "xyz"])


@query(
    f"""WITH {_LINES}, r AS (SELECT l_orderkey, z AS v FROM ln), o AS (SELECT l_orderkey, list(v ORDER BY v) AS s FROM r GROUP BY l_orderkey)
SELECT l_orderkey, floor(list_reduce(s, lambda a, b: CASE WHEN b - a % 1000 > 5 THEN (a - a % 1000) + 1000 + b ELSE a END) / 1000) + 1 AS n FROM o"""
)
def chained_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of an order that are more than 5 over the last one kept."""
    s = _line_points(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("z")).alias("s"))
    return s.select("l_orderkey", F.size(ordered.chained_distinct(F.col("s"), 5.0)).cast("double").alias("n"))


@query(
    """WITH e AS (SELECT DISTINCT p_size FROM part) SELECT CAST(r AS BIGINT) AS p_size, coalesce(count(p.p_partkey), 0) AS n, coalesce(CAST(sum(p.p_partkey) AS BIGINT), 0) AS keys
FROM (SELECT unnest(range(0, 61)) AS r) LEFT JOIN part p ON p.p_size = r GROUP BY r"""
)
def densify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("long").alias("p_size")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))
    return ordered.densify(held, "p_size", 0, 60, {"n": 0, "keys": 0})


@query(
    """WITH b AS (SELECT p_partkey, CAST(round_even(p_retailprice / 2100 * 10, 0) AS INT) AS bucket FROM part),
k AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY p_partkey) - 1) // 4096 AS chunk FROM b),
c AS (SELECT bucket, chunk, count(*) AS n, min(p_partkey) AS first_id, md5(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS digest FROM k GROUP BY 1, 2)
SELECT CAST(r AS INT) AS bucket, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(CAST(min(first_id) AS BIGINT), -1) AS first_id, coalesce(md5(string_agg(digest, ',' ORDER BY chunk)), '') AS members
FROM (SELECT unnest(range(0, 11)) AS r) LEFT JOIN c ON bucket = r GROUP BY r"""
)
def bucket_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each bucket's members in order of id, 4096 at a time, empty buckets too."""
    b = table(spark, sf_dir, "part").select("p_partkey", F.rint(F.col("p_retailprice") / 2100.0 * 10.0).cast("int").alias("bucket"))
    k = group_index(b, "bucket", [F.col("p_partkey")], "i").groupBy("bucket", F.floor(F.col("i") / 4096).alias("chunk"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda v: v.cast("string")), ",")
    c = k.agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"), F.md5(joined.cast("binary")).alias("digest"))
    digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda v: v["digest"]), ",")
    held = c.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.md5(digests.cast("binary")).alias("members"))
    all_ = spark.range(0, 11).select(F.col("id").cast("int").alias("bucket"))
    return all_.join(held, "bucket", "left").na.fill({"n": 0, "first_id": -1, "members": ""})


@query(
    """WITH u AS (SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'), v AS (SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A'), w AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25),
a AS (SELECT id FROM u UNION SELECT id FROM v UNION SELECT id FROM w)
SELECT CAST(id IN (SELECT id FROM u) AS INT) AS in_returned, CAST(id IN (SELECT id FROM v) AS INT) AS in_accepted, CAST(id IN (SELECT id FROM w) AS INT) AS in_small, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM a GROUP BY 1, 2, 3"""
)
def partition_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How three id sets overlap: union, intersections and differences in one pass."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    part = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id"))
    m = checks.membership({"returned": li.filter("l_returnflag = 'R'").select("id"), "accepted": li.filter("l_returnflag = 'A'").select("id"), "small": part}, "id")
    return m.groupBy("in_returned", "in_accepted", "in_small").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def region_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti").distinct()


@query(
    """WITH d AS (SELECT doc_id, length(text) AS size, md5(text) AS digest FROM documents), l AS (SELECT doc_id, quality, toxic FROM labels),
a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN size + 1 ELSE size END AS size, CASE WHEN quality = 0 THEN 'changed' ELSE digest END AS digest FROM d JOIN l USING (doc_id))
SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN a.size IS DISTINCT FROM d.size THEN 'size' WHEN a.digest IS DISTINCT FROM d.digest THEN 'digest' ELSE 'same' END AS status
FROM d LEFT JOIN a USING (doc_id)"""
)
def manifest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))
    actual = d.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", (F.col("size") + F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("size"), F.when(F.col("quality") == 0, "changed").otherwise(F.col("digest")).alias("digest")
    )
    return checks.compare_manifest(d, actual, "doc_id", "size", "digest")


_ARRAYS = """a AS (SELECT l_returnflag AS key, l_partkey AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2),
b AS (SELECT l_returnflag AS key, l_partkey AS idx, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS v FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1, 2)"""


@query(
    f"""WITH {_ARRAYS} SELECT key, CAST(sum(CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_both,
  CAST(sum(CASE WHEN a.v IS NULL OR b.v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_one, max(abs(a.v - b.v)) AS max_error,
  bool_and(a.v IS NOT NULL AND b.v IS NOT NULL AND coalesce(abs(a.v - b.v) <= 1e-10 + 1e-8 * abs(b.v), false)) AS close
FROM a FULL JOIN b USING (key, idx) GROUP BY key"""
)
def array_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    side = lambda c: li.filter(c).groupBy(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("idx")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    return checks.compare_arrays(side("l_linenumber <= 6"), side("l_linenumber >= 2"))


@query(
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(lower(text), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: regexp_replace(regexp_replace(trim(x, ' '), '[ \t]+', ' ', 'g'), ' ?, ?', ',', 'g')), lambda x: x <> '') AS k FROM l)
SELECT doc_id, md5(array_to_string(k, chr(10))) AS digest, len(k) AS n_lines FROM n"""
)
def deck_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", decks.normalised(F.col("text")).alias("t"))
    lines = F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n")))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), lines.cast("long").alias("n_lines"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(string_split(line, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS k FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(sum(len(k)) AS BIGINT) AS n_tokens, max(len(k)) AS most FROM t GROUP BY doc_id"""
)
def deck_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    t = lines.select("doc_id", F.size(decks.tokens(F.col("line"))).cast("long").alias("k"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("k").alias("n_tokens"), F.max("k").alias("most"))


@query(
    """WITH l AS (SELECT o_orderkey AS n, o_custkey % 50 AS deck, CASE WHEN o_orderkey % 7 = 0 THEN '*Load, name=' || o_orderstatus || ', op=NEW' WHEN o_orderkey % 11 = 0 THEN '** note' ELSE o_custkey || ', ' || o_orderstatus || ',, ' || o_orderpriority END AS line FROM orders),
h AS (SELECT *, sum(CASE WHEN line LIKE '*%' AND line NOT LIKE '**%' THEN 1 ELSE 0 END) OVER (PARTITION BY deck ORDER BY n) AS section FROM l)
SELECT deck, CAST(section AS BIGINT) AS section, CASE WHEN section > 0 THEN 'load' END AS keyword, count(*) AS n_lines, CAST(sum(len(list_filter(list_transform(string_split(line, ','), lambda x: trim(x)), lambda x: x <> ''))) AS BIGINT) AS n_tokens
FROM h WHERE line NOT LIKE '*%' GROUP BY 1, 2, 3"""
)
def deck_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    line = F.when(key % 7 == 0, F.concat(F.lit("*Load, name="), "o_orderstatus", F.lit(", op=NEW"))).when(key % 11 == 0, "** note")
    line = line.otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(", "), "o_orderstatus", F.lit(",, "), "o_orderpriority"))
    found = decks.sections(o.select((F.col("o_custkey") % 50).alias("deck"), key.alias("n"), line.alias("line")))
    return found.groupBy("deck", "section", "keyword").agg(F.count("*").alias("n_lines"), F.sum(F.size("tokens").cast("long")).alias("n_tokens"))


@query(
    """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_brand, CAST(k // 10 AS INT) AS line_no, string_agg(lpad(CAST(p_partkey AS VARCHAR), 7, ' ') || ',', chr(9) ORDER BY p_partkey) AS line FROM r GROUP BY 1, 2"""
)
def comma_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decks.comma_block(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query(
    """WITH c AS (SELECT o_orderpriority AS step, CASE WHEN o_totalprice > 400000 THEN 'fail' WHEN o_totalprice > 300000 THEN 'warn' ELSE 'pass' END AS status, o_orderstatus FROM orders),
r AS (SELECT step, o_orderstatus, max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS m, count(*) AS n FROM c GROUP BY 1, 2)
SELECT step, o_orderstatus, CASE m WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END AS status, n FROM r"""
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    status = F.when(price > 400000, "fail").when(price > 300000, "warn").otherwise("pass")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("step"), "o_orderstatus", status.alias("status"))
    return checks.roll_up(rows, ["step", "o_orderstatus"])


@query(
    """WITH k AS (SELECT DISTINCT CAST(l_suppkey % 40 AS BIGINT) AS a, CAST(l_partkey % 40 AS BIGINT) AS b FROM lineitem)
SELECT a, b, CAST(dense_rank() OVER (ORDER BY a, b) - 1 AS BIGINT) AS node FROM k"""
)
def compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct grid nodes numbered without gaps, in order."""
    from ..operators.prefix import dense_index

    nodes = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b")).distinct()
    return dense_index(nodes, [F.col("a"), F.col("b")], "node")


@query(
    """SELECT o_custkey, min(struct_pack(p := o_totalprice, k := o_orderkey)).k AS cheapest, max(struct_pack(p := o_totalprice, k := -o_orderkey)).k * -1 AS dearest FROM orders GROUP BY o_custkey"""
)
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    low = F.min(F.struct("o_totalprice", "o_orderkey"))
    high = F.max(F.struct(F.col("o_totalprice"), (-F.col("o_orderkey")).alias("k")))
    return o.groupBy("o_custkey").agg(low.alias("a"), high.alias("b")).select("o_custkey", F.col("a.o_orderkey").alias("cheapest"), (-F.col("b.k")).alias("dearest"))


@query(
    """WITH l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
p AS (SELECT a.doc_id AS a_id, b.doc_id AS b_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, source FROM documents) a
      JOIN (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, source FROM documents) b ON a.source = b.source AND b.r = a.r + 1),
x AS (SELECT p.a_id, l.n, l.line FROM p JOIN l ON l.doc_id = p.a_id), y AS (SELECT p.a_id, l.n, l.line FROM p JOIN l ON l.doc_id = p.b_id),
d AS (SELECT coalesce(x.a_id, y.a_id) AS doc_id, coalesce(x.n, y.n) AS n, x.line IS DISTINCT FROM y.line AS differs FROM x FULL JOIN y ON x.a_id = y.a_id AND x.n = y.n)
SELECT doc_id, CAST(min(CASE WHEN differs THEN n END) AS BIGINT) AS first_mismatch FROM d GROUP BY doc_id"""
)
def first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line in which a document and the next one of its source differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    placed = cut(group_index(d.select("doc_id", "source").filter("source IS NOT NULL"), "source", [F.col("doc_id")], "r"))
    after = placed.select("source", (F.col("r") - 1).alias("r"), F.col("doc_id").alias("b_id"))
    pairs = placed.withColumnRenamed("doc_id", "a_id").join(after, ["source", "r"]).select("a_id", "b_id")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    x = pairs.join(lines.withColumnRenamed("doc_id", "a_id"), "a_id").select("a_id", "n", F.col("line").alias("x"))
    y = pairs.join(lines.withColumnRenamed("doc_id", "b_id"), "b_id").select("a_id", "n", F.col("line").alias("y"))
    both = x.join(y, ["a_id", "n"], "full_outer")
    differs = ~F.col("x").eqNullSafe(F.col("y"))
    return both.groupBy(F.col("a_id").alias("doc_id")).agg((F.min(F.when(differs, F.col("n"))) + 1).cast("long").alias("first_mismatch"))


@query(
    """SELECT p_brand AS deck, 'CAGE_' || p_partkey AS material, CAST(p_partkey AS INT) AS bucket, p_size * 0.5::DOUBLE AS density, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 10.0::DOUBLE END AS modulus,
  CASE WHEN p_partkey % 3 <> 0 THEN 0.25::DOUBLE END AS ratio FROM part"""
)
def deck_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a deck of materials for each brand, and read back."""
    k = F.col("p_partkey")
    lines = F.array(
        F.concat(F.lit("*Material, name=CAGE_"), k.cast("string")), F.lit("*Density"), F.concat((F.col("p_size") * 0.5).cast("string"), F.lit(",")),
        F.when(k % 3 != 0, "*Elastic").otherwise("** none"), F.when(k % 3 != 0, F.concat((k * 10.0).cast("string"), F.lit(", 0.25"))).otherwise(""),
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("deck"), k.alias("p"), F.posexplode(lines).alias("at", "line"))
    found = decks.materials(rows.select("deck", (F.col("p") * 8 + F.col("at")).alias("n"), "line"))
    return found.withColumn("bucket", decks.bucket_of(F.col("material")))
