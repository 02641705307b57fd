"""Queries on density fields: quantising, sampling, stencils, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands, density, grid, neighbours, sampling
from ..operators.prefix import dense_index, running_sum
from .tables import KEYED, NX, NY, NZ, POINTS, SEGMENTS, VOXELS, keyed_voxels, points, segments, table, voxels

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {KEYED} SELECT x, y, z, density_milli, k FROM keyed")
def voxelize_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_voxels(spark, sf_dir)


@query(
    f"""WITH {VOXELS}, t AS (SELECT max(pow(density_milli, 2)) AS top, sum(CAST(density_milli * density_milli AS DOUBLE)) AS total FROM vox)
SELECT x, y, z, round(pow(density_milli, 2) / top, 9) AS intensity, round(pow(density_milli, 2) / total, 12) AS probability FROM vox, t"""
)
def density_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = density.probability(density.intensity(voxels(spark, sf_dir), 2.0), 2.0)
    return df.select("x", "y", "z", F.round("intensity", 9).alias("intensity"), F.round("probability", 12).alias("probability"))


@query(
    """WITH t AS (SELECT max(l_discount) AS top FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(greatest(least(round_even(l_discount * (CASE WHEN top <= 1.5 THEN 1000 ELSE 1 END), 0), 65535), 0) AS INT) AS density_milli,
       CAST(trunc(greatest(least(l_tax, 1.0), 0.0) * 1000) AS INT) AS cut_milli FROM lineitem, t"""
)
def quantize_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = density.to_milli(table(spark, sf_dir, "lineitem"), "l_discount")
    return li.select("l_orderkey", "l_linenumber", "density_milli", density.truncated_milli(F.col("l_tax")).alias("cut_milli"))


@query(
    f"WITH {KEYED} SELECT k, CAST(sum(density_milli * density_milli) OVER (ORDER BY k) AS BIGINT) AS cdf FROM keyed"
)
def density_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    vox = keyed_voxels(spark, sf_dir)
    return running_sum(vox, [F.col("k")], F.col("density_milli") * F.col("density_milli"), "cdf").select("k", "cdf")


def _sample(spark: SparkSession, sf_dir: str, right: bool) -> DataFrame:
    cdf = sampling.cumulative(keyed_voxels(spark, sf_dir), [F.col("k")], F.col("density_milli") * F.col("density_milli"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    total, n = cdf.agg(F.max("high")).first()[0] or 0, max(1, supplier.count())
    draws = supplier.withColumn("at", (F.col("s_suppkey") + 0.5) / float(n) * float(total))
    return sampling.draw(cdf, draws, "at", float(total), right).select("s_suppkey", "k", "x", "y", "z")


_DRAWS = f"""WITH {KEYED}, c AS (
  SELECT x, y, z, k, density_milli * density_milli AS w, sum(density_milli * density_milli) OVER (ORDER BY k) AS high FROM keyed),
t AS (SELECT CAST(max(high) AS DOUBLE) AS total FROM c), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM supplier),
d AS (SELECT s_suppkey, (s_suppkey + 0.5::DOUBLE) / n * total AS r FROM supplier, t, n)
SELECT s_suppkey, k, x, y, z FROM d JOIN c ON """


@query(_DRAWS + "high - w <= r AND r < high")
def weighted_sample_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, True)


@query(_DRAWS + "high - w < r AND r <= high")
def weighted_sample_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir, False)


_NEAREST = f"""WITH {POINTS}, d AS (
  SELECT point_id, seed_id, pow(p.x - s.x, 2) + pow(p.y - s.y, 2) + pow(p.z - s.z, 2) AS d2 FROM p, s),
n AS (SELECT point_id, seed_id, d2 FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d2, seed_id) = 1)"""


@query(_NEAREST + " SELECT point_id, seed_id, round(d2, 6) AS d2 FROM n")
def nearest_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest_seed(points(spark, sf_dir, False), points(spark, sf_dir, True))
    return near.select("point_id", "seed_id", F.round("d2", 6).alias("d2"))


@query(
    f"""WITH {POINTS} SELECT p.label, p.point_id, a.seed_id FROM p JOIN s a ON a.label = p.label WHERE NOT EXISTS (
  SELECT 1 FROM s b WHERE b.label = a.label AND b.seed_id <> a.seed_id AND
    2 * (b.x - a.x) * p.x + 2 * (b.y - a.y) * p.y + 2 * (b.z - a.z) * p.z
      > b.x * b.x + b.y * b.y + b.z * b.z - a.x * a.x - a.y * a.y - a.z * a.z + 1e-9)"""
)
def voronoi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and the cells, among their label's seeds, that hold them."""
    near = neighbours.nearest_seed(points(spark, sf_dir, False), points(spark, sf_dir, True), group=["label"])
    return near.select("label", "point_id", "seed_id")


@query(
    _NEAREST
    + """ SELECT seed_id, count(*) AS n, round(avg(p.x), 6) AS cx, round(avg(p.y), 6) AS cy, round(avg(p.z), 6) AS cz, round(sum(d2), 5) AS energy
FROM n JOIN p USING (point_id) GROUP BY seed_id"""
)
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sampled relaxation step: each seed moves to the mean of its points."""
    pts = points(spark, sf_dir, False)
    near = neighbours.nearest_seed(pts, points(spark, sf_dir, True))
    return near.join(pts, "point_id").groupBy("seed_id").agg(
        F.count("*").alias("n"), *[F.round(F.avg(a), 6).alias(f"c{a}") for a in "xyz"], F.round(F.sum("d2"), 5).alias("energy")
    )


@query(
    _NEAREST
    + """, c AS (SELECT seed_id, count(*) AS n FROM n GROUP BY seed_id)
SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, round(avg(n), 6) AS mean_n, round(stddev_pop(n) / avg(n), 6) AS cv FROM c"""
)
def cell_size_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest_seed(points(spark, sf_dir, False), points(spark, sf_dir, True))
    sizes = near.groupBy("seed_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("cells"), F.sum("n").alias("points"), F.round(F.avg("n"), 6).alias("mean_n"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("cv"))


@query(f"WITH {VOXELS} SELECT x, y, z, density_milli FROM vox WHERE pow(x + 0.5 - 20, 2) + pow(y + 0.5 - 20, 2) BETWEEN 64 AND 324")
def annulus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).filter(density.in_annulus(F.col("x"), F.col("y"), 20.0, 8.0, 18.0))


@query(
    f"""WITH {VOXELS}, c AS (SELECT x, y, z, x + 0.5 - 20 AS dx, y + 0.5 - 20 AS dy FROM vox),
g AS (SELECT x, y, z, sqrt(dx*dx + dy*dy) AS rad, atan2(dy, dx) AS theta, greatest(0, least(1, (sqrt(dx*dx + dy*dy) - 8) / 10.0::DOUBLE)) AS rn, greatest(0, least(1, z / 19.0::DOUBLE)) AS zn FROM c),
w AS (SELECT *, 0.52::DOUBLE + 0.23::DOUBLE * sin(3 * theta + 5.5 * zn) + 0.18::DOUBLE * cos(2 * pi() * rn) + 0.11::DOUBLE * sin(7 * rn - 4 * zn) + 0.08::DOUBLE * cos(9 * theta * rn + 2.5 * zn) AS raw FROM g)
SELECT x, y, z, CASE WHEN rad * rad BETWEEN 64 AND 324 THEN round(0.001::DOUBLE + 0.999::DOUBLE * greatest(0, least(1, (raw - (0.52::DOUBLE - 0.6::DOUBLE)) / 1.2::DOUBLE)), 3) ELSE 0 END AS density FROM w"""
)
def analytic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = density.wavy_density(F.col("x"), F.col("y"), F.col("z"), 20.0, 8.0, 18.0, 20.0)
    return voxels(spark, sf_dir).select("x", "y", "z", field.alias("density"))


@query(
    f"""WITH {VOXELS} SELECT CAST(x // 4 AS BIGINT) AS bx, CAST(y // 4 AS BIGINT) AS by, CAST(z // 2 AS BIGINT) AS bz,
       CAST(sum(density_milli) AS BIGINT) AS total, count(*) AS n FROM vox GROUP BY 1, 2, 3"""
)
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.block_mean(voxels(spark, sf_dir), "density_milli")


@query(
    f"""WITH {VOXELS}, o AS (SELECT x, y, z FROM vox WHERE density_milli >= 30)
SELECT x, y, z FROM o WHERE (SELECT count(*) FROM o n WHERE abs(n.x - o.x) + abs(n.y - o.y) + abs(n.z - o.z) = 1 AND n.x BETWEEN o.x - 1 AND o.x + 1) < 6"""
)
def surface_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.surface(voxels(spark, sf_dir).filter("density_milli >= 30"))


@query(
    f"""WITH {VOXELS}, l AS (SELECT x, y, z, density_milli % 7 AS label FROM vox),
n AS (SELECT a.label AS la, b.label AS lb FROM l a JOIN l b ON b.x = (a.x + 1) % {NX} AND b.y = a.y AND b.z = a.z
  UNION ALL SELECT a.label, b.label FROM l a JOIN l b ON b.x = a.x AND b.y = a.y + 1 AND b.z = a.z
  UNION ALL SELECT a.label, b.label FROM l a JOIN l b ON b.x = a.x AND b.y = a.y AND b.z = a.z + 1)
SELECT least(la, lb) AS a, greatest(la, lb) AS b, count(*) AS contacts FROM n WHERE la <> lb GROUP BY 1, 2"""
)
def label_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    vox = voxels(spark, sf_dir).withColumn("label", F.col("density_milli") % 7)
    return grid.adjacent_labels(vox, "label", (NX, NY, NZ), (True, False, False))


_MOMENTS = ", ".join(f"round(covar_pop({a}, {b}), 6) AS cov_{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query(f"WITH {VOXELS} SELECT count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z, {_MOMENTS} FROM vox WHERE density_milli > 20")
def obb_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = density.moments(voxels(spark, sf_dir), F.col("density_milli") > 20)
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


@query()
def obb_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field resampled in the frame of its oriented box, with probabilities."""
    vox = voxels(spark, sf_dir)
    box = density.fit_box(vox, F.col("density_milli") > 20)
    size = [int(2 * h + 1) + 1 for h in box["half"]]
    at = [F.col(f"t{i}") - float(box["half"][i]) for i in range(3)]
    # the new grid has a voxel for each of the old box's size, made by Spark
    t = spark.range(size[0] * size[1] * size[2]).select(
        "id", F.floor(F.col("id") / (size[1] * size[2])).alias("t0"), (F.floor(F.col("id") / size[2]) % size[1]).alias("t1"), (F.col("id") % size[2]).alias("t2")
    )
    back = [sum((at[r] * float(box["axes"][r][c]) for r in range(3)), F.lit(float(box["centre"][c]))) for c in range(3)]
    target = t.select("id", *[b.alias(a) for a, b in zip("xyz", back, strict=True)])
    return grid.trilinear(target, vox, "density_milli").filter("value > 0")


_RESAMPLE = " UNION ALL ".join(
    f"SELECT t.k, (CASE {i} WHEN 1 THEN 0.25 ELSE 0.75 END) * (CASE {j} WHEN 1 THEN 0.5 ELSE 0.5 END) * (CASE {k} WHEN 1 THEN 0.75 ELSE 0.25 END) * CAST(v.density_milli AS DOUBLE) AS w "
    f"FROM f t JOIN vox v ON v.x = t.x + {i} AND v.y = t.y + {j} AND v.z = t.z + {k}"
    for i in (0, 1)
    for j in (0, 1)
    for k in (0, 1)
)


@query(
    f"""WITH {KEYED}, f AS (SELECT * FROM keyed), w AS ({_RESAMPLE})
SELECT k AS id, round(sum(w), 6) AS value FROM w GROUP BY k"""
)
def trilinear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    vox = keyed_voxels(spark, sf_dir)
    targets = vox.select(F.col("k").alias("id"), (F.col("x") + 0.25).alias("x"), (F.col("y") + 0.5).alias("y"), (F.col("z") + 0.75).alias("z"))
    return grid.trilinear(targets, vox, "density_milli").select("id", F.round("value", 6).alias("value"))


_RASTER = f"""{SEGMENTS}, u AS (SELECT DISTINCT x0, y0, z0, x1, y1, z1 FROM seg),
l AS (SELECT *, greatest(2, CAST(ceil(sqrt(CAST((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0) AS DOUBLE)) * 2) AS INT)) AS n FROM u),
q AS (SELECT *, unnest(range(n)) AS s FROM l), r AS (
  SELECT DISTINCT CAST(round_even(x0 + (x1 - x0) * (s::DOUBLE / (n - 1)), 0) AS INT) AS x, CAST(round_even(y0 + (y1 - y0) * (s::DOUBLE / (n - 1)), 0) AS INT) AS y,
         CAST(round_even(z0 + (z1 - z0) * (s::DOUBLE / (n - 1)), 0) AS INT) AS z FROM q)"""


@query(f"WITH {_RASTER} SELECT x, y, z FROM r")
def rasterize_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.rasterise(segments(spark, sf_dir).select("x0", "y0", "z0", "x1", "y1", "z1").distinct())


@query(
    f"""WITH {VOXELS}, r AS (SELECT x, y, z FROM vox WHERE density_milli >= 60), o AS (
  SELECT a.i, b.j, c.k FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS j) b, (SELECT unnest(range(-2, 3)) AS k) c WHERE i*i + j*j + k*k <= 4)
SELECT DISTINCT CAST(x + i AS INT) AS x, CAST(y + j AS INT) AS y, CAST(z + k AS INT) AS z FROM r, o"""
)
def dilate_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.dilate(voxels(spark, sf_dir).filter("density_milli >= 60").select("x", "y", "z"), 2.0)


STEPS = ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1), (1, -1, 0), (1, 0, -1))
_STEPS = ",".join(map(str, STEPS))


@query(
    f"""WITH {VOXELS}, r AS (SELECT x, y, z FROM vox WHERE density_milli >= 50), o(i, j, k) AS (VALUES {_STEPS})
SELECT a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM r a, o JOIN r b ON b.x = a.x + i AND b.y = a.y + j AND b.z = a.z + k"""
)
def truss_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.lattice_edges(voxels(spark, sf_dir).filter("density_milli >= 50"), STEPS)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as axis-parallel boxes of 12 triangles each."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("mesh"),
        (F.col("s_suppkey") % 9).cast("double").alias("lx"), (F.col("s_nationkey") % 7).cast("double").alias("ly"), (F.col("s_suppkey") % 5).cast("double").alias("lz"),
    )
    s = s.withColumns({"hx": F.col("lx") + 3.3, "hy": F.col("ly") + 2.7, "hz": F.col("lz") + 4.0 + F.col("mesh") % 3})
    corner = lambda b: [F.col(f"{'h' if b >> i & 1 else 'l'}{a}") for i, a in enumerate("xyz")]
    tris = [t for q in ((0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)) for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    rows = [F.struct(*[c.alias(f"{v}{a}") for v, b in zip("abc", t, strict=True) for a, c in zip("xyz", corner(b), strict=True)]) for t in tris]
    return s.select("mesh", F.explode(F.array(*rows)).alias("t")).select("mesh", "t.*")


@query(
    """WITH b AS (SELECT s_suppkey AS mesh, CAST(s_suppkey % 9 AS INT) AS lx, CAST(s_nationkey % 7 AS INT) AS ly, CAST(s_suppkey % 5 AS INT) AS lz, 4 + CAST(s_suppkey % 3 AS INT) AS h FROM supplier)
SELECT mesh, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM b, (SELECT unnest(range(0, 14)) AS x), (SELECT unnest(range(0, 12)) AS y), (SELECT unnest(range(0, 16)) AS z)
WHERE x + 0.5 > lx AND x + 0.5 < lx + 3.3 AND y + 0.5 > ly AND y + 0.5 < ly + 2.7 AND z + 0.5 > lz AND z + 0.5 < lz + h"""
)
def parity_voxelize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.parity_fill(_boxes(spark, sf_dir), 16)


@query(
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]) AS e FROM lineitem),
b AS (SELECT l_extendedprice AS v, CASE WHEN l_extendedprice < e[2] THEN 0 WHEN l_extendedprice < e[3] THEN 1 WHEN l_extendedprice < e[4] THEN 2
        WHEN l_extendedprice < e[5] THEN 3 WHEN l_extendedprice < e[6] THEN 4 ELSE 5 END AS band FROM lineitem, q)
SELECT CAST(band AS INT) AS band, count(*) AS n, round(min(v), 4) AS low, round(max(v), 4) AS high, round(avg(v), 3) AS mean FROM b GROUP BY 1"""
)
def quantile_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    edges = bands.quantiles(li, "l_extendedprice", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
    banded = li.withColumn("band", bands.band_of("l_extendedprice", edges)).filter("band IS NOT NULL")
    v = F.col("l_extendedprice")
    return banded.groupBy("band").agg(F.count("*").alias("n"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"), F.round(F.avg(v), 3).alias("mean"))


@query(
    _NEAREST
    + """
SELECT seed_id, count(*) AS n_points FROM n GROUP BY seed_id"""
)
def seed_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.nearest_seed(points(spark, sf_dir, False), points(spark, sf_dir, True))
    return near.groupBy("seed_id").agg(F.count("*").alias("n_points"))


@query(
    _DRAWS.replace("SELECT s_suppkey, k, x, y, z FROM d JOIN c ON ", "")
    + """, h AS (SELECT s_suppkey AS seed_id, x + 0.5 AS x, y + 0.5 AS y, z + 0.5 AS z FROM d JOIN c ON high - w <= r AND r < high),
m AS (SELECT v.x AS vx, v.y AS vy, v.z AS vz, density_milli, seed_id FROM vox v, h
      QUALIFY row_number() OVER (PARTITION BY v.x, v.y, v.z ORDER BY pow(v.x + 0.5 - h.x, 2) + pow(v.y + 0.5 - h.y, 2) + pow(v.z + 0.5 - h.z, 2), seed_id) = 1)
SELECT seed_id, count(*) AS voxels, CAST(sum(density_milli) AS BIGINT) AS mass FROM m GROUP BY seed_id"""
)
def density_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field to cells: probabilities, weighted seeds, nearest-seed labels, cell masses."""
    vox = keyed_voxels(spark, sf_dir)
    drawn = _sample(spark, sf_dir, True)
    seeds = drawn.select(F.col("s_suppkey").alias("seed_id"), *[(F.col(a) + 0.5).alias(a) for a in "xyz"])
    near = neighbours.nearest_seed(vox.select(F.col("k").alias("point_id"), *[(F.col(a) + 0.5).alias(a) for a in "xyz"]), seeds)
    return near.join(vox.select(F.col("k").alias("point_id"), "density_milli"), "point_id").groupBy("seed_id").agg(F.count("*").alias("voxels"), F.sum("density_milli").alias("mass"))


@query(
    f"""WITH {VOXELS}, b AS (SELECT x, y, z FROM vox WHERE density_milli >= 30), d AS (SELECT x, y, z FROM vox WHERE density_milli >= 60), t AS (SELECT max(z) AS top FROM d),
f AS (SELECT DISTINCT x, y FROM d, t WHERE z >= top - 2)
SELECT x, y, z FROM b JOIN f USING (x, y), t WHERE z BETWEEN top - 5 AND top"""
)
def contact_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels under the footprint of the topmost dense layers, within five layers of the top."""
    vox = voxels(spark, sf_dir)
    dense = vox.filter("density_milli >= 60")
    top = dense.agg(F.max("z")).first()[0]
    if top is None:
        return vox.select("x", "y", "z").limit(0)
    foot = dense.filter(F.col("z") >= top - 2).select("x", "y")
    return vox.filter("density_milli >= 30").filter(F.col("z").between(top - 5, top)).join(foot, ["x", "y"], "left_semi").select("x", "y", "z")


@query(
    f"""WITH {VOXELS}, l AS (SELECT x, y, z, density_milli % 23 AS label FROM vox),
n AS (SELECT a.label AS la, b.label AS lb FROM l a JOIN l b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z
  UNION ALL SELECT a.label, b.label FROM l a JOIN l b ON b.x = a.x AND b.y = (a.y + 1) % {NY} AND b.z = a.z
  UNION ALL SELECT a.label, b.label FROM l a JOIN l b ON b.x = a.x AND b.y = a.y AND b.z = a.z + 1),
d AS (SELECT DISTINCT la AS label, lb AS other FROM n WHERE la <> lb UNION SELECT DISTINCT lb, la FROM n WHERE la <> lb)
SELECT label, count(*) AS degree, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS neighbours FROM d GROUP BY label"""
)
def label_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct neighbours of each label; the y axis wraps."""
    vox = voxels(spark, sf_dir).withColumn("label", F.col("density_milli") % 23)
    pairs = grid.adjacent_labels(vox, "label", (NX, NY, NZ), (False, True, False))
    both = pairs.select(F.col("a").alias("label"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    # as many as there are labels
    listed = F.array_sort(F.collect_set("other"))
    return both.groupBy("label").agg(F.count("*").alias("degree"), F.array_join(F.transform(listed, lambda v: v.cast("string")), ",").alias("neighbours"))


@query()
def uniform_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of the unit cube for each supplier, in order of its key, from the one seeded stream."""
    placed = dense_index(table(spark, sf_dir, "supplier").select("s_suppkey"), [F.col("s_suppkey")], "n")
    return sampling.uniform_stream(placed, "n", 42).drop("n")
