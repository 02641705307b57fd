"""How the given tables are seen as fields, points, meshes and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import density

NX, NY, NZ = 40, 40, 20
LINES_A_LAYER = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layers(spark: SparkSession, sf_dir: str) -> Column:
    """How many times NZ high the grid is, so that a voxel holds about two lines
    at any size: a scalar of the plan."""
    n = F.floor(F.count("*") / LINES_A_LAYER)
    return table(spark, sf_dir, "lineitem").agg(F.greatest(F.lit(1), n).alias("n")).scalar()


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as mass points on a grid 40 x 40 wide and 20 high for each LINES_A_LAYER lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    z = F.col("l_quantity").cast("int") % NZ + (F.col("l_orderkey") % layers(spark, sf_dir) * NZ).cast("int")
    return density.voxelise(li, F.col("l_partkey") % NX, F.col("l_suppkey") % NY, z, F.col("l_quantity").cast("long"))


def keyed_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxels with k, the place of each in the whole grid."""
    high = layers(spark, sf_dir) * NZ
    return voxels(spark, sf_dir).withColumn("k", density.flat_index(F.col("x"), F.col("y"), F.col("z"), NY, high))


_LAYERS = f"(SELECT greatest(1, count(*) // {LINES_A_LAYER}) FROM lineitem)"
VOXELS = f"""vox AS (
  SELECT CAST(l_partkey % {NX} AS INT) AS x, CAST(l_suppkey % {NY} AS INT) AS y,
         CAST(CAST(trunc(l_quantity) AS INT) % {NZ} + l_orderkey % {_LAYERS} * {NZ} AS INT) AS z,
         CAST(least(1000, sum(CAST(trunc(l_quantity) AS BIGINT))) AS BIGINT) AS density_milli
  FROM lineitem GROUP BY 1, 2, 3)"""
KEYED = f"""{VOXELS}, keyed AS (SELECT *, CAST((CAST(x AS BIGINT) * {NY} + y) * {NZ} * {_LAYERS} + z AS BIGINT) AS k FROM vox)"""


def supplier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seeds about a cylinder, one diagram for each nation."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("g"), k.alias("seed_id"),
        (F.cos(k.cast("double")) * 4.0 + (k % 3)).alias("x"), (F.sin(k.cast("double")) * 4.0 - (k % 5) * 0.5).alias("y"), ((k % 11) * 1.0).alias("z"),
    )


SUPPLIER_SEEDS = """s AS (SELECT CAST(s_nationkey AS VARCHAR) AS g, s_suppkey AS id, cos(s_suppkey::DOUBLE) * 4 + s_suppkey % 3 AS x,
  sin(s_suppkey::DOUBLE) * 4 - (s_suppkey % 5) * 0.5::DOUBLE AS y, (s_suppkey % 11)::DOUBLE AS z FROM supplier)"""


def all_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of every vector, as seeds of its label; of
    vectors at one place the smallest id is the seed."""
    xyz = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    placed = table(spark, sf_dir, "embeddings").select("vec_id", "label", *xyz).filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return placed.groupBy("label", "x", "y", "z").agg(F.min("vec_id").alias("seed_id"))


SCALE, MIDDLE = 16.0, (0.5, -0.5, 5.0)


def label_seeds(spark: SparkSession, sf_dir: str, middle: tuple[float, float, float] = MIDDLE) -> DataFrame:
    """all_seeds as one diagram for each label (g), SCALE times as large about a middle."""
    seeds = all_seeds(spark, sf_dir).filter("label IS NOT NULL")
    return seeds.select(F.col("label").cast("string").alias("g"), "seed_id", *[(F.col(a) * SCALE + m).alias(a) for a, m in zip("xyz", middle, strict=True)])


def label_seeds_sql(middle: tuple[float, float, float] = MIDDLE) -> str:
    place = ", ".join(f"{a} * {SCALE}::DOUBLE + {m}::DOUBLE AS {a}" for a, m in zip("xyz", middle, strict=True))
    xyz = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {a}" for k, a in enumerate("xyz"))
    return f"""s AS (SELECT CAST(label AS VARCHAR) AS g, id, {place} FROM (
  SELECT label, x, y, z, min(vec_id) AS id FROM (SELECT vec_id, label, {xyz} FROM embeddings) WHERE label IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY label, x, y, z))"""


def points(spark: SparkSession, sf_dir: str, seeds: bool) -> DataFrame:
    """The first three components of the vectors; one in 16 is a seed, the others are points."""
    e = table(spark, sf_dir, "embeddings")
    own = F.col("vec_id") % 16 == 0
    xyz = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.filter(own if seeds else ~own).select(F.col("vec_id").alias("seed_id" if seeds else "point_id"), "label", *xyz)


POINTS = """pts AS (
  SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
s AS (SELECT id AS seed_id, label, x, y, z FROM pts WHERE id % 16 = 0),
p AS (SELECT id AS point_id, label, x, y, z FROM pts WHERE id % 16 <> 0)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as segments between two grid points."""
    li = table(spark, sf_dir, "lineitem")
    i = lambda c, n: (F.col(c) % n).cast("int")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        i("l_partkey", 12).alias("x0"), i("l_suppkey", 12).alias("y0"), i("l_linenumber", 12).alias("z0"),
        i("l_orderkey", 12).alias("x1"), ((F.col("l_partkey") + F.col("l_suppkey")) % 12).cast("int").alias("y1"), (F.col("l_quantity").cast("int") % 12).alias("z1"),
    )


SEGMENTS = """seg AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(l_partkey % 12 AS INT) AS x0, CAST(l_suppkey % 12 AS INT) AS y0, CAST(l_linenumber % 12 AS INT) AS z0,
         CAST(l_orderkey % 12 AS INT) AS x1, CAST((l_partkey + l_suppkey) % 12 AS INT) AS y1, CAST(trunc(l_quantity) AS INT) % 12 AS z1
  FROM lineitem)"""
