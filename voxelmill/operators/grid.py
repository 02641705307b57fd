"""Grid operators on sparse voxel tables: stencils, blocks, resampling, rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def offsets(steps) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in steps])


def block_mean(vox: DataFrame, value: str, block: tuple[int, int, int] = (4, 4, 2)) -> DataFrame:
    """Mean and count of `value` over blocks of voxels; blocks without voxels are absent."""
    keys = [F.floor(F.col(a) / b).cast("long").alias(f"b{a}") for a, b in zip("xyz", block, strict=True)]
    return vox.groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def surface(vox: DataFrame) -> DataFrame:
    """Occupied voxels (x, y, z) with a free face neighbour. Each voxel is sent
    to itself and its six neighbours and the arrivals are counted: one shuffle."""
    sent = vox.select("x", "y", "z", F.explode(offsets(((0, 0, 0), *FACES))).alias("o"))
    own = (F.col("o.i") == 0) & (F.col("o.j") == 0) & (F.col("o.k") == 0)
    cells = sent.select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("z") + F.col("o.k")).alias("z"), own.cast("int").alias("own"))
    return cells.groupBy("x", "y", "z").agg(F.max("own").alias("own"), F.count("*").alias("n")).filter("own = 1 AND n < 7").select("x", "y", "z")


def adjacent_labels(vox: DataFrame, label: str, sizes: tuple[int, int, int], periodic: tuple[bool, bool, bool]) -> DataFrame:
    """Distinct unordered pairs of labels on face neighbours, with their number
    of contacts; axes wrap where periodic."""
    here = vox.select("x", "y", "z", F.col(label).alias("la"), F.explode(offsets(FACES[::2])).alias("o"))
    step = lambda a, o, n, wrap: F.pmod(F.col(a) + F.col(f"o.{o}"), F.lit(n)) if wrap else F.col(a) + F.col(f"o.{o}")
    moved = here.select(*[step(a, o, n, w).cast("int").alias(a) for a, o, n, w in zip("xyz", "ijk", sizes, periodic, strict=True)], "la")
    there = vox.select(*[F.col(a).cast("int").alias(a) for a in "xyz"], F.col(label).alias("lb"))
    met = moved.join(there, ["x", "y", "z"]).filter("la <> lb")
    return met.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("contacts"))


def trilinear(targets: DataFrame, vox: DataFrame, value: str) -> DataFrame:
    """targets (id, x, y, z in voxel coordinates) with the interpolated value;
    absent voxels count as 0. Eight corners are joined on their keys and summed."""
    corner = F.explode(offsets([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    t = targets.select("id", "x", "y", "z", corner.alias("o"))
    base = {a: F.floor(F.col(a)) for a in "xyz"}
    part = {a: F.col(a) - base[a] for a in "xyz"}
    w = None
    for a, o in zip("xyz", "ijk", strict=True):
        f = F.when(F.col(f"o.{o}") == 1, part[a]).otherwise(1 - part[a])
        w = f if w is None else w * f
    t = t.select("id", *[(base[a] + F.col(f"o.{o}")).cast("int").alias(f"c{a}") for a, o in zip("xyz", "ijk", strict=True)], w.alias("w"))
    v = vox.select(*[F.col(a).cast("int").alias(f"c{a}") for a in "xyz"], F.col(value).alias("__v"))
    return t.join(v, ["cx", "cy", "cz"], "left").groupBy("id").agg(F.sum(F.col("w") * F.coalesce("__v", F.lit(0))).alias("value"))


def rasterise(edges: DataFrame, per_voxel: int = 2) -> DataFrame:
    """Distinct voxels on segments (x0..z0, x1..z1): max(2, ceil(per_voxel * length))
    even samples, ends included, rounded half to even."""
    d = [F.col(f"{a}1").cast("double") - F.col(f"{a}0") for a in "xyz"]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    n = F.greatest(F.lit(2), F.ceil(length * per_voxel).cast("int"))
    t = edges.withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = F.col("s").cast("double") / (F.col("n") - 1)
    return t.select(*[F.rint(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * share).cast("int").alias(a) for a in "xyz"]).distinct()


def ball(radius: float) -> list[tuple[int, int, int]]:
    r = int(radius)
    span = range(-r, r + 1)
    return [(i, j, k) for i in span for j in span for k in span if i * i + j * j + k * k <= radius * radius]


def dilate(vox: DataFrame, radius: float) -> DataFrame:
    """Voxels within `radius` of one of vox."""
    sent = vox.select("x", "y", "z", F.explode(offsets(ball(radius))).alias("o"))
    return sent.select((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("z") + F.col("o.k")).alias("z")).distinct()


def lattice_edges(vox: DataFrame, steps) -> DataFrame:
    """Segments between voxels of vox that are one of `steps` apart, each pair once."""
    sent = vox.select("x", "y", "z", F.explode(offsets(steps)).alias("o"))
    sent = sent.select(*[F.col(a).alias(f"{a}0") for a in "xyz"], *[(F.col(a) + F.col(f"o.{o}")).cast("int").alias(a) for a, o in zip("xyz", "ijk", strict=True)])
    met = sent.join(vox.select(*[F.col(a).cast("int").alias(a) for a in "xyz"]), ["x", "y", "z"])
    return met.select("x0", "y0", "z0", *[F.col(a).alias(f"{a}1") for a in "xyz"]).distinct()


def parity_fill(triangles: DataFrame, nz: int) -> DataFrame:
    """Voxels (x, y, z) inside closed triangle meshes (mesh, ax..cz), by counting
    the hits of the upward ray at each voxel column that lie below its centre.
    A triangle goes only to the columns of its bounding box."""
    lo = lambda a: F.floor(F.least(*[F.col(f"{v}{a}") for v in "abc"]) - 0.5).cast("int")
    hi = lambda a: F.ceil(F.greatest(*[F.col(f"{v}{a}") for v in "abc"]) - 0.5).cast("int")
    t = triangles.withColumn("x", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("y", F.explode(F.sequence(lo("y"), hi("y"))))
    px, py = F.col("x") + 0.5, F.col("y") + 0.5
    det = (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("ay") - F.col("cy"))
    t = t.withColumn("det", det.cast("double")).filter(F.abs("det") >= 1e-10)
    u = ((F.col("by") - F.col("cy")) * (px - F.col("cx")) + (F.col("cx") - F.col("bx")) * (py - F.col("cy"))) / F.col("det")
    v = ((F.col("cy") - F.col("ay")) * (px - F.col("cx")) + (F.col("ax") - F.col("cx")) * (py - F.col("cy"))) / F.col("det")
    t = t.withColumn("u", u).withColumn("v", v).filter("u >= -1e-10 AND v >= -1e-10 AND 1 - u - v >= -1e-10")
    hit = F.col("u") * F.col("az") + F.col("v") * F.col("bz") + (1 - F.col("u") - F.col("v")) * F.col("cz")
    # a hit toggles every voxel of its column whose centre is above it
    first = F.greatest(F.lit(0), F.floor(hit - 0.5).cast("int") + 1)
    above = t.select("mesh", "x", "y", first.alias("f")).filter(F.col("f") < nz)
    cells = above.withColumn("z", F.explode(F.sequence(F.col("f"), F.lit(nz - 1))))
    return cells.groupBy("mesh", "x", "y", "z").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("mesh", "x", "y", "z")
