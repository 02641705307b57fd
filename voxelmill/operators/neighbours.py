"""Joins of points with their nearest seeds, over hash grids.

Space is cut in cubes. In each round a point meets the seeds of its own cube and
the 26 about it; its nearest seed is settled once nothing outside can be nearer,
and only unsettled points go on to the next round, with cubes twice as wide. No
pair of far points is made while a nearer seed is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

AXES = ("x", "y", "z")


def _about() -> Column:
    """The 27 cubes about a point."""
    steps = [(i, j, m) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)]
    return F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, s, strict=True)]) for s in steps])


def distance2(a: str, b: str) -> Column:
    return sum((F.power(F.col(f"{a}{c}") - F.col(f"{b}{c}"), 2) for c in AXES[1:]), F.power(F.col(f"{a}x") - F.col(f"{b}x"), 2))


def cube_edge(seeds: DataFrame, per_cube: float = 2.0) -> float:
    """An edge that gives about per_cube seeds a cube."""
    ends = seeds.agg(F.count("*"), *[f(a) for a in AXES for f in (F.min, F.max)]).first()
    sides = [max(ends[2 + 2 * i] - ends[1 + 2 * i], 1e-9) for i in range(3)] if ends[0] else [1.0] * 3
    return max((sides[0] * sides[1] * sides[2] * per_cube / max(1, ends[0])) ** (1 / 3), max(sides) * 1e-3)


def nearest_seed(points: DataFrame, seeds: DataFrame, max_rounds: int = 64, group: list[str] | None = None) -> DataFrame:
    """points (point_id, x, y, z) and seeds (seed_id, x, y, z) to point_id,
    seed_id, d2; with `group`, columns of both, only seeds of the point's group
    count, and points of groups without seeds give no rows. Ties go to the
    smaller seed_id. Without seeds: no rows."""
    own = group or []
    h = cube_edge(seeds)
    placed = cut(seeds.select(*own, F.col("seed_id").cast("long").alias("seed_id"), *[F.col(a).cast("double").alias(f"s{a}") for a in AXES]))
    none = F.lit(None).cast("struct<d2:double,seed_id:bigint>").alias("best")
    open_ = points.select(*own, "point_id", *[F.col(a).cast("double").alias(f"p{a}") for a in AXES], none)
    if placed.isEmpty():
        return open_.select(*own, "point_id", "best.seed_id", "best.d2").limit(0)
    if own:
        open_ = open_.join(placed.select(*own).distinct(), own, "left_semi")
    done = []
    for k in range(max_rounds):
        edge = h * 2.0**k
        cube = lambda p, edge=edge: {a: F.floor(F.col(f"{p}{a}") / edge).cast("long") for a in AXES}
        asked = open_.withColumn("o", F.explode(_about()))
        asked = asked.select(*own, "point_id", *[f"p{a}" for a in AXES], *[(c + F.col(f"o.d{a}")).alias(f"c{a}") for a, c in cube("p").items()])
        there = placed.select("*", *[c.alias(f"c{a}") for a, c in cube("s").items()])
        pair = F.struct(distance2("p", "s").alias("d2"), "seed_id")
        met = asked.join(there, [*own, *[f"c{a}" for a in AXES]]).groupBy("point_id").agg(F.min(pair).alias("new"))
        merged = open_.join(met, "point_id", "left").withColumn("best", F.least("best", "new")).drop("new")
        # how far a point is, at least, from what is outside the 27 cubes
        off = [F.pmod(F.col(f"p{a}"), F.lit(edge)) for a in AXES]
        reach = F.least(*[F.least(o, edge - o) for o in off]) + edge
        merged = cut(merged.withColumn("ok", F.coalesce(F.sqrt("best.d2") < reach * (1 - 1e-9), F.lit(False))))
        done.append(merged.filter("ok").select(*own, "point_id", "best.seed_id", "best.d2"))
        open_ = merged.filter("NOT ok").drop("ok")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError("points are too far from all seeds")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def halfspaces(seeds: DataFrame, group: list[str], most: int | None = None) -> DataFrame:
    """Bisecting half-spaces n.p <= rhs of each seed and the others of its group,
    its `most` nearest if given: group, seed_id, neighbour_id, nx, ny, nz, rhs."""
    left = seeds.select(*group, F.col("seed_id"), *[F.col(a).alias(f"a{a}") for a in AXES])
    right = seeds.select(*group, F.col("seed_id").alias("neighbour_id"), *[F.col(a).alias(f"b{a}") for a in AXES])
    pairs = left.join(right, group).filter("seed_id <> neighbour_id").withColumn("d2", distance2("a", "b"))
    if most is not None:
        near = Window.partitionBy(*group, "seed_id").orderBy("d2", "neighbour_id")
        pairs = pairs.withColumn("__n", F.row_number().over(near)).filter(F.col("__n") <= most)
    return pairs.select(*group, "seed_id", "neighbour_id", *bisector())


def bisector() -> list[Column]:
    """nx, ny, nz, rhs: the half-space n p <= rhs of the places nearer to a than to b (columns ax .. bz)."""
    normals = [(2 * (F.col(f"b{a}") - F.col(f"a{a}"))).alias(f"n{a}") for a in AXES]
    rhs = sum((F.col(f"b{a}") * F.col(f"b{a}") - F.col(f"a{a}") * F.col(f"a{a}") for a in AXES[1:]), F.col("bx") * F.col("bx") - F.col("ax") * F.col("ax"))
    return [*normals, rhs.alias("rhs")]


def members(points: DataFrame, planes: DataFrame, group: list[str], tol: float = 1e-9) -> DataFrame:
    """(point_id, seed_id) where the point violates none of the seed's planes:
    the universal test over a join on the group."""
    value = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") - F.col("rhs")
    tested = points.join(planes, group).groupBy(*group, "point_id", "seed_id").agg(F.max(value).alias("worst"))
    return tested.filter(F.col("worst") <= tol).select(*group, "point_id", "seed_id")
