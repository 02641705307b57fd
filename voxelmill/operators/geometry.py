"""Plane arrangements, cell vertices and periodic inequalities, as joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import first_wins


def plane_triples(planes: DataFrame, cell: list[str], least_det: float = 1e-12) -> DataFrame:
    """Points where three planes (key, nx, ny, nz, rhs) of a cell meet, one for
    each i < j < k, by Cramer's rule. Planes that are nearly parallel give none."""
    side = lambda p: planes.select(*cell, F.col("key").alias(f"{p}k"), *[F.col(f"n{a}").alias(f"{p}{a}") for a in "xyz"], F.col("rhs").alias(f"{p}r"))
    t = side("a").join(side("b"), cell).filter("ak < bk").join(side("c"), cell).filter("bk < ck")
    col = lambda s: [F.col(f"{p}{s}") for p in "abc"]

    def det(u: list[Column], v: list[Column], w: list[Column]) -> Column:
        return u[0] * (v[1] * w[2] - v[2] * w[1]) - v[0] * (u[1] * w[2] - u[2] * w[1]) + w[0] * (u[1] * v[2] - u[2] * v[1])

    x, y, z, r = col("x"), col("y"), col("z"), col("r")
    t = t.withColumn("det", det(x, y, z)).filter(F.abs("det") > least_det)
    return t.select(
        *cell, "ak", "bk", "ck", (det(r, y, z) / F.col("det")).alias("x"), (det(x, r, z) / F.col("det")).alias("y"), (det(x, y, r) / F.col("det")).alias("z")
    )


def cell_vertices(planes: DataFrame, cell: list[str], tol: float = 1e-6, scale: float = 1e5) -> DataFrame:
    """The vertices of each cell: meeting points that violate none of its planes,
    those within 1 / scale made one."""
    points = plane_triples(planes, cell)
    keyed = points.withColumn("pid", F.struct("ak", "bk", "ck"))
    slack = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") - F.col("rhs")
    tested = keyed.join(planes.select(*cell, "nx", "ny", "nz", "rhs"), cell).groupBy(*cell, "pid").agg(F.max(slack).alias("worst"), *[F.first(a).alias(a) for a in "xyz"])
    inside = tested.filter(F.col("worst") <= tol)
    key = [F.rint(F.col(a) * scale).cast("long").alias(f"q{a}") for a in "xyz"]
    return first_wins(inside, [*[F.col(c) for c in cell], *key], ["pid"], ["x", "y", "z"])


def trig_roots(a: Column, b: Column, c: Column) -> Column:
    """Roots of a cos t + b sin t + c in 0..2 pi, as an array of none, one or two."""
    r = F.hypot(a, b)
    two_pi = F.lit(2 * math.pi).cast("double")
    share = F.greatest(F.least(-c / F.when(r > 0, r), F.lit(1.0)), F.lit(-1.0))
    mid, half = F.atan2(b, a), F.acos(share)
    both = F.array(F.pmod(mid - half, two_pi), F.pmod(mid + half, two_pi))
    none = F.array().cast("array<double>")
    return F.when((r <= 1e-12) | (F.abs(c) > r), none).otherwise(F.array_sort(F.array_distinct(both)))


def trig_intervals(rows: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): where all inequalities a cos t + b sin t + c <= 0 of a key
    hold; rows: key, a, b, c. The roots of a key cut the circle, and a piece
    stays if its middle fulfils all."""
    two_pi = 2 * math.pi
    grouped = rows.groupBy(key).agg(F.collect_list(F.struct("a", "b", "c")).alias("f"), F.flatten(F.collect_list(trig_roots(F.col("a"), F.col("b"), F.col("c")))).alias("r"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(two_pi)), F.col("r"))))
    pieces = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(F.element_at("cuts", i).alias("lo"), F.element_at("cuts", i + 1).alias("hi")))
    t = grouped.withColumn("cuts", cuts).select(key, "f", F.explode(pieces).alias("p"))
    mid = (F.col("p.lo") + F.col("p.hi")) / 2
    holds = F.forall("f", lambda q: q["a"] * F.cos(mid) + q["b"] * F.sin(mid) + q["c"] <= 1e-9)
    return t.filter(F.col("p.hi") - F.col("p.lo") > 1e-9).filter(holds).select(key, F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"))


def faces_of(p: list[Column], low: float, high: float, tol: float = 1e-6) -> Column:
    """The names of the cube faces on which a point lies."""
    found = []
    for axis, value in zip("xyz", p, strict=True):
        found.append(F.when(F.abs(value - low) <= tol, F.lit(f"{axis}0")))
        found.append(F.when(F.abs(value - high) <= tol, F.lit(f"{axis}1")))
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def edge_role(a: Column, b: Column) -> Column:
    """Role of an edge by the faces of its ends: two in common, one, one end on
    a face, none."""
    both = F.size(F.array_intersect(a, b))
    return F.when(both >= 2, "cube_edge").when(both == 1, "face_edge").when((F.size(a) > 0) | (F.size(b) > 0), "half_face").otherwise("interior")
