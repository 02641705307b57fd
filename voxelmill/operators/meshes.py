"""Triangle meshes: smoothed fields, level surfaces, tubes, and their encoders' inputs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import offsets

CORNERS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]


def smooth(vox: DataFrame, value: str, sigma: float) -> DataFrame:
    """Gaussian of a sparse field, one axis at a time, cut at four sigma; absent voxels are 0."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = vox.select("x", "y", "z", F.col(value).cast("double").alias("v"))
    for axis in "xyz":
        spread = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in zip(range(-reach, reach + 1), weights, strict=True)]))
        sent = out.withColumn("o", spread).withColumn(axis, F.col(axis) + F.col("o.d"))
        out = sent.groupBy("x", "y", "z").agg(F.sum(F.col("v") * F.col("o.w")).alias("v"))
    return out.withColumnRenamed("v", value)


def _tetrahedra() -> list[list[int]]:
    """The six tetrahedra of a cube, one for each order of its axes, by corner number."""
    number = {c: n for n, c in enumerate(CORNERS)}
    out = []
    for order in permutations(range(3)):
        at, path = [0, 0, 0], [number[0, 0, 0]]
        for axis in order:
            at[axis] = 1
            path.append(number[tuple(at)])
        out.append(path)
    return out


def level_surface(vox: DataFrame, value: str, level: float) -> DataFrame:
    """Triangles (ax..cz), wound outward, of the surface on which a sparse field
    takes `level`; absent voxels are 0, so closed surfaces stay closed. Each
    voxel goes to the eight cubes it is a corner of; cubes are cut into
    tetrahedra, which have one or two triangles each."""
    sent = vox.select("x", "y", "z", F.col(value).cast("double").alias("v"), F.explode(offsets([(-i, -j, -k) for i, j, k in CORNERS])).alias("o"))
    corner = -(F.col("o.i") * 4 + F.col("o.j") * 2 + F.col("o.k"))
    cubes = sent.groupBy((F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), (F.col("z") + F.col("o.k")).alias("z"))
    cubes = cubes.agg(*[F.coalesce(F.max(F.when(corner == n, F.col("v"))), F.lit(0.0)).alias(f"v{n}") for n in range(8)])
    v = [F.col(f"v{n}") for n in range(8)]
    crossed = cubes.filter((F.greatest(*v) > level) & (F.least(*v) <= level))
    tets, corners = np.array(_tetrahedra()), np.array(CORNERS, float)
    names = [f"{p}{a}" for p in "abc" for a in "xyz"]

    def march(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = batch[["x", "y", "z"]].to_numpy(float)
            values = batch[[f"v{n}" for n in range(8)]].to_numpy()
            found = []
            for tet in tets:
                val, at = values[:, tet], base[:, None, :] + corners[tet][None]
                inside = val > level
                for n_in in (1, 2, 3):
                    rows = np.flatnonzero(inside.sum(1) == n_in)
                    if not len(rows):
                        continue
                    order = np.argsort(~inside[rows], axis=1, kind="stable")
                    p = np.take_along_axis(at[rows], order[:, :, None], 1)
                    w = np.take_along_axis(val[rows], order, 1)
                    edge = lambda i, j: p[:, i] + (p[:, j] - p[:, i]) * ((level - w[:, i]) / (w[:, j] - w[:, i]))[:, None]  # noqa: B023, E731
                    if n_in == 1:
                        tris = [(edge(0, 1), edge(0, 2), edge(0, 3))]
                    elif n_in == 3:
                        tris = [(edge(0, 3), edge(1, 3), edge(2, 3))]
                    else:
                        a, b, c, d = edge(0, 2), edge(0, 3), edge(1, 3), edge(1, 2)
                        tris = [(a, b, c), (a, c, d)]
                    outward = p[:, n_in:].mean(1) - p[:, :n_in].mean(1)
                    for a, b, c in tris:
                        flip = (np.cross(b - a, c - a) * outward).sum(1) < 0
                        b, c = np.where(flip[:, None], c, b), np.where(flip[:, None], b, c)
                        found.append(np.concatenate([a, b, c], axis=1))
            yield pd.DataFrame(np.concatenate(found) if found else np.empty((0, 9)), columns=names)

    return crossed.mapInPandas(march, ", ".join(f"{n} double" for n in names))


def tubes(edges: DataFrame, id: str, radius: float, sides: int, cycles: float = 0.0, amplitude: float = 0.0) -> DataFrame:
    """Ring points (id, ring, side, x, y, z) of tubes along segments (x0..z1):
    straight for no cycles, else about a helix whose radius swells from and to
    the ends. A tube has max(72, ceil(36 cycles)) rings, a straight one two.
    Segments of no length have none."""
    rings = max(72, math.ceil(36 * cycles)) if cycles else 2
    names = [f"{a}{e}" for e in "01" for a in "xyz"]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.linspace(0.0, 1.0, rings)
        angle = 2 * np.pi * np.arange(sides) / sides
        swell = amplitude * np.sin(np.pi * t) ** 2
        across = swell[:, None] * np.stack([np.cos(2 * np.pi * cycles * t), np.sin(2 * np.pi * cycles * t)], axis=1)
        norm = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
        for batch in batches:
            for begin in range(0, len(batch), 256):
                some = batch.iloc[begin : begin + 256]
                e = some[names].to_numpy(float)
                keep = np.linalg.norm(e[:, 3:] - e[:, :3], axis=1) > 1e-12
                e, keys = e[keep], some[id].to_numpy()[keep]
                if not len(e):
                    continue
                p, axis = e[:, :3], e[:, 3:] - e[:, :3]
                w = norm(axis)
                u = norm(np.cross(w, np.eye(3)[np.argmin(np.abs(w), axis=1)]))
                v = np.cross(w, u)
                centre = p[:, None] + t[None, :, None] * axis[:, None] + across[None, :, :1] * u[:, None] + across[None, :, 1:] * v[:, None]
                tangent = norm(np.gradient(centre, axis=1))
                n, frames = u, []
                for k in range(rings):  # carried along: each is the last one made normal to the tangent
                    n = norm(n - (n * tangent[:, k]).sum(1, keepdims=True) * tangent[:, k])
                    frames.append(n)
                n = np.stack(frames, axis=1)
                b = np.cross(tangent, n)
                around = np.cos(angle)[:, None] * n[:, :, None] + np.sin(angle)[:, None] * b[:, :, None]
                xyz = (centre[:, :, None] + radius * around).reshape(-1, 3)
                ring, side = np.divmod(np.arange(rings * sides), sides)
                yield pd.DataFrame(
                    {"id": np.repeat(keys, rings * sides), "ring": np.tile(ring, len(e)), "side": np.tile(side, len(e)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}
                )

    return edges.select(id, *names).mapInPandas(build, "id long, ring int, side int, x double, y double, z double")


def tube_triangles(rings: DataFrame, sides: int) -> DataFrame:
    """Two triangles (id, ax..cz) for each pair of neighbouring ring points."""
    here = rings.select("id", "ring", "side", F.struct("x", "y", "z").alias("p"))
    moved = lambda dr, ds, n: here.select("id", (F.col("ring") - dr).alias("ring"), F.pmod(F.col("side") - ds, F.lit(sides)).alias("side"), F.col("p").alias(n))
    keys = ["id", "ring", "side"]
    quad = here.join(moved(1, 0, "up"), keys).join(moved(0, 1, "next"), keys).join(moved(1, 1, "both"), keys)
    pair = F.array(F.struct(F.col("p").alias("a"), F.col("next").alias("b"), F.col("both").alias("c")), F.struct(F.col("p").alias("a"), F.col("both").alias("b"), F.col("up").alias("c")))
    t = quad.select("id", F.explode(pair).alias("t"))
    return t.select("id", *[F.col(f"t.{v}.{a}").alias(f"{v}{a}") for v in "abc" for a in "xyz"])


def mesh_summary(triangles: DataFrame, group: list[str]) -> DataFrame:
    """Triangles, area and enclosed volume by group."""
    d = lambda p, q, a: F.col(f"{p}{a}") - F.col(f"{q}{a}")
    n = [d("b", "a", p) * d("c", "a", q) - d("b", "a", q) * d("c", "a", p) for p, q in (("y", "z"), ("z", "x"), ("x", "y"))]
    area = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2
    volume = (F.col("ax") * n[0] + F.col("ay") * n[1] + F.col("az") * n[2]) / 6
    return triangles.groupBy(*group).agg(F.count("*").alias("triangles"), F.sum(area).alias("area"), F.sum(volume).alias("volume"))


def index_vertices(triangles: DataFrame, scale: float = 1e7) -> DataFrame:
    """Distinct corner points of triangles, numbered without gaps in order of
    their keys: vertex, x, y, z."""
    from .prefix import dense_index

    corners = F.array(*[F.struct(*[F.col(f"{v}{a}").alias(a) for a in "xyz"]) for v in "abc"])
    p = triangles.select(F.explode(corners).alias("p")).select("p.*")
    keys = [F.rint(F.col(a) * scale).cast("long").alias(f"k{a}") for a in "xyz"]
    first = p.groupBy(*keys).agg(F.min(F.struct("x", "y", "z")).alias("p"))
    return dense_index(first, [F.col("kx"), F.col("ky"), F.col("kz")], "vertex").select("vertex", "p.*")
