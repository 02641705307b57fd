"""Certified neighbours of seeds in a Voronoi diagram of any size, in a box.

Space is cut in cubes. In each round a seed whose cell isn't certain yet meets
the seeds of its own cube and the 26 about it; its cell is clipped by them,
nearest first, and is certain once every seed that it hasn't met lies farther
from each vertex than it does. What touches a certain cell is its neighbour list.

Cubes begin so small that none holds many seeds, however uneven a diagram is,
and double each round. Being neighbours is mutual: a certain cell can only bear
upon another one that it names. So a seed meets, from then on, the seeds that
aren't certain either and those that name it, and dense regions, once settled,
are never met again.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, tasks
from .neighbours import AXES, bisector

Box = tuple[tuple[float, float, float], tuple[float, float, float]]
#: A plane that comes as close to a cell, measured in the box's diagonal, touches it.
TOUCH = 1e-9
MOST_A_CUBE = 128
#: Groups of so many seeds, fewer than 27 cubes may hold, are met whole in the first round.
WHOLE = 1024


class Cell:
    """A convex cell about the origin as vertices, each of three planes in one
    sense of rotation; planes are n p <= r, the first six those of the box."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.normals: list = [s * np.eye(3)[a] for a in range(3) for s in (-1.0, 1.0)]
        self.tol = 1e-12 * float(np.linalg.norm(high - low))
        self.ids, self.triples, self.twin, self.made = [], {}, {}, 0
        corners = list(product((0, 1), repeat=3))
        for signs in corners:
            planes = [2 * a + s for a, s in enumerate(signs)]
            self._add(tuple(planes if sum(signs) % 2 else planes[::-1]))
        self.points = np.array([[(low, high)[s][a] for a, s in enumerate(signs)] for signs in corners])
        self.reach = float(np.sqrt((self.points**2).sum(1).max()))

    def _add(self, triple: tuple[int, int, int]) -> None:
        """A vertex with the next number; its place goes to points, in the order of ids."""
        a, b, c = triple
        self.twin[a, b] = self.twin[b, c] = self.twin[c, a] = self.made
        self.triples[self.made] = triple
        self.ids.append(self.made)
        self.made += 1

    def clip(self, normal: np.ndarray, rhs: float) -> bool:
        """Take away what is beyond a plane; whether there was anything."""
        side = (self.points @ normal - rhs) / np.linalg.norm(normal)
        beyond = side > self.tol
        gone = np.flatnonzero(beyond).tolist()
        if not gone or len(gone) == len(side):
            return False
        number = len(self.normals)
        self.normals.append(normal)
        lost, away, fresh, ends = {self.ids[k] for k in gone}, {self.ids[k]: k for k in range(len(side))}, [], []
        for u in gone:
            t = self.triples[self.ids[u]]
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                w = self.twin[b, a]
                if w not in lost:  # the edge between planes a and b is cut
                    fresh.append((a, b, number))
                    ends.append((u, away[w]))
        for k in lost:
            del self.triples[k]
        kept = ~beyond
        self.ids = [i for i, stays in zip(self.ids, kept.tolist(), strict=True) if stays]
        u, w = np.array(ends, np.int64).reshape(-1, 2).T
        share = side[u] / (side[u] - side[w])
        made = self.points[u] + (self.points[w] - self.points[u]) * share[:, None]
        for triple in fresh:
            self._add(triple)
        self.points = np.concatenate([self.points[kept], made])
        self.reach = float(np.sqrt((self.points**2).sum(1).max()))
        return True

    def clip_all(self, near: np.ndarray, d2: np.ndarray) -> list[int]:
        """Clip by the bisectors with places near, squared distances d2, nearest
        first; the positions of those that took something away. Places are looked
        at many at a time, for the first one that still cuts."""
        with np.errstate(divide="ignore", invalid="ignore"):
            length = np.sqrt(d2)
            unit, half = near / length[:, None], length / 2
        cutting, at, many = [], int(np.searchsorted(d2, 0.0, side="right")), 4
        while at < len(d2) and d2[at] <= 4 * self.reach**2 * (1 + 1e-9):
            side = (unit[at : at + many] @ self.points.T).max(1) - half[at : at + many]
            first = np.flatnonzero(side > self.tol)
            if not len(first):
                at, many = at + many, min(2 * many, 4096)
                continue
            at += int(first[0])
            if d2[at] > 4 * self.reach**2 * (1 + 1e-9):
                break
            if self.clip(near[at], d2[at] / 2):
                cutting.append(at)
            at, many = at + 1, max(4, many // 2)
        return cutting

    def faces(self) -> list[tuple[int, np.ndarray]]:
        """Each plane that has a face, with its corners in order about the outward normal."""
        where = {i: k for k, i in enumerate(self.ids)}
        start = {}
        for i in self.ids:
            for plane in self.triples[i]:
                start.setdefault(plane, i)
        out = []
        for plane in sorted(start):
            loop, i = [], start[plane]
            while not loop or i != start[plane]:
                loop.append(where[i])
                t = self.triples[i]
                before = t[t.index(plane) - 1]
                # the edge between a plane and the one before it in a vertex' turn ends where they stand the other way round
                i = self.twin[plane, before]
                if len(loop) > len(self.ids):
                    raise ValueError("a face does not close")
            out.append((plane, self.points[loop]))
        return out


def neighbours_of(me: np.ndarray, others: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, Cell]:
    """(positions of those of others that touch the cell of me, whether each
    shares a face of some size with it, the cell about me as the origin)."""
    near = others - me
    d2 = (near**2).sum(1)
    cell = Cell(low - me, high - me)
    order = np.argsort(d2, kind="stable")
    cell.clip_all(near[order], d2[order])
    met = order[(d2[order] > 0) & (d2[order] <= 4 * cell.reach**2 * (1 + 1e-6))]
    tol = TOUCH * float(np.linalg.norm(high - low))
    length = np.sqrt(d2[met])
    gap = (near[met] / length[:, None]) @ cell.points.T - (length / 2)[:, None]
    touching = gap.max(1, initial=-np.inf) >= -tol
    corners = [len({tuple(p) for p in np.rint(cell.points[np.abs(g) <= tol] / (10 * tol)).astype(np.int64).tolist()}) for g in gap[touching]]
    return met[touching], np.array(corners, np.int64) >= 3, cell


def settled(me: np.ndarray, cell: Cell, size: float, low: np.ndarray, high: np.ndarray) -> bool:
    """Whether no seed outside the 27 cubes about me can touch its cell: it would
    lie as near to a vertex as me, and in the box."""
    home = np.floor(me / size)
    corners = cell.points + me
    far = np.sqrt((cell.points**2).sum(1))[:, None] * (1 + 1e-6)
    first, last = (home - 1) * size, (home + 2) * size
    margin = 1e-9 * size
    return bool((((first <= low) | (corners - far >= first + margin)) & ((last >= high) | (corners + far <= last - margin))).all())


NAMED = "array<struct<neighbour_id:bigint,face:boolean,nx:double,ny:double,nz:double>>"


def _cubes(edge: Column) -> list[Column]:
    return [F.floor(F.col(a) / edge).cast("long").alias(f"c{a}") for a in AXES]


def start_edges(placed: DataFrame, most: int = MOST_A_CUBE) -> DataFrame:
    """(g, edge, wide): an edge for each group so that no cube holds more than
    `most` seeds, but for groups of at most WHOLE, and one that spans the group."""
    ends = [f(a).alias(f"{n}{a}") for a in AXES for n, f in (("l", F.min), ("h", F.max))]
    sizes = placed.groupBy("g").agg(F.count("*").alias("n"), *ends)
    sides = [F.col(f"h{a}") - F.col(f"l{a}") for a in AXES]
    wide = F.greatest(*sides, F.lit(1e-9))
    volume = F.greatest(sides[0], wide * 1e-3) * F.greatest(sides[1], wide * 1e-3) * F.greatest(sides[2], wide * 1e-3)
    small = F.col("n") <= WHOLE
    edge = F.when(small, 2 * wide).otherwise(F.pow(volume * (most / 4) / F.col("n"), F.lit(1 / 3)))
    edges = cut(sizes.select("g", edge.alias("edge"), wide.alias("wide"), small.alias("ok")))
    for _ in range(200):
        if edges.filter("NOT ok").isEmpty():
            break
        fullest = placed.join(edges.filter("NOT ok"), "g").groupBy("g", *_cubes(F.col("edge"))).count().groupBy("g").agg(F.max("count").alias("top"))
        new = edges.join(fullest, "g", "left").withColumn("fits", F.coalesce(F.col("top") <= most, F.lit(True)))
        # an edge far below the group's size can't part seeds any more: they are at one place but for rounding
        small = F.col("edge") <= F.col("wide") * 1e-12
        edges = cut(new.select("g", F.when(F.col("ok") | F.col("fits") | small, F.col("edge")).otherwise(F.col("edge") / 2).alias("edge"), "wide", (F.col("ok") | F.col("fits") | small).alias("ok")))
    return edges.select("g", "edge", "wide")


def box_about(seeds: DataFrame, least: Box | None = None, margin: float = 0.02) -> Box:
    """A box that holds all seeds, a little wider than they lie, and the box `least`."""
    ends = seeds.agg(*[f(F.col(a).cast("double")) for a in AXES for f in (F.min, F.max)]).first()
    low, high = (np.array([ends[2 * k + n] if ends[0] is not None else n for k in range(3)], float) for n in (0, 1))
    wide = max((high - low).max() * margin, 1e-9)
    low, high = low - wide, high + wide
    if least:
        low, high = np.minimum(low, least[0]), np.maximum(high, least[1])
    return tuple(low.tolist()), tuple(high.tolist())


def neighbour_graph(seeds: DataFrame, group: str, box: Box, max_rounds: int = 64) -> DataFrame:
    """(group, seed_id, neighbour_id, face, nx, ny, nz): the neighbours of each
    seed (group, seed_id, x, y, z) in the diagram of its group, cut at the box;
    face: whether they share more than a point or an edge; nx, ny, nz: where
    the neighbour is from the seed.

    Every pair comes in both directions. Seeds at the place of another one of
    their group are no neighbours of it and have the same neighbours; a seed
    alone has none; a seed outside the box is an error. Null groups are a group. A task
    holds the seeds of 27 cubes: at most 27 x MOST_A_CUBE (or WHOLE) at first, later those
    that aren't certain yet. Choose a box that fits the seeds: cells at the rim
    reach to the box.
    """
    low, high = (np.array(b, float) for b in box)
    kind = seeds.schema[group].dataType.simpleString()
    every = seeds.select(F.col(group).alias("own"), F.col("seed_id").cast("long").alias("seed_id"), *[F.col(a).cast("double").alias(a) for a in AXES])
    key = F.concat(F.when(F.col("own").isNull(), "-").otherwise("+"), F.coalesce(F.col("own").cast("string"), F.lit("")))
    placed = every.withColumn("g", key)
    edges = start_edges(placed)
    placed = cut(placed.join(edges, "g"))
    ring = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, s, strict=True)]) for s in product((-1, 0, 1), repeat=3)])
    cube = ["g", *[f"c{a}" for a in AXES]]
    state = "seed_id long, x double, y double, z double, edge double, wide double, certain boolean, named " + NAMED

    def kernel(homes: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out, names = [], ["nx", "ny", "nz"]
        points, ids = met[[f"o{a}" for a in AXES]].to_numpy(float), met["o_id"].to_numpy()
        for own in homes.itertuples(index=False):
            me = np.array([own.x, own.y, own.z])
            if (me < low).any() or (me > high).any():
                raise ValueError(f"seed {own.seed_id} at {me.tolist()} is outside the box")
            told = own.told if own.told is not None else []
            extra = np.array([[t["x"], t["y"], t["z"]] for t in told], float).reshape(-1, 3)
            others, other_ids = np.concatenate([points, extra]), np.concatenate([ids, np.array([t["seed_id"] for t in told], np.int64)])
            keep = other_ids != own.seed_id
            others, other_ids = others[keep], other_ids[keep]
            at, face, cell = neighbours_of(me, others, low, high)
            sure = own.size >= 2 * own.wide or settled(me, cell, own.size, low, high)
            named = [{"neighbour_id": int(other_ids[k]), "face": bool(f)} | dict(zip(names, (others[k] - me).tolist(), strict=True)) for k, f in zip(at.tolist(), face.tolist(), strict=True)]
            out.append((own.g, own.seed_id, own.x, own.y, own.z, own.edge, own.wide, sure, named if sure else []))
        return pd.DataFrame(out, columns=["g", "seed_id", *AXES, "edge", "wide", "certain", "named"])

    at = ["g", "seed_id", *AXES, "edge", "wide"]
    open_, told, done, left = placed.select(*at), None, [], placed.count()
    for k in range(max_rounds):
        size = (F.col("edge") * 2.0**k).alias("size")
        homes = open_.withColumn("size", size).select(*at, "size", *_cubes(F.col("size")))
        shown = homes.select("g", "seed_id", *AXES, F.explode(ring).alias("o"), *[f"c{a}" for a in AXES])
        shown = shown.select(F.col("g").alias("g"), F.col("seed_id").alias("o_id"), *[F.col(a).alias(f"o{a}") for a in AXES], *[(F.col(f"c{a}") + F.col(f"o.d{a}")).alias(f"c{a}") for a in AXES])
        asked = shown.join(homes.select(*[F.col(c).alias(c) for c in cube]).distinct(), cube, "left_semi")
        if told is None:
            homes = homes.withColumn("told", F.lit(None).cast("array<struct<seed_id:bigint,x:double,y:double,z:double>>"))
        else:
            homes = homes.join(told, ["g", "seed_id"], "left")
        parts = tasks(placed, left)
        homes, asked = homes.repartition(parts, *cube), asked.repartition(parts, *cube)
        built = cut(homes.groupBy(*cube).cogroup(asked.groupBy(*cube)).applyInPandas(kernel, f"g string, {state}"))
        ready = built.filter("certain")
        done.append(ready)
        open_ = built.filter("NOT certain").select(*at)
        left = open_.count()
        if not left:
            break
        # what certain cells say about those that aren't
        said = ready.select("g", F.col("seed_id").alias("from"), *[F.col(a).alias(f"f{a}") for a in AXES], F.explode("named").alias("t"))
        said = said.select("g", F.col("t.neighbour_id").alias("seed_id"), F.struct(F.col("from").alias("seed_id"), *[F.col(f"f{a}").alias(a) for a in AXES]).alias("s"))
        told_now = said.join(open_.select("g", "seed_id"), ["g", "seed_id"], "left_semi")
        if told is not None:
            told_now = told_now.unionByName(told.select("g", "seed_id", F.explode("told").alias("s")).join(open_.select("g", "seed_id"), ["g", "seed_id"], "left_semi"))
        told = cut(told_now.groupBy("g", "seed_id").agg(F.collect_list("s").alias("told")))
    else:
        raise RuntimeError("some cells did not become certain")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    pairs = found.select("g", "seed_id", F.explode("named").alias("t")).select("g", "seed_id", "t.*")
    turned = pairs.select("g", F.col("neighbour_id").alias("seed_id"), F.col("seed_id").alias("neighbour_id"), "face", *[(-F.col(f"n{a}")).alias(f"n{a}") for a in AXES])
    both = pairs.unionByName(turned).groupBy("g", "seed_id", "neighbour_id").agg(F.max("face").alias("face"), *[F.first(f"n{a}").alias(f"n{a}") for a in AXES])
    own = F.when(F.col("g").startswith("+"), F.substring("g", 2, 1 << 30)).cast(kind)
    return both.select(own.alias(group), "seed_id", "neighbour_id", "face", "nx", "ny", "nz")


def bisectors(graph: DataFrame, seeds: DataFrame, group: str) -> DataFrame:
    """The half-spaces n p <= rhs of each pair of the graph, as neighbours.halfspaces gives them for all pairs."""
    side = lambda p, id: seeds.select(group, F.col("seed_id").alias(id), *[F.col(a).cast("double").alias(f"{p}{a}") for a in AXES])
    t = graph.select(group, "seed_id", "neighbour_id").join(side("a", "seed_id"), [group, "seed_id"]).join(side("b", "neighbour_id"), [group, "neighbour_id"])
    return t.select(group, "seed_id", "neighbour_id", *bisector())
