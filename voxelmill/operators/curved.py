"""Cells of a Voronoi diagram in a hollow cylinder, with their curved boundaries.

A support is a plane (bisector of two seeds, cap, side of a box) or one of the
two cylinders. A cell is what satisfies all its supports. Vertices are points
where three supports meet inside the cell; edges run along the curve of two
supports from vertex to vertex; the edges of one support bound its face. Each
step is a join within a cell, whose supports are as many as its seed has
neighbours. Tables carry the columns of `cell`, which name a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import tasks
from .geometry import plane_triples

ON, INSIDE, PARALLEL = 1e-6, 1e-6, 1e-12
SHELL = ("outer_cylinder", "inner_cylinder", "top_cap", "bottom_cap")
COLUMNS = ("key", "kind", "nx", "ny", "nz", "rhs", "cx", "cy", "radius")


@dataclass(frozen=True)
class HollowCylinder:
    cx: float
    cy: float
    inner: float
    outer: float
    low: float
    high: float

    @classmethod
    def of_grid(cls, xy_size: int, z_size: int, outer: float, inner: float) -> HollowCylinder:
        """The domain of a voxel grid: about the middle, from the first voxels' centres to the last ones'."""
        middle = (xy_size - 1) / 2
        return cls(middle, middle, inner, outer, 0.5, z_size - 0.5)

    @property
    def box(self) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
        return (self.cx - self.outer, self.cy - self.outer, self.low), (self.cx + self.outer, self.cy + self.outer, self.high)

    @property
    def volume(self) -> float:
        return math.pi * (self.outer**2 - self.inner**2) * (self.high - self.low)


def _literal(cells: DataFrame, rows: list[tuple]) -> DataFrame:
    """rows (COLUMNS) for each cell."""
    names = [F.struct(*[F.lit(v).cast("string" if c in ("key", "kind") else "double").alias(c) for c, v in zip(COLUMNS, r, strict=True)]) for r in rows]
    return cells.select(*cells.columns, F.explode(F.array(*names)).alias("s")).select(*cells.columns, "s.*")


def _plane(key: str, normal: tuple[float, float, float], rhs: float) -> tuple:
    return (key, "plane", *normal, rhs, None, None, None)


def shell_supports(cells: DataFrame, d: HollowCylinder) -> DataFrame:
    """The caps and cylinders of each cell."""
    ring = lambda key, radius: (key, "cylinder", None, None, None, None, d.cx, d.cy, radius)
    caps = [_plane("top_cap", (0.0, 0.0, 1.0), d.high), _plane("bottom_cap", (0.0, 0.0, -1.0), -d.low)]
    return _literal(cells, [*caps, ring("outer_cylinder", d.outer), ring("inner_cylinder", d.inner)])


def box_supports(cells: DataFrame, d: HollowCylinder) -> DataFrame:
    """The six sides of the box about the domain, for each cell."""
    sides = []
    for axis, (low, high) in enumerate([(d.cx - d.outer, d.cx + d.outer), (d.cy - d.outer, d.cy + d.outer), (d.low, d.high)]):
        unit = [1.0 if k == axis else 0.0 for k in range(3)]
        sides.append(_plane(f"box:{'xyz'[axis]}_min", tuple(-u for u in unit), -low))
        sides.append(_plane(f"box:{'xyz'[axis]}_max", tuple(unit), high))
    return _literal(cells, sides)


def bisector_supports(halfspaces: DataFrame, cell: list[str], other: str) -> DataFrame:
    """halfspaces (cell, other, nx, ny, nz, rhs) as supports."""
    none = [F.lit(None).cast("double").alias(c) for c in ("cx", "cy", "radius")]
    return halfspaces.select(*cell, F.concat(F.lit("bisector:"), F.col(other).cast("string")).alias("key"), F.lit("plane").alias("kind"), "nx", "ny", "nz", "rhs", *none)


def excess(x: Column, y: Column, z: Column, s: Callable[[str], Column] = F.col) -> Column:
    """By how much a point violates a support (s gives its COLUMNS): planes by
    n p - rhs, the outer cylinder from outside, the inner one from inside, any
    other on both sides."""
    radial = F.hypot(x - s("cx"), y - s("cy"))
    plane = s("nx") * x + s("ny") * y + s("nz") * z - s("rhs")
    off = radial - s("radius")
    return F.when(s("kind") == "plane", plane).when(s("key") == "outer_cylinder", off).when(s("key") == "inner_cylinder", -off).otherwise(F.abs(off))


def gathered(supports: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, s): the supports of each cell, about as many as a seed has neighbours, as an array."""
    return supports.groupBy(*cell).agg(F.collect_list(F.struct(*COLUMNS)).alias("s"))


def inside(points: DataFrame, supports: DataFrame, cell: list[str], at: tuple[str, str, str] = ("x", "y", "z"), tol: float = INSIDE) -> DataFrame:
    """The points (cell, at, others) that violate no support of their cell."""
    holds = F.forall("s", lambda s: excess(*map(F.col, at), lambda c: s[c]) <= tol)
    return points.join(gathered(supports, cell), cell).filter(holds).drop("s")


def plane_pairs_on_cylinders(supports: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, ak, bk, ck, x, y, z): where the line of two planes pierces a cylinder."""
    plane = lambda p: supports.filter("kind = 'plane'").select(*cell, F.col("key").alias(f"{p}k"), *[F.col(f"n{a}").alias(f"{p}{a}") for a in "xyz"], F.col("rhs").alias(f"{p}r"))
    t = plane("a").join(plane("b"), cell).filter("ak < bk")
    c = lambda n: F.col(n)
    t = t.withColumns(
        {"dx": c("ay") * c("bz") - c("az") * c("by"), "dy": c("az") * c("bx") - c("ax") * c("bz"), "dz": c("ax") * c("by") - c("ay") * c("bx")}
        | {k: c(f"{k[0]}x") * c(f"{k[1]}x") + c(f"{k[0]}y") * c(f"{k[1]}y") + c(f"{k[0]}z") * c(f"{k[1]}z") for k in ("aa", "ab", "bb")}
    )
    t = t.withColumn("dd", c("dx") * c("dx") + c("dy") * c("dy") + c("dz") * c("dz")).filter(F.col("dd") > PARALLEL)
    u, v = c("ar") * c("bb") - c("br") * c("ab"), c("br") * c("aa") - c("ar") * c("ab")
    t = t.withColumns({f"p{a}": F.try_divide(u * c(f"a{a}") + v * c(f"b{a}"), c("dd")) for a in "xyz"})
    rings = supports.filter("kind = 'cylinder'").select(*cell, F.col("key").alias("ck"), "cx", "cy", "radius")
    t = t.join(rings, cell).withColumns({"ex": c("px") - c("cx"), "ey": c("py") - c("cy"), "qa": c("dx") * c("dx") + c("dy") * c("dy")}).filter(F.col("qa") > PARALLEL)
    t = t.withColumns({"qb": F.try_divide(c("ex") * c("dx") + c("ey") * c("dy"), c("qa")), "qc": F.try_divide(c("ex") * c("ex") + c("ey") * c("ey") - c("radius") * c("radius"), c("qa"))})
    t = t.withColumn("disc", c("qb") * c("qb") - c("qc")).filter("disc >= 0")
    t = t.withColumn("t", F.explode(F.array_distinct(F.array(-c("qb") - F.sqrt("disc"), -c("qb") + F.sqrt("disc")))))
    return t.select(*cell, "ak", "bk", "ck", *[(c(f"p{a}") + c("t") * c(f"d{a}")).alias(a) for a in "xyz"])


def vertices(supports: DataFrame, cell: list[str], scale: float = 1e6) -> DataFrame:
    """(cell, vertex, x, y, z, keys): the points of three supports inside the
    cell, those within 1 / scale made one, numbered in order of place; keys: the
    supports the point lies on, sorted."""
    triples = plane_triples(supports.filter("kind = 'plane'"), cell)
    found = triples.unionByName(plane_pairs_on_cylinders(supports, cell))
    grid = [F.rint(F.col(a) * scale).cast("long").alias(f"q{a}") for a in "xyz"]
    kept = inside(found, supports, cell).groupBy(*cell, *grid).agg(*[F.min_by(a, F.struct("ak", "bk", "ck")).alias(a) for a in "xyz"])
    on = F.filter("s", lambda s: F.abs(excess(F.col("x"), F.col("y"), F.col("z"), lambda c: s[c])) <= ON)
    kept = kept.join(gathered(supports, cell), cell).withColumn("keys", F.array_sort(F.transform(on, lambda s: s["key"])))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("qx", "qy", "qz")) - 1
    return kept.select(*cell, number.alias("vertex"), "x", "y", "z", "keys")


def angular_distance(a: Column, b: Column) -> Column:
    """|a - b| as an angle of at most pi."""
    return F.abs(F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi)


def curve_kind(left: str, right: str) -> Column:
    """The kind of the curve of two supports (prefixes of their columns)."""
    ring = lambda s: F.col(f"{s}kind") == "cylinder"
    cap = lambda s: F.col(f"{s}key").isin("top_cap", "bottom_cap")
    one = ring(left) != ring(right)
    level = F.when(ring(left), F.col(f"{right}nz")).otherwise(F.col(f"{left}nz"))
    return (
        F.when(~one, "line_segment").when(cap(left) | cap(right), "circle_arc").when(F.abs(level) <= PARALLEL, "vertical_line").otherwise("cylinder_plane_curve")
    )


def edges(verts: DataFrame, supports: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, edge, a, b, kind, start, end, and their places sx..ez, mx, my, mz):
    the curve pieces of supports a < b between neighbouring vertices whose
    middle lies in the cell. Vertices stand in order of the curve's parameter:
    the place along a line, the height of a vertical line, the angle of a closed
    curve, whose pieces go round from each vertex to the next."""
    on = verts.select(*cell, "vertex", "x", "y", "z", F.explode("keys").alias("key"))
    pairs = on.select(*cell, "vertex", "x", "y", "z", F.col("key").alias("a")).join(on.select(*cell, "vertex", F.col("key").alias("b")), [*cell, "vertex"]).filter("a < b")
    ends = lambda p: supports.select(*cell, F.col("key").alias(p[0]), *[F.col(c).alias(f"{p}{c}") for c in COLUMNS])
    t = pairs.join(ends("a_"), [*cell, "a"]).join(ends("b_"), [*cell, "b"]).withColumn("kind", curve_kind("a_", "b_"))
    c = F.col
    ring = lambda n: F.when(c("a_kind") == "cylinder", c(f"a_{n}")).otherwise(c(f"b_{n}"))
    plane = lambda n: F.when(c("a_kind") == "cylinder", c(f"b_{n}")).otherwise(c(f"a_{n}"))
    t = t.withColumns({"ox": ring("cx"), "oy": ring("cy"), "r": ring("radius"), **{f"p{n}": plane(n) for n in ("nx", "ny", "nz", "rhs")}})
    along = (c("a_ny") * c("b_nz") - c("a_nz") * c("b_ny")) * c("x") + (c("a_nz") * c("b_nx") - c("a_nx") * c("b_nz")) * c("y") + (c("a_nx") * c("b_ny") - c("a_ny") * c("b_nx")) * c("z")
    # the direction's sign is fixed so that it doesn't hang on which support comes first
    angle = F.atan2(c("y") - c("oy"), c("x") - c("ox"))
    param = F.when(c("kind") == "line_segment", along).when(c("kind") == "vertical_line", c("z")).otherwise(angle)
    # a vertical plane meets a cylinder in two lines
    side = F.signum((c("y") - c("oy")) * c("pnx") - (c("x") - c("ox")) * c("pny"))
    t = t.withColumns({"param": param, "branch": F.when(c("kind") == "vertical_line", side).otherwise(0.0)})
    near = Window.partitionBy(*cell, "a", "b", "branch").orderBy("param", "vertex")
    whole = Window.partitionBy(*cell, "a", "b", "branch").orderBy("param", "vertex").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = ("vertex", "x", "y", "z", "param")
    t = t.withColumns({f"next_{n}": F.lead(n).over(near) for n in names} | {f"first_{n}": F.first(n).over(whole) for n in names} | {"many": F.count("*").over(whole)})
    closed = c("kind").isin("circle_arc", "cylinder_plane_curve")
    end = lambda n: F.when(c("next_vertex").isNotNull(), c(f"next_{n}")).when(closed & (c("many") > 1), c(f"first_{n}"))
    t = t.withColumns({f"e_{n}": end(n) for n in names}).filter("e_vertex IS NOT NULL")
    turn = c("param") + F.pmod(c("e_param") - c("param"), F.lit(2 * math.pi)) / 2
    mx = F.when(closed, c("ox") + c("r") * F.cos(turn)).otherwise((c("x") + c("e_x")) / 2)
    my = F.when(closed, c("oy") + c("r") * F.sin(turn)).otherwise((c("y") + c("e_y")) / 2)
    t = t.withColumns({"mx": mx, "my": my})
    mz = F.when(closed, (c("prhs") - c("pnx") * c("mx") - c("pny") * c("my")) / c("pnz")).otherwise((c("z") + c("e_z")) / 2)
    t = t.withColumn("mz", mz)
    t = t.select(
        *cell, "a", "b", "kind", F.col("vertex").alias("start"), F.col("e_vertex").alias("end"), *[F.col(n).alias(f"s{n}") for n in "xyz"],
        *[F.col(f"e_{n}").alias(f"e{n}") for n in "xyz"], "mx", "my", "mz", "ox", "oy", "r", "pnx", "pny", "pnz", "prhs",
    )
    t = inside(t, supports, cell, ("mx", "my", "mz"))
    t = t.unionByName(whole_curves(pairs, supports, cell))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("a", "b", "start", "end")) - 1
    return t.withColumn("edge", number)


def whole_curves(pairs: DataFrame, supports: DataFrame, cell: list[str]) -> DataFrame:
    """Closed curves of a plane and a cylinder that no third support cuts, where
    they lie in the cell: edges without vertices (start and end are -1)."""
    c = F.col
    p = supports.filter("kind = 'plane'").filter(F.abs("nz") > PARALLEL).select(*cell, c("key").alias("pk"), c("nx").alias("pnx"), c("ny").alias("pny"), c("nz").alias("pnz"), c("rhs").alias("prhs"))
    r = supports.filter("kind = 'cylinder'").select(*cell, c("key").alias("rk"), c("cx").alias("ox"), c("cy").alias("oy"), c("radius").alias("r"))
    t = p.join(r, cell).withColumns({"a": F.least("pk", "rk"), "b": F.greatest("pk", "rk")}).join(pairs.select(*cell, "a", "b").distinct(), [*cell, "a", "b"], "left_anti")
    t = t.withColumns({"mx": c("ox") + c("r"), "my": c("oy")})
    t = t.withColumn("mz", F.try_divide(c("prhs") - c("pnx") * c("mx") - c("pny") * c("my"), c("pnz")))
    t = inside(t, supports, cell, ("mx", "my", "mz"))
    kind = F.when(c("pk").isin("top_cap", "bottom_cap"), "circle_arc").otherwise("cylinder_plane_curve")
    none = F.lit(-1)
    return t.select(
        *cell, "a", "b", kind.alias("kind"), none.alias("start"), none.alias("end"), *[c(f"m{n}").alias(f"s{n}") for n in "xyz"], *[c(f"m{n}").alias(f"e{n}") for n in "xyz"],
        "mx", "my", "mz", "ox", "oy", "r", "pnx", "pny", "pnz", "prhs",
    )


def sample_edges(found: DataFrame, count: int = 24) -> DataFrame:
    """found (edges) with k, x, y, z: `count` points along each edge, its ends included."""
    c = F.col
    t = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    share = c("k") / float(count - 1)
    closed = c("kind").isin("circle_arc", "cylinder_plane_curve")
    begin = F.atan2(c("sy") - c("oy"), c("sx") - c("ox"))
    span = F.when(c("start") < 0, 2 * math.pi).otherwise(F.pmod(F.atan2(c("ey") - c("oy"), c("ex") - c("ox")) - begin, F.lit(2 * math.pi)))
    turn = begin + share * span
    straight = lambda n: c(f"s{n}") + share * (c(f"e{n}") - c(f"s{n}"))
    t = t.withColumns({"x": F.when(closed, c("ox") + c("r") * F.cos(turn)).otherwise(straight("x")), "y": F.when(closed, c("oy") + c("r") * F.sin(turn)).otherwise(straight("y"))})
    return t.withColumn("z", F.when(closed, (c("prhs") - c("pnx") * c("x") - c("pny") * c("y")) / c("pnz")).otherwise(straight("z")))


def faces(found: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, support, n_edges, n_vertices): a face for each support with edges."""
    t = found.select(*cell, "edge", "start", "end", F.explode(F.array("a", "b")).alias("support"))
    t = t.select(*cell, "support", "edge", F.explode(F.array("start", "end")).alias("vertex"))
    return t.groupBy(*cell, "support").agg(F.count_distinct("edge").alias("n_edges"), F.count_distinct(F.when(F.col("vertex") >= 0, F.col("vertex"))).alias("n_vertices"))


def loops(found: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, support, loop, place, edge, forward): the edges of each face chained
    into loops, each from its smallest edge on; at a vertex the smallest unused
    edge comes next; forward: whether it is walked from its start. A cell's edges, a few dozen, are walked at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in cell) + ", support string, loop int, place int, edge int, forward boolean"

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        sides = pd.concat([part.assign(support=part["a"]), part.assign(support=part["b"])])
        for support, own in sides.groupby("support", sort=True):
            ends = {int(e): (int(s), int(t)) for e, s, t in zip(own["edge"], own["start"], own["end"], strict=True)}
            left, number = dict(sorted(ends.items())), 0
            while left:
                edge = next(iter(left))
                home, at = left.pop(edge)
                chain = [(edge, True)]
                while at != home and (step := next((e for e, x in left.items() if at in x), None)) is not None:
                    u, v = left.pop(step)
                    chain.append((step, u == at))
                    at = v if u == at else u
                rows += [(support, number, k, e, f) for k, (e, f) in enumerate(chain)]
                number += 1
        out = pd.DataFrame(rows, columns=["support", "loop", "place", "edge", "forward"])
        for c in reversed(cell):
            out.insert(0, c, part[c].iloc[0])
        return out

    ends = found.select(*cell, "edge", "a", "b", "start", "end").repartition(tasks(found, found.count(), 2048), *cell)
    return ends.groupBy(*cell).applyInPandas(walk, schema)


def trim_summary(found: DataFrame, verts: DataFrame, before: DataFrame, cell: list[str], scale: float = 1e6) -> DataFrame:
    """What the shell changes on each cell: plane faces kept, cylinder faces
    made, edges of planes and of caps with cylinders, and vertices that the
    cell in its box (before) has not."""
    support = F.explode(F.array("a", "b")).alias("s")
    ring = lambda c: F.col(c).endswith("_cylinder")
    cap = lambda c: F.col(c).endswith("_cap")
    side = found.select(*cell, support).groupBy(*cell).agg(
        F.count_distinct(F.when(F.col("s").startswith("bisector:"), F.col("s"))).alias("kept_plane_faces"), F.count_distinct(F.when(ring("s"), F.col("s"))).alias("cylinder_faces")
    )
    one = (ring("a") & ~ring("b")) | (ring("b") & ~ring("a"))
    kinds = found.groupBy(*cell).agg(
        F.count(F.when(one & ~cap("a") & ~cap("b"), 1)).alias("plane_cylinder_edges"), F.count(F.when(one & (cap("a") | cap("b")), 1)).alias("cap_cylinder_edges"), F.count("*").alias("n_edges")
    )
    key = lambda df: df.select(*cell, *[F.rint(F.col(a) * scale).cast("long").alias(f"q{a}") for a in "xyz"])
    grid = [*cell, "qx", "qy", "qz"]
    new = key(verts).join(key(before), grid, "left_anti").groupBy(*cell).agg(F.count("*").alias("new_vertices"))
    return side.join(kinds, cell).join(new, cell, "left").na.fill({"new_vertices": 0})


def cell_documents(verts: DataFrame, found: DataFrame, chains: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, document): each cell as JSON: vertices, edges with their curves,
    faces with their loops. A cell has a few dozen of each."""
    v = verts.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("vertex", "x", "y", "z", "keys"))).alias("vertices"))
    curve = F.struct("kind", F.struct("ox", "oy", "r").alias("cylinder"), F.struct("pnx", "pny", "pnz", "prhs").alias("plane"))
    e = found.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("edge", "a", "b", "start", "end", curve.alias("curve")))).alias("edges"))
    loop = chains.groupBy(*cell, "support", "loop").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "edge"))), lambda x: x["edge"]).alias("of"))
    face = loop.groupBy(*cell, "support").agg(F.array_sort(F.collect_list(F.struct("loop", "of"))).alias("loops"))
    face = face.withColumn("shell", F.col("support").isin(*SHELL))
    f = face.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("support", "shell", "loops"))).alias("faces"), F.max("shell").alias("is_shell"))
    return e.join(f, cell).join(v, cell, "left").select(*cell, F.to_json(F.struct("is_shell", "vertices", "edges", "faces")).alias("document"))


def summary(verts: DataFrame, found: DataFrame, face: DataFrame, cell: list[str]) -> DataFrame:
    """One row: cells with edges, faces, edges, vertices of the whole diagram."""
    names = ("n_cells", "n_faces", "n_edges", "n_vertices")
    tables = (found.select(*cell).distinct(), face, found, verts)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n, t in zip(names, tables, strict=True)]
    out = counts[0]
    for more in counts[1:]:
        out = out.union(more)
    return out.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])
