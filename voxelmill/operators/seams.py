"""Edges that cells share, as seams: one line for all of them, strips along it, and smooth normals.

Cells compute an edge each for itself, from their own supports, so the points
that they get for one curve differ in the last digits and may run either way. A
seam is named by what doesn't differ: the seeds and surfaces that meet in it, its
two ends and its middle in whole numbers, the ends in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1e5
OFFSET = 0.18
AXES = ("x", "y", "z")


def _key(x: Column, y: Column, z: Column, scale: float) -> Column:
    # + 0 makes -0 and 0 one
    return F.struct(*[(F.rint(v * scale).cast("long") + 0).alias(a) for v, a in zip((x, y, z), AXES, strict=True)])


def signatures(found: DataFrame, cell: list[str], seed: str, scale: float = SCALE) -> DataFrame:
    """found (edges of curved) with members (the seeds and surfaces that meet in
    the edge, sorted), lo and hi (its ends in whole numbers, in order), mid, and
    ahead: whether the edge runs from lo to hi. A closed edge has equal ends."""
    name = lambda k: F.regexp_replace(k, "^bisector:", "")
    members = F.array_sort(F.array(F.col(seed).cast("string"), name(F.col("a")), name(F.col("b"))))
    start, end, mid = (_key(*[F.col(f"{p}{a}") for a in AXES], scale) for p in "sem")
    return found.withColumns({"members": members, "lo": F.least(start, end), "hi": F.greatest(start, end), "mid": mid, "ahead": start <= end})


def registry(signed: DataFrame, cell: list[str], seed: str) -> DataFrame:
    """(diagram: cell without seed, members, lo, hi, mid, first, n_cells): a row
    for each seam; first: the least (seed, edge, ahead) that has it, whose line
    is the seam's."""
    diagram = [c for c in cell if c != seed]
    return signed.groupBy(*diagram, "members", "lo", "hi", "mid").agg(F.min(F.struct(F.col(seed).alias("seed"), "edge", "ahead")).alias("first"), F.count("*").alias("n_cells"))


def seam_points(points: DataFrame, signed: DataFrame, seams: DataFrame, cell: list[str], seed: str, samples: int) -> DataFrame:
    """(cell, edge, k, x, y, z): each edge's `samples` points, taken from its seam
    and turned the edge's own way, so that all that share a seam have its very
    points. points: cell, edge, k, x, y, z of all edges."""
    diagram = [c for c in cell if c != seed]
    sig = [*diagram, "members", "lo", "hi", "mid"]
    own = signed.select(*cell, "edge", "ahead", *[c for c in sig if c not in cell]).join(seams.select(*sig, "first"), sig)
    own = own.select(*cell, "edge", F.col("first.seed").alias("their_seed"), F.col("first.edge").alias("their_edge"), (F.col("ahead") == F.col("first.ahead")).alias("same"))
    lines = points.select(*diagram, F.col(seed).alias("their_seed"), F.col("edge").alias("their_edge"), "k", *AXES)
    k = F.when(F.col("same"), F.col("k")).otherwise(samples - 1 - F.col("k"))
    return own.join(lines, [*diagram, "their_seed", "their_edge"]).select(*cell, "edge", k.alias("k"), *AXES)


def _norm(v: list[Column]) -> list[Column]:
    size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    held = F.when(size > 1e-12, size).otherwise(1.0)
    return [c / held for c in v]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def support_normal(at: list[Column], s: str = "") -> list[Column]:
    """The analytic normal of a support (columns kind, nx .. cy, with a prefix) at a point: away from a cylinder's axis, or a plane's own."""
    c = lambda n: F.col(s + n)
    out, flat = [at[0] - c("cx"), at[1] - c("cy"), F.lit(0.0)], [c("nx"), c("ny"), c("nz")]
    return _norm([F.when(c("kind") == "cylinder", o).otherwise(f) for o, f in zip(out, flat, strict=True)])


def face_middles(points: DataFrame, found: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, support, mx, my, mz): the mean of the points of each face's edges."""
    of = found.select(*cell, "edge", F.explode(F.array("a", "b")).alias("support"))
    return points.join(of, [*cell, "edge"]).groupBy(*cell, "support").agg(*[F.avg(a).alias(f"m{a}") for a in AXES])


def offsets(points: DataFrame, found: DataFrame, supports: DataFrame, middles: DataFrame, cell: list[str], offset: float = OFFSET) -> DataFrame:
    """(cell, edge, support, k, x, y, z, nx, ny, nz): each edge's points moved by
    `offset` into each of its two faces, and the face's normal there. Inward is
    across the line, by its tangent (central differences) and the normal, on the
    side where the face's middle is."""
    w = Window.partitionBy(*cell, "edge").orderBy("k")
    along = [F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a)) for a in AXES]
    t = points.withColumns(dict(zip(("tx", "ty", "tz"), along, strict=True)))
    of = found.select(*cell, "edge", F.explode(F.array("a", "b")).alias("support"))
    own = supports.select(*cell, F.col("key").alias("support"), *[F.col(c).alias(f"s_{c}") for c in ("kind", "nx", "ny", "nz", "cx", "cy")])
    t = t.join(of, [*cell, "edge"]).join(own, [*cell, "support"]).join(middles, [*cell, "support"])
    at = [F.col(a) for a in AXES]
    t = t.withColumns(dict(zip(("nx", "ny", "nz"), support_normal(at, "s_"), strict=True)))
    across = _norm(_cross([F.col("nx"), F.col("ny"), F.col("nz")], _norm([F.col("tx"), F.col("ty"), F.col("tz")])))
    t = t.withColumns(dict(zip(("ux", "uy", "uz"), across, strict=True)))
    toward = sum((F.col(f"u{a}") * (F.col(f"m{a}") - F.col(a)) for a in "yz"), F.col("ux") * (F.col("mx") - F.col("x")))
    sign = F.when(toward >= 0, 1.0).otherwise(-1.0)
    return t.select(*cell, "edge", "support", "k", *[(F.col(a) + offset * sign * F.col(f"u{a}")).alias(a) for a in AXES], "nx", "ny", "nz")


def strips(moved: DataFrame, found: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, edge, t, ax .. cz, and for each corner its normal anx .. cnz): the
    two triangles of each step of a strip between the edge's line in face a and
    that in face b; normals are the faces' mean."""
    ends = found.select(*cell, "edge", "a", "b")
    side = lambda s: moved.select(*cell, "edge", F.col("support").alias(s), "k", *[F.col(c).alias(f"{s}_{c}") for c in (*AXES, "nx", "ny", "nz")])
    both = side("a").join(ends, [*cell, "edge", "a"]).join(side("b"), [*cell, "edge", "b", "k"])
    mean = dict(zip(("nx", "ny", "nz"), _norm([F.col(f"a_n{a}") + F.col(f"b_n{a}") for a in AXES]), strict=True))
    both = both.withColumns(mean)
    w = Window.partitionBy(*cell, "edge").orderBy("k")
    here = {f"{s}{n}{a}": F.col(f"{s}_{a}") if n == "0" else F.lead(f"{s}_{a}").over(w) for s in "ab" for n in "01" for a in AXES}
    here |= {f"n{n}{a}": F.col(f"n{a}") if n == "0" else F.lead(f"n{a}").over(w) for n in "01" for a in AXES}
    q = both.select(*cell, "edge", "k", *[c.alias(n) for n, c in here.items()]).filter("a1x IS NOT NULL")
    corner = lambda s, n: [*[F.col(f"{s}{n}{a}") for a in AXES], *[F.col(f"n{n}{a}") for a in AXES]]

    def triangle(*corners: tuple[str, str]) -> Column:
        names = [f"{c}{n}" for c in "abc" for n in ("x", "y", "z", "nx", "ny", "nz")]
        return F.struct(*[v.alias(n) for n, v in zip(names, [v for s, n in corners for v in corner(s, n)], strict=True)])

    pair = F.array(triangle(("a", "0"), ("b", "0"), ("b", "1")), triangle(("a", "0"), ("b", "1"), ("a", "1")))
    return q.select(*cell, "edge", "k", F.posexplode(pair).alias("h", "t")).select(*cell, "edge", (2 * F.col("k") + F.col("h")).alias("t"), "t.*")


def smooth_normals(corners: DataFrame, mesh: list[str], triangle: str, scale: float = SCALE) -> DataFrame:
    """(mesh, vertex place qx qy qz, nx, ny, nz, n_triangles): the normal of each
    vertex of an indexed mesh: the sum of its triangles' area vectors, made a
    unit. corners: mesh, triangle, k (0..2), x, y, z. Corners within 1 / scale
    are one vertex; area vectors are summed before they meet, so a vertex of
    very many triangles is no hot key."""
    t = corners.groupBy(*mesh, triangle).agg(F.array_sort(F.collect_list(F.struct("k", *AXES))).alias("c")).filter(F.size("c") == 3)
    side = lambda n: [F.col("c")[n][a] - F.col("c")[0][a] for a in AXES]
    t = t.withColumns(dict(zip(("vx", "vy", "vz"), _cross(side(1), side(2)), strict=True)))
    p = t.select(*mesh, F.explode("c").alias("p"), "vx", "vy", "vz")
    at = [(F.rint(F.col(f"p.{a}") * scale).cast("long")).alias(f"q{a}") for a in AXES]
    met = p.groupBy(*mesh, *at).agg(*[F.sum(f"v{a}").alias(f"v{a}") for a in AXES], F.count("*").alias("n_triangles"))
    return met.select(*mesh, "qx", "qy", "qz", *[c.alias(f"n{a}") for a, c in zip(AXES, _norm([F.col(f"v{a}") for a in AXES]), strict=True)], "n_triangles")
