import math
from collections import Counter

import numpy as np
import pytest

from voxelmill.operators import curved, diagram, seams, shells, surfaces
from voxelmill.session import cut

D = curved.HollowCylinder(0.0, 0.0, 2.0, 5.0, 0.0, 10.0)
CELL = ["g", "seed_id"]
N = 9


@pytest.fixture(scope="module")
def seamed(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(24):
        r, t = rng.uniform(2.2, 4.8), rng.uniform(0, 2 * math.pi)
        rows.append(("a", k, r * math.cos(t), r * math.sin(t), rng.uniform(0.5, 9.5)))
    rows += [("two", 0, 3.0, 0.0, 2.0), ("two", 1, 3.0, 0.0, 8.0), ("one", 0, 3.0, 0.0, 5.0)]
    seeds = spark.createDataFrame(rows, "g string, seed_id long, x double, y double, z double")
    graph = diagram.neighbour_graph(seeds, "g", diagram.box_about(seeds, D.box))
    supports = cut(curved.bisector_supports(diagram.bisectors(graph, seeds, "g"), CELL, "neighbour_id").unionByName(curved.shell_supports(seeds.select(*CELL), D)))
    found = cut(curved.edges(cut(curved.vertices(supports, CELL)), supports, CELL))
    own = cut(curved.sample_edges(found, N).select(*CELL, "edge", "k", "x", "y", "z"))
    signed = cut(seams.signatures(found, CELL, "seed_id"))
    reg = cut(seams.registry(signed, CELL, "seed_id"))
    return supports, found, own, signed, reg, cut(seams.seam_points(own, signed, reg, CELL, "seed_id", N))


def lines(points):
    out = {}
    for p in sorted(points.collect(), key=lambda p: p.k):
        out.setdefault((p.g, p.seed_id, p.edge), []).append((p.x, p.y, p.z))
    return out


def test_every_seam_is_one_line(seamed):
    """Edges of one signature have the very same points, near their own and in their own direction."""
    _, found, own, signed, reg, points = seamed
    before, after = lines(own), lines(points)
    assert set(before) == set(after) and all(len(p) == N for p in after.values())
    groups = {}
    for s in signed.collect():
        groups.setdefault((s.g, *s.members, s.lo, s.hi, s.mid), []).append((s.g, s.seed_id, s.edge))
    assert len(groups) == reg.count() and {len(v) for v in groups.values()} == {1, 2, 3}
    for edges in groups.values():
        assert len({tuple(sorted(after[e])) for e in edges}) == 1
    for e, p in after.items():
        assert np.abs(np.array(p) - np.array(before[e])).max() < 1e-4
    # edges of three cells lie inside, of two on a surface, of one on a rim
    for s, edges in groups.items():
        surfaces_met = sum(m in curved.SHELL for m in s[1:4])
        assert len(edges) == 3 - surfaces_met


def test_seams_are_used_by_two_faces_of_each_cell_vertex_for_vertex(seamed):
    supports, found, _, _, _, points = seamed
    chains = cut(curved.loops(found, CELL))
    after = lines(points)
    used = Counter()
    for c in chains.collect():
        p = after[c.g, c.seed_id, c.edge]
        for a, b in zip(p, p[1:], strict=False):
            used[c.g, c.seed_id, *sorted((a, b))] += 1
    assert set(used.values()) == {2}
    # and the interior ones by the faces of all three cells
    across = Counter((g, a, b) for g, _, a, b in used)
    assert set(across.values()) == {1, 2, 3}
    tris = shells.cell_triangles(found, chains, supports, CELL, points=points)
    area = sum(r.area for r in shells.areas(tris, CELL).filter("g = 'a' AND support = 'outer_cylinder'").collect())
    assert area == pytest.approx(2 * math.pi * 5 * 10, rel=0.02)


def test_offsets_and_strips(seamed):
    """Moved points stay on their face's surface (to first order), at the offset, on the face's side."""
    supports, found, _, _, _, points = seamed
    middles = seams.face_middles(points, found, CELL)
    moved = seams.offsets(points, found, supports, middles, CELL, 0.1).collect()
    after, at = lines(points), {(m.g, m.seed_id, m.support): np.array([m.mx, m.my, m.mz]) for m in middles.collect()}
    planes = {(s.g, s.seed_id, s.key): s for s in supports.collect()}
    for m in moved:
        p, q = np.array(after[m.g, m.seed_id, m.edge][m.k]), np.array([m.x, m.y, m.z])
        assert np.linalg.norm(q - p) == pytest.approx(0.1, abs=1e-9) or np.linalg.norm(q - p) < 1e-9
        assert abs((q - p) @ np.array([m.nx, m.ny, m.nz])) < 1e-9
        assert (q - p) @ (at[m.g, m.seed_id, m.support] - p) >= -1e-9
        s = planes[m.g, m.seed_id, m.support]
        if s.kind == "plane":
            assert abs(np.array([s.nx, s.ny, s.nz]) @ q - s.rhs) < 1e-6 * max(1, abs(s.rhs))
    t = seams.strips(seams.offsets(points, found, supports, middles, CELL, 0.1), found, CELL)
    assert t.count() == found.count() * (N - 1) * 2
    n = t.select("anx", "any", "anz").limit(50).collect()
    assert all(abs(math.hypot(*r) - 1) < 1e-9 or math.hypot(*r) < 1e-9 for r in n)


def test_smooth_normals_of_a_sphere(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3.0, 1.0, -2.0)], "m long, x double, y double, z double")
    got = seams.smooth_normals(surfaces.sphere_triangles(c, "m", 2.0), ["m"], "t").collect()
    middle = {1: np.zeros(3), 2: np.array([3.0, 1.0, -2.0])}
    assert len(got) == 2 * (11 * 24 + 2)
    for r in got:
        p = np.array([r.qx, r.qy, r.qz]) / 1e5 - middle[r.m]
        assert abs(np.array([r.nx, r.ny, r.nz]) @ p / np.linalg.norm(p)) > 0.98
