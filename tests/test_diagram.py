import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import diagram, neighbours

@pytest.fixture(autouse=True)
def rounds(monkeypatch):
    """Small groups too are met cube by cube here."""
    monkeypatch.setattr(diagram, "WHOLE", 10)


BOX = ((-1.0, -1.0, -1.0), (1.0, 1.0, 1.0))


def brute(points, box=BOX):
    """Pairs whose bisector touches the cell clipped by all other seeds, by a solid made of faces."""
    from voxelmill.operators.cells import box_faces, clip

    low, high = (np.array(b) for b in box)
    out = set()
    for i, me in enumerate(points):
        faces = box_faces(low, high)
        for j in np.argsort(((points - me) ** 2).sum(1)):
            if (points[j] != me).any():
                faces = clip(faces, 2 * (points[j] - me), points[j] @ points[j] - me @ me) or faces
        corners = np.concatenate(faces)
        for j, q in enumerate(points):
            d = np.linalg.norm(q - me)
            if d > 0 and ((corners - (me + q) / 2) @ (q - me) / d).max() >= -1e-9:
                out.add((i, j))
    return out


def frame(spark, points, group=1):
    return spark.createDataFrame([(group, k, *map(float, p)) for k, p in enumerate(points)], "g int, seed_id long, x double, y double, z double").repartition(3)


def graph(spark, points, box=BOX):
    return {(r.seed_id, r.neighbour_id) for r in diagram.neighbour_graph(frame(spark, points), "g", box).collect()}


def test_equals_brute_force_on_one_group(spark):
    points = np.random.default_rng(1).uniform(-1, 1, (500, 3))
    got = graph(spark, points)
    assert got == brute(points)
    assert 10 < len(got) / 500 < 18


def test_uneven_seeds(spark):
    """A dense lump, a few far seeds, and seeds on a plane."""
    r = np.random.default_rng(2)
    points = np.concatenate([r.normal(0.3, 0.004, (250, 3)), r.uniform(-1, 1, (40, 3)), np.c_[r.uniform(-1, 1, (40, 2)), np.full(40, -0.5)]])
    assert graph(spark, points) == brute(points)


def test_lattice_touches(spark):
    """On a lattice a cell touches all 26 about it, but shares faces with six."""
    side = np.linspace(-0.8, 0.8, 5)
    points = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    found = diagram.neighbour_graph(frame(spark, points), "g", BOX).collect()
    middle = int(np.flatnonzero((np.abs(points) < 1e-9).all(1))[0])
    own = [r for r in found if r.seed_id == middle]
    assert len(own) == 26 and sum(r.face for r in own) == 6


def test_groups_ties_and_small_groups(spark):
    r = np.random.default_rng(3)
    rows = [(g, int(k), *map(float, p)) for g in ("a", None, "b") for k, p in enumerate(r.uniform(-1, 1, (20, 3)))]
    rows += [("alone", 1, 0.0, 0.0, 0.0), ("two", 1, 0.0, 0.0, 0.0), ("two", 2, 0.5, 0.0, 0.0), ("same", 1, 0.1, 0.1, 0.1), ("same", 2, 0.1, 0.1, 0.1), ("same", 3, 0.4, 0.1, 0.1)]
    found = diagram.neighbour_graph(spark.createDataFrame(rows, "g string, seed_id long, x double, y double, z double"), "g", BOX).collect()
    for g in ("a", None, "b"):
        points = np.array([p for n, _, *p in rows if n == g])
        assert {(f.seed_id, f.neighbour_id) for f in found if f.g == g} == brute(points)
    of = lambda g: sorted((f.seed_id, f.neighbour_id) for f in found if f.g == g)
    assert of("alone") == [] and of("two") == [(1, 2), (2, 1)] and of("same") == [(1, 3), (2, 3), (3, 1), (3, 2)]


def test_whole_groups_equal_rounds(spark, monkeypatch):
    points = np.random.default_rng(6).uniform(-1, 1, (60, 3))
    in_rounds = graph(spark, points)
    monkeypatch.setattr(diagram, "WHOLE", 512)
    assert graph(spark, points) == in_rounds == brute(points)


def test_empty(spark):
    empty = spark.createDataFrame([], "g int, seed_id long, x double, y double, z double")
    assert diagram.neighbour_graph(empty, "g", BOX).count() == 0


def test_bisectors_equal_those_of_all_pairs(spark):
    points = np.random.default_rng(4).uniform(-1, 1, (30, 3))
    seeds = frame(spark, points)
    own = diagram.bisectors(diagram.neighbour_graph(seeds, "g", BOX), seeds, "g")
    every = neighbours.halfspaces(seeds, ["g"])
    assert own.join(every, own.columns).count() == own.count() < every.count()


@pytest.mark.parametrize("seed", range(3))
def test_cell_volume_by_vertices(seed):
    """The kernel's vertices are those of the cell: none is beyond any plane, and each is on three."""
    r = np.random.default_rng(seed)
    me, others = r.uniform(-0.5, 0.5, 3), r.uniform(-1, 1, (60, 3))
    cell = diagram.Cell(np.full(3, -1.0) - me, np.full(3, 1.0) - me)
    near = others - me
    for n in near:
        cell.clip(n, n @ n / 2)
    gap = cell.points @ near.T - (near**2).sum(1) / 2
    walls = np.abs(np.abs(cell.points + me) - 1) < 1e-9
    assert gap.max() < 1e-9
    assert ((np.abs(gap) < 1e-9).sum(1) + walls.sum(1) == 3).all()


def test_looking_at_many_planes_equals_one_after_the_other():
    r = np.random.default_rng(9)
    near = r.uniform(-1, 1, (400, 3))
    near = near[np.argsort((near**2).sum(1))]
    one, many = (diagram.Cell(np.full(3, -1.0), np.full(3, 1.0)) for _ in range(2))
    cutting = [k for k, n in enumerate(near) if one.clip(n, n @ n / 2)]
    assert many.clip_all(near, (near**2).sum(1)) == cutting
    np.testing.assert_allclose(many.points, one.points, atol=1e-12)


def test_cells_of_a_null_label_and_neighbours_that_others_hide(spark):
    from voxelmill.operators.cells import build_cells

    rows = [(g, k, 0.1 + 0.2 * k, 0.5, 0.5) for g in (None, 1) for k in range(4)]
    found = build_cells(spark.createDataFrame(rows, "label int, seed_id long, x double, y double, z double"), "label", 0.0, 1.0).collect()
    own = sorted((r.seed_id, round(r.volume, 9), len(r.faces), r.n_neighbours) for r in found if r.label is None)
    assert own == [(0, 0.2, 6, 1), (1, 0.2, 6, 2), (2, 0.2, 6, 2), (3, 0.4, 6, 1)]
    assert own == sorted((r.seed_id, round(r.volume, 9), len(r.faces), r.n_neighbours) for r in found if r.label == 1)
