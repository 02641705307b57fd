import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import curved, deck_writing, neighbours, shells, triangulation
from voxelmill.session import cut

D = curved.HollowCylinder(0.0, 0.0, 2.0, 5.0, 0.0, 10.0)
CELL = ["g", "seed_id"]


@pytest.fixture(scope="module")
def brep(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(4):
        for k in range(6):
            r, t = rng.uniform(2.2, 4.8), rng.uniform(0, 2 * math.pi)
            rows.append((str(g), k, r * math.cos(t), r * math.sin(t), rng.uniform(0.5, 9.5)))
    rows += [("one", 0, 3.0, 0.0, 5.0), ("two", 0, 3.0, 0.0, 2.0), ("two", 1, 3.0, 0.0, 8.0), ("flat", 0, 3.0, 1.0, 5.0), ("flat", 1, -3.0, 0.0, 5.0)]
    seeds = spark.createDataFrame(rows, "g string, seed_id long, x double, y double, z double")
    supports = cut(curved.bisector_supports(neighbours.halfspaces(seeds, ["g"]), CELL, "neighbour_id").unionByName(curved.shell_supports(seeds.select(*CELL), D)))
    verts = cut(curved.vertices(supports, CELL))
    found = cut(curved.edges(verts, supports, CELL))
    return rows, supports, verts, found, cut(curved.loops(found, CELL))


def test_domain_of_a_grid():
    d = curved.HollowCylinder.of_grid(200, 80, 100.0, 50.0)
    assert (d.cx, d.cy, d.low, d.high) == (99.5, 99.5, 0.5, 79.5) and d.volume == pytest.approx(math.pi * 7500 * 79)


def test_vertices_are_as_near_to_their_seed_as_to_any(brep):
    rows, _, verts, _, _ = brep
    for v in verts.collect():
        own = {r[1]: math.dist(r[2:], (v.x, v.y, v.z)) for r in rows if r[0] == v.g}
        assert own[v.seed_id] <= min(own.values()) + 1e-6
        r = math.hypot(v.x, v.y)
        assert 2 - 1e-6 <= r <= 5 + 1e-6 and -1e-6 <= v.z <= 10 + 1e-6 and len(v["keys"]) >= 3


def test_loops_are_closed_and_use_each_edge_of_their_face_once(brep):
    _, _, _, found, chains = brep
    sides = found.count() * 2
    used = chains.groupBy(*CELL, "support", "edge").count().collect()
    assert len(used) == sides and all(r["count"] == 1 for r in used)
    p = shells.loop_points(found, chains, CELL)
    ends = p.groupBy(*CELL, "support", "loop").agg(F.min_by(F.struct("x", "y", "z"), "nth").alias("a"), F.max_by(F.struct("x", "y", "z"), "nth").alias("b")).collect()
    assert all(math.dist(r["a"], r["b"]) < 1e-6 for r in ends)
    one = found.filter("g = 'one'").collect()
    assert len(one) == 4 and all(r["start"] == -1 for r in one)


def test_faces_tile_the_shell_and_bound_the_volume(brep):
    _, supports, _, found, chains = brep
    tris = cut(shells.cell_triangles(found, chains, supports, CELL, samples=33))
    area = shells.areas(tris, CELL).groupBy("g", "support").agg(F.sum("area").alias("area")).collect()
    for name, size in shells.shell_area(D).items():
        got = {r.g: r.area for r in area if r.support == name}
        assert len(got) == 7 and all(v == pytest.approx(size, rel=0.01) for v in got.values())
    # outward triangles enclose the cells' volume
    t = np.array([[r[c] for c in shells.CORNERS] for r in tris.collect()]).reshape(-1, 3, 3)
    volume = (t[:, 0] * np.cross(t[:, 1], t[:, 2])).sum() / 6
    assert volume == pytest.approx(7 * D.volume, rel=0.02)
    glb = shells.glb_of_groups(tris, "g", "seed_id", curved.SHELL).filter("g = '0'").first()["glb"]
    assert struct.unpack_from("<III", glb) == (0x46546C67, 2, len(glb))
    doc = json.loads(glb[20 : 20 + struct.unpack_from("<I", glb, 12)[0]])
    assert len(doc["nodes"]) == 6 and doc["nodes"][0]["extras"]["isShell"] and doc["accessors"][1]["type"] == "VEC3"


def test_inner_points_leave_the_areas(brep):
    """Flat faces over points inside are as large as those of ears, and no rim gets or loses a point."""
    _, supports, _, found, chains = brep
    mesh = lambda m: cut(shells.cell_triangles(found, chains, supports, CELL, mesh=m).filter("NOT support LIKE '%cylinder'"))
    ears, inner = mesh(shells.ear_mesh), mesh(triangulation.flat_mesh)
    of = lambda t: {(r.g, r.seed_id, r.support): (r.area, r.n_triangles) for r in shells.areas(t, CELL).collect()}
    a, b = of(ears), of(inner)
    assert set(a) == set(b) and all(b[k][0] == pytest.approx(a[k][0], rel=1e-9) for k in a)
    assert sum(n for _, n in b.values()) > 1.5 * sum(n for _, n in a.values())


def test_cell_documents(brep):
    _, _, verts, found, chains = brep
    docs = curved.cell_documents(verts, found, chains, CELL).filter("g = '1'").collect()
    d = json.loads(docs[0]["document"])
    assert d["is_shell"] and all(max(loop["of"]) < len(d["edges"]) for f in d["faces"] for loop in f["loops"])


def test_ears_with_a_hole():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    hole = np.array([[1, 1], [1, 2], [2, 2], [2, 1]], float)
    points = np.concatenate([square, hole])
    t = points[np.array(shells.ears(points, shells.bridged([square, hole])))]
    area = np.abs(np.cross(np.append(t[:, 1] - t[:, 0], np.zeros((len(t), 1)), 1), np.append(t[:, 2] - t[:, 0], np.zeros((len(t), 1)), 1))[:, 2]).sum() / 2
    assert area == pytest.approx(15)


def test_numbers_and_written_decks(spark, tmp_path):
    values = [0.0, -0.0, 1.0, -3.0, 0.1, 1 / 3, -2 / 3, 1e15 + 0.5, 1.5e20, 1e-5, 123456.789 / 7, -571.22 / 7, 1e300]
    want = [str(int(v)) if v.is_integer() else f"{v:.15g}" for v in values]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    assert [r[0] for r in df.orderBy("k").select(deck_writing.number_text("v")).collect()] == want
    nodes = spark.createDataFrame([(d, k, float(k), k / 3, 0.0) for d in range(2) for k in range(50)], "deck long, node_id long, x double, y double, z double").repartition(5)
    deck_writing.write_lines(deck_writing.node_block(nodes, 0, "node_id", ("x", "y", "z")), str(tmp_path / "decks"))
    for d in range(2):
        lines = [line for f in sorted((tmp_path / "decks" / f"deck={d}").glob("part-*")) for line in f.read_text().splitlines()]
        assert lines == ["*Node", *[f"{k + 1},{k},{k // 3 if k % 3 == 0 else format(k / 3, '.15g')},0" for k in range(50)]]
    bad = spark.createDataFrame([(0, 0, 1.5)], "deck long, set_no int, id double")
    with pytest.raises(Exception, match="non-integer"):
        deck_writing.set_blocks(spark.createDataFrame([(0, 0, "s")], "deck long, set_no int, name string"), bad, 0).collect()


def test_cells_are_worked_on_by_several_tasks(spark, brep):
    """The tables are small in bytes, so that AQE would join them to one task."""
    _, supports, _, found, chains = brep
    least = spark.sparkContext.defaultParallelism
    assert curved.loops(found, CELL).rdd.getNumPartitions() >= least
    assert shells.cell_triangles(found, chains, supports, CELL).rdd.getNumPartitions() >= least
