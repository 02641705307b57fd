import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.operators import bands, cells, decks, density, elasticity, grid, mechanics, meshes, neighbours, optimise, ordered, prefix, sampling
from voxelmill.sources import readers, writers
from voxelmill.streaming import events


def test_running_sum(spark):
    rows = [(int(k), int(v)) for k, v in enumerate(np.random.default_rng(0).integers(0, 50, 5000))]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    got = {r["k"]: r["s"] for r in prefix.running_sum(df, [F.col("k")], F.col("v"), "s").collect()}
    assert [got[k] for k, _ in rows] == np.cumsum([v for _, v in rows]).tolist()
    assert sorted(r["n"] for r in prefix.dense_index(df, [F.col("v")], "n").collect()) == list(range(5000))
    assert prefix.running_sum(df.limit(0), [F.col("k")], F.col("v"), "s").count() == 0


def test_draws(spark):
    w = [0, 5, 0, 1, 100, 3]
    cdf = sampling.cumulative(spark.createDataFrame(list(enumerate(w)), "k long, w long"), [F.col("k")], F.col("w"))
    asked = [0.0, 4.9, 5.0, 5.5, 6.0, 50.0, 106.0, 108.9]
    draws = spark.createDataFrame([(float(a),) for a in asked], "at double")
    got = {r["at"]: r["k"] for r in sampling.draw(cdf, draws, "at", 109.0, True).collect()}
    assert got == {a: int(np.searchsorted(np.cumsum(w), a, "right")) for a in asked}
    got = {r["at"]: r["k"] for r in sampling.draw(cdf, draws, "at", 109.0, False).collect()}
    assert got == {a: int(np.searchsorted(np.cumsum(w), a, "left")) for a in asked if a > 0}


def test_probability(spark):
    df = spark.createDataFrame([(0,), (500,), (1000,)], "density_milli int")
    p = [r["probability"] for r in density.probability(df, 2.0).collect()]
    assert sum(p) == pytest.approx(1) and p[0] == 0 and p[2] == pytest.approx(4 * p[1])
    with pytest.raises(ValueError):
        density.probability(df.limit(1), 1.0)


def test_oriented_box(spark):
    vox = [(x, y, z, 800) for x in range(2, 18) for y in range(8, 12) for z in range(8, 11)]
    box = density.fit_box(spark.createDataFrame(vox, "x int, y int, z int, density_milli int"), F.col("density_milli") > 0)
    assert np.allclose(box["axes"] @ box["axes"].T, np.eye(3)) and np.linalg.det(box["axes"]) == pytest.approx(1)
    assert abs(box["axes"][0][0]) == pytest.approx(1) and box["half"] == pytest.approx([7.5, 1.5, 1.0])


def test_nearest_seed_far_and_tied(spark):
    rng = np.random.default_rng(1)
    seeds = [(k, *map(float, p)) for k, p in enumerate(rng.normal(size=(80, 3)))] + [(200, 5.0, 5.0, 5.0), (100, 5.0, 5.0, 5.0)]
    points = [(k, *map(float, p)) for k, p in enumerate(rng.normal(size=(400, 3)) * 2)] + [(900, 500.0, 0.0, 0.0), (901, 5.0, 5.0, 5.1)]
    got = {r["point_id"]: r["seed_id"] for r in neighbours.nearest_seed(spark.createDataFrame(points, "point_id long, x double, y double, z double"), spark.createDataFrame(seeds, "seed_id long, x double, y double, z double")).collect()}
    s = sorted(seeds)
    d = ((np.array([p[1:] for p in points])[:, None] - np.array([p[1:] for p in s])[None]) ** 2).sum(2)
    assert got == {p[0]: s[int(k)][0] for p, k in zip(points, d.argmin(1), strict=True)}


def test_quantiles(spark):
    v = np.random.default_rng(2).integers(0, 400, 3001) / 7.0
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = bands.quantiles(spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double"), "v", shares)
    assert got == pytest.approx(np.quantile(v, shares))


def test_rate_law_published_value(spark):
    got = spark.range(1).select(mechanics.rate(F.lit(0.012221333333333338)).alias("r"), mechanics.rate(F.lit(0.5)).alias("p"), mechanics.rate(F.lit(0.000485)).alias("z")).first()
    assert got["r"] == pytest.approx(0.013401830369778241, rel=1e-12) and got["p"] == -0.05 and got["z"] == 0
    assert spark.range(1).select(mechanics.modulus(F.lit(0.36), 1.0, 0.1)).first()[0] == pytest.approx(0.146656)


def test_design_update_published_value(spark):
    rows = [(0, 0.3, -0.9), (1, 0.45, 0.2), (2, 0.6, -0.35)]
    df = spark.createDataFrame([(i, x, x, x, 0.0, 0.0, g, 1.0) for i, x, g in rows], "id long, x double, xold1 double, xold2 double, low double, upp double, df double, dg double")
    got = optimise.step(df, 0.05, 1).orderBy("id").collect()
    assert [r["low"] for r in got] == pytest.approx([-0.1995, -0.0495, 0.1005])
    assert [r["x"] for r in got] == pytest.approx([0.42677313265564956, 0.001001091740939041, 0.6119509389187682], abs=5e-6)
    assert np.mean([r["moved"] for r in got]) == pytest.approx(0.19590766110514726, abs=5e-6)


def test_cells_fill_the_box(spark):
    rng = np.random.default_rng(3)
    seeds = [(k % 2, k, *map(float, p)) for k, p in enumerate(rng.uniform(0, 1, (60, 3)))]
    c = cells.build_cells(spark.createDataFrame(seeds, "label int, seed_id long, x double, y double, z double"), "label", 0.0, 1.0).collect()
    assert len(c) == 60
    for label in (0, 1):
        assert sum(r["volume"] for r in c if r["label"] == label) == pytest.approx(1.0, abs=1e-9)
    for r in c:  # closed: each edge of a face is used by one other face
        uses = {}
        for f in r["faces"]:
            for a, b in zip(f, f[1:] + f[:1], strict=True):
                uses[frozenset((a, b))] = uses.get(frozenset((a, b)), 0) + 1
        assert set(uses.values()) == {2}


def test_cube_has_twelve_edges(spark):
    c = cells.build_cells(spark.createDataFrame([(0, 1, 0.5, 0.5, 0.5)], "label int, seed_id long, x double, y double, z double"), "label", 0.0, 1.0)
    assert c.first()["volume"] == pytest.approx(1) and cells.cell_edges(c, "label").count() == 12


def test_level_surface_is_closed(spark):
    vox = [(x, y, z, 1.0) for x in range(5) for y in range(4) for z in range(3)]
    df = spark.createDataFrame(vox, "x int, y int, z int, v double")
    t = np.array([list(r) for r in meshes.level_surface(meshes.smooth(df, "v", 0.8), "v", 0.4).collect()]).reshape(-1, 3, 3)
    edges = {}
    for tri in np.rint(t * 1e6).astype(int):
        for a, b in ((0, 1), (1, 2), (2, 0)):
            p, q = tuple(tri[a]), tuple(tri[b])
            if p != q:
                edges[(p, q)] = edges.get((p, q), 0) + 1
    assert all(edges.get((q, p)) == n for (p, q), n in edges.items())
    volume = np.einsum("ni,ni->n", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6
    assert 20 < volume < 90
    s = meshes.mesh_summary(meshes.level_surface(df, "v", 0.5), []).first()
    assert s["volume"] > 0


def test_tubes(spark):
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert meshes.tubes(e, "id", 0.1, 24, 3.0, 0.06).count() == 108 * 24
    straight = meshes.tubes(e, "id", 0.1, 32)
    s = meshes.mesh_summary(meshes.tube_triangles(straight, 32), ["id"]).first()
    assert s["triangles"] == 64 and s["area"] == pytest.approx(2 * np.pi * 0.1, rel=0.01)


def test_brick_stiffness():
    k = elasticity.stiffness(2.0, 0.3, 0.5)
    assert np.allclose(k, k.T) and np.linalg.matrix_rank(k, 1e-9) == 18
    x = elasticity.CORNERS * 0.5
    turn = np.cross([0.1, 0.2, -0.3], x)
    assert np.abs(k @ turn.ravel()).max() < 1e-12
    u = (x @ np.diag([0.01, 0, 0])).ravel()
    assert 0.5 * u @ k @ u == pytest.approx(0.5 * 0.01**2 * elasticity.elasticity(2.0, 0.3)[0, 0] * 0.125)


def test_compression_of_a_block(spark):
    vox = spark.createDataFrame([(0, 0, z, 1.0) for z in range(3)], "x int, y int, z int, scale double")
    force = spark.createDataFrame([((i, j, 3), [0.0, 0.0, -0.25]) for i in (0, 1) for j in (0, 1)], "node struct<x:int,y:int,z:int>, f array<double>")
    got = {tuple(r["node"]): r["u"] for r in elasticity.solve(vox, F.col("node.z") == 0, force, elasticity.stiffness(1.0, 0.0, 1.0), 1e-9).collect()}
    assert got[(0, 0, 3)][2] == pytest.approx(-3.0, rel=1e-6) and got[(1, 1, 0)] == [0.0] * 3


def test_grid(spark):
    block = spark.createDataFrame([(x, y, z) for x in range(4) for y in range(4) for z in range(4)], "x int, y int, z int")
    assert grid.surface(block).count() == 64 - 8
    one = spark.createDataFrame([(0, 0, 0)], "x int, y int, z int")
    assert grid.dilate(one, 2.0).count() == len(grid.ball(2.0)) == 33
    seg = spark.createDataFrame([(0, 0, 0, 3, 0, 0), (2, 2, 2, 2, 2, 2)], "x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    assert {tuple(r) for r in grid.rasterise(seg).collect()} == {(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (2, 2, 2)}


def test_decks(spark):
    text = "*Cload, op=NEW\r\n  VERT-1.1, 1,  2.0\r\n"
    assert spark.range(1).select(decks.normalised(F.lit(text))).first()[0] == "*cload,op=new\nvert-1.1,1,2.0"
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(["*Nset, nset=A, unsorted", "1, 2,", "** no", "3", "*End", "x"])], "deck string, n int, line string")
    got = [(r["section"], r["keyword"], r["tokens"]) for r in decks.sections(lines).orderBy("n").collect()]
    assert got == [(1, "nset", ["1", "2"]), (1, "nset", ["3"]), (2, "end", ["x"])]
    assert lines.limit(1).select(decks.parameters(F.col("line"))).first()[0] == {"nset": "A", "unsorted": ""}


def test_first_wins_and_fan(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 1, "a")], "k int, o int, v string")
    assert {tuple(r) for r in ordered.first_wins(df, ["k"], ["o"], ["v"]).collect()} == {(1, "b"), (2, "a")}
    assert spark.range(1).select(ordered.fan(F.array(*[F.lit(k).cast("long") for k in range(5)]))).first()[0] == [[0, 1, 2], [0, 2, 3], [0, 3, 4]]
    assert spark.range(1).select(ordered.fan(F.array(F.lit(1).cast("long")))).first()[0] == []


def mat_bytes(name: str, a: np.ndarray) -> bytes:
    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, a.astype("<f8").tobytes(order="F"))
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + element(14, body)


def test_readers_and_writers(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    np.savez(tmp_path / "a.npz", density=a, name=np.array("text"))
    (tmp_path / "a.mat").write_bytes(mat_bytes("cage", a))
    for name in ("a.npz", "a.mat"):
        got = readers.as_voxels(readers.read_arrays(spark, str(tmp_path / name))).collect()
        assert {(r["x"], r["y"], r["z"]): r["value"] for r in got} == {(i, j, k): a[i, j, k] for i in range(2) for j in range(3) for k in range(4)}
    with pytest.raises(ValueError):
        readers.read_arrays(spark, "a.txt")
    with pytest.raises(KeyError):
        readers.required(readers.read_npz(spark, str(tmp_path / "a.npz")), "other")
    tri = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], ", ".join(f"{v}{x} double" for v in "abc" for x in "xyz"))
    writers.write_stl(tri, str(tmp_path / "mesh"), "m")
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "mesh").glob("part-*")))
    (tmp_path / "m.stl").write_text(text)
    back = readers.read_stl(spark, str(tmp_path / "m.stl")).first()
    assert (back["bx"], back["cy"], back["az"]) == (1.0, 1.0, 0.0) and "facet normal 0.000000e+00 0.000000e+00 1.000000e+00" in text
    glb = writers.encode_glb(np.eye(3), np.array([[0, 1, 2]]))
    magic, version, size = struct.unpack_from("<III", glb)
    assert (magic, version, size) == (0x46546C67, 2, len(glb)) and json.loads(glb[20 : 20 + struct.unpack_from("<I", glb, 12)[0]])["accessors"][1]["count"] == 3
    vox = spark.createDataFrame([(0, 0, 0, 700), (1, 0, 0, 0)], "x int, y int, z int, density_milli int")
    for n in (0, 1):
        writers.write_checkpoint(writers.voxel_payload(vox.limit(2 - n)), str(tmp_path / "run"), n)
    assert readers.resume_state(spark, str(tmp_path / "run")).count() == 1
    files = readers.list_files(spark, str(tmp_path), ["%.npz"]).collect()
    assert len(files) == 1 and len(files[0]["sha256"]) == 64


def test_event_log_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"timestamp_unix": 1.7e9 + k, "event_type": "phase_start" if k % 2 == 0 else "phase_end", "token": k // 2, "name": "solve", "status": "ok", "elapsed_seconds": 1.0} for k in range(10)]
    (log / "a.json").write_text("\n".join(map(json.dumps, rows[:6])))
    stream = lambda: events.read_log(spark, str(log)).select("token", "event_type", "ts")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    events.run_to_table(stream(), out, check)
    assert spark.read.parquet(out).count() == 6
    (log / "b.json").write_text("\n".join(map(json.dumps, rows[6:])))
    events.run_to_table(stream(), out, check)
    assert spark.read.parquet(out).count() == 10
    p = events.phases(events.read_log(spark, str(log), stream=False)).collect()
    assert len(p) == 5 and all(r["ended"] is not None for r in p)
