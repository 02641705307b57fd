from itertools import combinations

import numpy as np
import pytest

from voxelmill.operators import feasible

BOX = ((-1.0, -1.0, -1.0), (1.0, 1.0, 1.0))


def walls():
    n = np.concatenate([np.eye(3), -np.eye(3)])
    return n, np.ones(6)


def random_cell(seed, count=6):
    r = np.random.default_rng(seed)
    inside = r.uniform(-0.7, 0.7, 3)
    n = r.normal(size=(count, 3)) * r.uniform(0.5, 3, (count, 1))
    rhs = n @ inside + np.linalg.norm(n, axis=1) * r.uniform(0.02, 0.4, count)
    w, one = walls()
    return np.concatenate([w, n]), np.r_[one, rhs]


def best_radius(n, rhs):
    """The largest ball touches four planes: every four of them."""
    size = np.linalg.norm(n, axis=1)
    rows, right, best = np.c_[n / size[:, None], np.ones(len(n))], rhs / size, -np.inf
    for four in combinations(range(len(n)), 4):
        m = rows[list(four)]
        if abs(np.linalg.det(m)) > 1e-9:
            x = np.linalg.solve(m, right[list(four)])
            if x[3] > best and (rows @ x <= right + 1e-9).all():
                best = x[3]
    return best


@pytest.mark.parametrize("seed", range(25))
def test_radius_equals_brute_force(seed):
    n, rhs = random_cell(seed)
    centre, radius = feasible.inner_centre(n, rhs, 1e3, seed)
    assert abs(radius - best_radius(n, rhs)) < 1e-7
    assert ((rhs - n @ centre) / np.linalg.norm(n, axis=1) >= radius - 1e-7).all()


def test_nothing_inside():
    n, rhs = walls()
    n, rhs = np.concatenate([n, [[1.0, 0, 0], [-1.0, 0, 0]]]), np.r_[rhs, -0.5, 0.4]
    assert feasible.inner_centre(n, rhs, 1e3) is None
    assert feasible.inner_centre(np.array([[0.0, 0, 0]]), np.array([-1.0]), 1e3) is None


def test_points_of_cells(spark):
    """Starts that do, starts outside the box, the middle, the ball, no point, no planes, nulls."""
    cells = {f"r{s}": random_cell(s) for s in range(8)}
    w, one = walls()
    cells["start"] = cells["outside"] = (w, one)
    cells["middle"] = np.concatenate([w, [[1.0, 0, 0]]]), np.r_[one, 0.2]
    cells["empty"] = np.concatenate([w, [[1.0, 0, 0], [-1.0, 0, 0]]]), np.r_[one, -0.5, 0.4]
    cells["null"] = (w, one)
    starts = [(c, -0.95, -0.95, 0.95) for c in cells if c.startswith("r")]
    starts += [("start", 0.5, 0.0, 0.0), ("outside", 7.0, 0.0, 0.0), ("middle", 0.9, 0.0, 0.0), ("empty", 0.9, 0.0, 0.0), ("free", 0.3, 0.3, 0.3), ("null", 0.0, 0.0, 0.0)]
    rows = [(c, *map(float, p), float(b)) for c, (n, rhs) in cells.items() for p, b in zip(n, rhs, strict=True)] + [("null", None, 1.0, 1.0, -9.0)]
    planes = spark.createDataFrame(rows, "cell string, nx double, ny double, nz double, rhs double")
    found = feasible.feasible_points(planes, spark.createDataFrame(starts, "cell string, x double, y double, z double"), ["cell"], BOX)
    got = {f.cell: f for f in found.collect()}
    assert {c: got[c].how for c in ("start", "outside", "middle", "empty", "free", "null")} == {"start": "start", "outside": "start", "middle": "middle", "empty": "none", "free": "start", "null": "start"}
    assert got["outside"].x == 1 - 1e-6 and got["empty"].x is None and got["empty"].slack is None and got["free"].slack is None
    inner = 0
    for s in range(8):
        n, rhs = cells[f"r{s}"]
        f = got[f"r{s}"]
        slack = ((rhs - n @ [f.x, f.y, f.z]) / np.linalg.norm(n, axis=1)).min()
        assert slack >= -1e-9 and abs(slack - f.slack) < 1e-9
        if f.how == "inner":
            inner += 1
            assert abs(slack - best_radius(n, rhs)) < 1e-7
    assert inner > 0
