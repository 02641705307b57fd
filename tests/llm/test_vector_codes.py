import hashlib
import math

import numpy as np
import pytest

from voxelmill.llm import queries, vector_codes

SCHEMA = "vec_id long, label int, embedding array<float>, own string, sums long"


def brute(rows, rounds=6):
    """{(vec_id, vector): (code, error, digest)} by whole numbers of Python alone, each length by itself."""
    kept = [(i, l, v) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for d in {len(v) for _, _, v in kept}:
        some = [(i, l, [math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (-d % 8)) for i, l, v in kept if len(v) == d]
        some.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        w = len(some[0][2]) // 8
        part = lambda v, p: v[p * w : (p + 1) * w]  # noqa: E731, B023
        books = [[part(v, p) for _, _, v in some[:16]] for p in range(8)]
        far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
        for r in range(rounds + 1):
            own = [[min(range(len(b)), key=lambda e: (far(part(v, p), b[e]), e)) for p, b in enumerate(books)] for _, _, v in some]  # noqa: B023
            if r == rounds:
                break
            for p, b in enumerate(books):
                for e in range(len(b)):
                    mine = [part(v, p) for (_, _, v), o in zip(some, own, strict=True) if o[p] == e]
                    if mine:
                        b[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, l, v), o in zip(some, own, strict=True):
            out.append((i, l, "".join(f"{e:02x}" for e in o), sum(far(part(v, p), books[p][e]) for p, e in enumerate(o)), sha))
    total = {}
    for _, l, _, e, _ in out:
        total[l] = total.get(l, 0) + e
    return sorted(((i, c, e, total[l], s) for i, l, c, e, s in out), key=str)


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], schema).repartition(3)
    codes, books, scanned = vector_codes.vector_codes(df)
    return sorted(map(tuple, vector_codes.code_table(spark, codes, books).collect()), key=str), scanned


def floats(r, n, d, spread=0.1):
    return [list(map(float, x)) for x in (r.standard_normal((n, d)) * spread).astype(np.float32)]


def test_query_equals_sql(spark, duck, sf_dir):
    got = queries.op13_vector_codes(spark, sf_dir)
    want = duck.sql(queries.ORACLE_SQL["op13_vector_codes"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_equals_brute_force(spark):
    r = np.random.default_rng(1)
    vectors = floats(r, 150, 16)
    vectors += [vectors[3]] * 20 + [[0.0] * 16, [-0.0] * 16] + [[1.5] * 16, [-1.5] * 16]
    rows = [(int(k) * 3 % 997, int(k) % 4 or None, v) for k, v in enumerate(vectors)]
    rows += [(5, 1, None), (6, 1, [None] * 16), (7, 2, [float("nan")] * 16), (8, 2, [float("inf")] + [0.0] * 15), (9, 2, [1.0, None] * 8)]
    got, scanned = run(spark, rows)
    assert got == brute(rows)
    assert scanned[0] == 1.0 and min(scanned[1:]) < 0.9


def test_repeated_ids_null_ids_and_lengths(spark):
    r = np.random.default_rng(2)
    rows = [(k // 3, None, v) for k, v in enumerate(floats(r, 60, 8))]
    rows += [(None, 2, v) for v in floats(r, 10, 8)]
    rows += [(k, 1, v) for k, v in enumerate(floats(r, 30, 13))] + [(3, 1, []), (4, None, [])] + [(k, 7, v) for k, v in enumerate(floats(r, 3, 5))]
    got, _ = run(spark, rows)
    assert got == brute(rows)


def test_large_components(spark):
    r = np.random.default_rng(3)
    rows = [(k, 1, v) for k, v in enumerate(floats(r, 60, 24, spread=5000.0))]
    got, _ = run(spark, rows)
    assert got == brute(rows)
    codes, _, _ = vector_codes.vector_codes(spark.createDataFrame([(1, 1, [3e38, -3e38]), (2, 1, [0.0, 0.0])], "vec_id long, label int, embedding array<double>"))
    assert codes.count() == 2


def test_empty_table(spark):
    got, _ = run(spark, [])
    assert got == []
    got, _ = run(spark, [(1, 1, None)])
    assert got == []


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_hide_a_nearer_entry(seed):
    """Codebooks that swing: net moves are below the sum of the moves, and the entries are those of full scans."""
    r = np.random.default_rng(seed)
    x = r.integers(-3000, 3000, (400, 4))
    home = r.integers(-3000, 3000, (8, 16, 4))
    books, own, low, stamp, scanned = [], None, np.zeros(400), np.zeros(400, np.int64), []
    for t in range(8):
        books.append(home + r.integers(-60, 60, home.shape) * (t % 2) + r.integers(-3, 3, home.shape))
        own, d, low, stamp, n = vector_codes.assign(x, books, 2, own, low, stamp)
        full = ((x[:, None] - books[-1][2][None]) ** 2).sum(2)
        assert (own == full.argmin(1)).all() and (d == full.min(1)).all()
        scanned.append(n)
    assert max(scanned[2:]) < 200
    drift = sum(np.sqrt(((books[k + 1][2] - books[k][2]) ** 2).sum(1)) for k in range(7))
    assert (vector_codes.net_moves(books, 2)[0] < drift.max() / 2).all()
