import numpy as np
import pytest

from voxelmill import catalog
from voxelmill.operators import sampling


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_the_generator_at_any_partitioning(spark, parts):
    n = 1000
    want = np.random.default_rng(7).random((n, 3))
    got = sampling.uniform_stream(spark.range(n).repartition(parts), "id", 7).collect()
    assert len(got) == n and all((want[r.id] == (r.x, r.y, r.z)).all() for r in got)


def test_single_repeated_and_null_numbers(spark):
    want = np.random.default_rng(3).random((2_000_001, 2))
    rows = [(2_000_000,), (5,), (5,), (None,), (0,)]
    got = sampling.uniform_stream(spark.createDataFrame(rows, "n long"), "n", 3, ("a", "b")).collect()
    assert [None if r.n is None else tuple(want[r.n]) for r in got] == [None if r.a is None else (r.a, r.b) for r in got]


def test_query(spark, sf_dir):
    got = sorted(catalog.QUERIES["uniform_seeds"](spark, sf_dir).collect())
    keys = sorted(r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect())
    want = np.random.default_rng(42).random((len(keys), 3))
    assert [tuple(r) for r in got] == [(k, *map(float, w)) for k, w in zip(keys, want, strict=True)]
