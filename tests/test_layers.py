import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows
from voxelmill import catalog
from voxelmill.operators import shells
from voxelmill.plans import field_queries, solid_queries, tables

#: Lines a layer here and in the SQL; sf0.001 has 6 000 lines, so the grid is five times NZ high.
MANY = "// 60000"
NAMES = ("voxelize_points", "density_cdf", "weighted_sample_right", "weighted_sample_left", "trilinear_resample", "canonical_voxels", "density_cells")


@pytest.fixture
def layered(monkeypatch):
    monkeypatch.setattr(tables, "LINES_A_LAYER", 1200)


def test_keys_are_keys(spark, sf_dir, layered):
    vox = tables.keyed_voxels(spark, sf_dir)
    found = vox.agg(F.count("*").alias("n"), F.count_distinct("k").alias("keys"), F.max("z").alias("top")).first()
    assert found.n == found.keys and found.top >= 4 * tables.NZ


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_sql_over_many_layers(spark, duck, sf_dir, layered, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL[name].replace(MANY, "// 1200"))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_sql_is_layered():
    assert all(MANY in m.ORACLE_SQL[n] for m in (field_queries, solid_queries) for n in NAMES if n in m.ORACLE_SQL)


def test_triples_of_many_blocks_are_one_file_a_part(spark, duck, sf_dir, monkeypatch):
    whole = shells.packed_triples
    monkeypatch.setattr(shells, "packed_triples", lambda points, part, **kw: whole(points, part, **kw | {"rows": 500}))
    got = catalog.QUERIES["voxel_triples"](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL["voxel_triples"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
