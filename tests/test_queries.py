import math

import numpy as np
import pytest

import __spark_entry__ as entry
from voxelmill import catalog


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (int, np.integer)) and not isinstance(v, bool):
        return int(v)
    return float(v) if isinstance(v, (float, np.floating)) else str(v) if not isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert set(catalog.QUERIES) <= set(found)
    assert catalog.FLAGSHIP in found and entry.entry(spark).count() > 0
