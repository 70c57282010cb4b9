"""Every registered query of the discovery engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from keyloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLES:
        assert got
        return
    want = db.sql(registry.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in got) == sorted(str(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())
