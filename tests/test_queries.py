"""All queries of the engine against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from emberline.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in registry.ORACLES:
        got = db.sql(registry.ORACLES[name])
        assert sorted(got.columns) == columns
        assert rows == sorted((tuple(plain(dict(zip(got.columns, x))[c]) for c in columns) for x in got.fetchall()), key=repr)
