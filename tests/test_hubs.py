"""Queries that count edges against their SQL, where nodes have more edges than MOST_EDGES."""

from pathlib import Path

import duckdb
import pytest

from emberline.operators import graph as GR
from emberline.plans import provenance, registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["process_records", "rarity_dimensions", "rarity_readiness"])
def test_all_edges_count(spark, monkeypatch, name):
    monkeypatch.setattr(GR, "MOST_EDGES", 1)
    monkeypatch.setattr(provenance, "_recorded", {})
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{DATA}/events.parquet'")
    want = con.sql(registry.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(x[i]) for i in at) for x in want.fetchall()), key=repr)


def test_incidents_leave_nothing_but_their_rows(spark):
    edges = provenance.parts(spark, DATA)[3]
    folder = Path(edges.inputFiles()[0].removeprefix("file:")).parent.parent
    files = lambda: {p.parent for p in folder.rglob("part-*")}
    before = files()
    rows = registry.QUERIES["incident_alerts"](spark, DATA)
    assert rows.count() > 0 and len(files() - before) == 1
    known = {r.src for r in edges.select("src").union(edges.select("dst")).distinct().collect()}
    assert {r.root for r in rows.collect()} <= known
