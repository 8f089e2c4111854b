"""Queries against their SQL on the same tables."""

import os

import duckdb
import pytest

from eventledger.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})")
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.fetchall())
