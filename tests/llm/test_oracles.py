"""Queries against their SQL twins in DuckDB."""

import duckdb
import pytest

from roadweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_same_rows_as_sql(spark, name, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf{sf}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, f"/root/testdata/sf{sf}")
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted(map(tuple, got.select(*cols).collect()), key=str)
    assert a == sorted(want.select(*cols).fetchall(), key=str)
