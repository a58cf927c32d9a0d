"""Every registered query of the library against its SQL twin in DuckDB, on sf0.001."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from roadweave.plans import graph, matrix, points, sources, trips  # noqa: F401
from roadweave.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(int)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: x if x is None else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = normal(got), normal(want)
    for c in a.columns:
        try:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=2e-6, equal_nan=True), c
        except (ValueError, TypeError):
            assert a[c].fillna("~").astype(str).tolist() == b[c].fillna("~").astype(str).tolist(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_return_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
