"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from histarium import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = queries.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = ordered(got), ordered(want)
    assert len(got) == len(want)
    for c in got.columns:
        for a, b in zip(got[c], want[c], strict=True):
            assert a == b or (isinstance(a, float) and b is not None and abs(a - b) <= 1.1e-5), (c, a, b)


def test_names_match():
    assert set(SQL) <= set(queries.queries())
