"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quarry.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = duck.sql(catalogue.ORACLES[name])
    assert sorted(expected.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(r[i] for i in places)) for r in expected.fetchall())
