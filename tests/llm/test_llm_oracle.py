"""Queries with SQL against DuckDB on the smallest tables; every query runs."""

from pathlib import Path

import duckdb
import pytest

from loam.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, rows, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = QUERIES[name](spark, FOLDER)
    want = con.sql(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    assert rows(df) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
