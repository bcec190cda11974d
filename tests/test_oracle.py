"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from loam.queries import QUERIES, SQL

FOLDER = os.environ.get("LOAM_TEST_SF", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.10g}"))
    if isinstance(v, Decimal):
        return str(v.normalize())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    df, want = QUERIES[name](spark, FOLDER), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    assert got == sorted([plain(r[i]) for i in order] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns
    QUERIES[name](spark, FOLDER).count()
