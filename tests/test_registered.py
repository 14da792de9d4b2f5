"""Registered queries against DuckDB. One of each group by default; LINTFLEET_ALL=1 runs every query."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from lintfleet.fixtures import registry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
SOME = ["D05", "D07", "D23", "K03", "K04", "T01", "T03", "F04", "F05", "W07", "W10", "L02", "L12", "L49", "X01", "X05", "X10", "R02", "R05_",
        "P00", "B002", "Q04", "M01", "M03", "M05", "I04", "S09"]
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if n in SQL and (os.environ.get("LINTFLEET_ALL") or any(n.startswith(p) for p in SOME))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == check.rows_of(rel.columns, rel.fetchall())


def test_every_query_has_sql():
    assert [n for n in registry.QUERIES if n not in SQL] == []  # the training-data queries have tests of their own where SQL can't express them


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
