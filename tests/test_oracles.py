"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import compare

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf, name):
    note, good = compare(spark, con, sf, name, entry.queries()[name], SQL[name])
    assert good, note


def test_entry_has_rows():
    assert set(SQL) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
