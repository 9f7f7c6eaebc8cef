"""Every registered query against its check SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as contract
from kerbline.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the shared tables")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return value.isoformat() if isinstance(value, datetime.datetime) else repr(value)


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.check_sql is not None))
def test_query_matches_check_sql(spark, engine, name):
    df = contract.queries()[name](spark, FOLDER)
    check = engine.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(check.columns)
    assert rows_by_name(df.columns, df.collect()) == rows_by_name(check.columns, check.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.check_sql is None))
def test_query_without_check_sql_runs(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() >= 0


def test_entry_gives_one_dashboard_row(spark):
    assert contract.entry(spark).count() == 1
