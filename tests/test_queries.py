"""Registered queries against their SQL on the smallest tables, where these are there."""

import os

import duckdb
import pytest

import __spark_entry__
from lintel.plans import document_queries, oracle, page_queries, queries, report_queries

QUERIES = queries.QUERIES | report_queries.QUERIES | page_queries.QUERIES | document_queries.QUERIES
SQL = oracle.SQL | report_queries.SQL | page_queries.SQL | document_queries.SQL

DATA = os.environ.get("LINTEL_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(table):
    """Column names and sorted rows of an Arrow table, which keeps integers with nulls apart from floats."""
    table = table.select(sorted(table.column_names))
    show = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return table.column_names, sorted(tuple(show(v) for v in r) for r in zip(*(c.to_pylist() for c in table.columns)))


@pytest.mark.parametrize("name", [n for n in SQL if n in QUERIES])
def test_query_matches_sql(spark, engine, name):
    got, want = rows(QUERIES[name](spark, DATA).toArrow()), rows(engine.sql(SQL[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["project_id", "hardware_set_id"]
