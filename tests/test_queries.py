"""Every registered query against its SQL check on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, normal  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    mine = normal(queries()[name](spark, SF_DIR).toPandas())
    assert len(mine)
    if name in oracle_sql():
        theirs = normal(db.execute(oracle_sql()[name]).df())
        assert list(mine.columns) == list(theirs.columns)
        assert mine.equals(theirs)


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[0] == "id"
