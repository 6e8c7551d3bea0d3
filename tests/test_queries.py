"""Every query with SQL gives the rows DuckDB gives; the others run and return rows."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import differences

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert differences(got, con.execute(ORACLES[name]).df()) == ""


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
