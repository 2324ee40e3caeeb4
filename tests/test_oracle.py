"""Every query with SQL, against DuckDB on the smallest tables; the others must at least give rows."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql
from threadloom.plans.catalog import QUERIES
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, error = compare(con, spark, SF_DIR, QUERIES[name], oracle_sql().get(name))
    assert error is None, error
    assert name in oracle_sql() or n > 0


def test_entry(spark):
    assert entry(spark).count() > 0
