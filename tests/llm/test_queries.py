"""Registered queries: names, and rows against DuckDB where there is SQL."""

import os

import pytest
from check import compare, connect

from threadloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_sql(spark, name):
    n, error = compare(connect(SF_DIR), spark, SF_DIR, QUERIES[name], ORACLES[name])
    assert error is None and n > 0, error
