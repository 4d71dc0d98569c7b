"""Every registered query with an SQL twin agrees with DuckDB on the smallest tables."""

import pytest
from oracle import compare, duck, folder

from riskspark.queries import all_queries, all_sql


@pytest.fixture(scope="module")
def con():
    return duck(folder("0.001"))


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(all_queries()[name](spark, folder("0.001")), con, all_sql()[name]) is None
