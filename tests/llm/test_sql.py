"""Corpus queries that SQL can express agree with DuckDB on the smallest tables."""

import pytest
from oracle import compare, duck, folder

from riskspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, folder("0.001")), duck(folder("0.001")), queries.SQL[name]) is None
