"""Queries of the subpackage against their SQL, or for their shape, on the smallest tables."""

import pytest

from arbora.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, compare):
    compare(queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() >= 0
