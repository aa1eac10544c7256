"""Operator queries against their DuckDB text on the smallest tables."""

import oracle
import pytest

from sextant.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    problem, rows = oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE[name])
    assert problem is None, problem
    assert rows > 0
