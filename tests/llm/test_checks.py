"""Queries with SQL against it, at the smallest scale."""

import pytest

import check
from foliospark.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF)
    found = check.duck(SF).execute(CHECKS[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert check.rows_of(got.columns, got.collect()) == check.rows_of(names, found.fetchall())
