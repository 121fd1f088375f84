"""Registered queries against their SQL on the smallest tables."""

import compare
import pytest

from roisight.llm import queries

SMALL = "/root/testdata/sf0.001"

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows(spark, name):
    compare.same_rows(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)
