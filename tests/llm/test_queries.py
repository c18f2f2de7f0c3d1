"""Registered queries of the subpackage against their SQL."""

import os

import pytest

from brindle.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.exists(oracle.TESTDATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    ours, theirs = oracle.rows_of_both(spark, oracle.connect(), queries.QUERIES[name], queries.SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, oracle.TESTDATA).count() > 0
