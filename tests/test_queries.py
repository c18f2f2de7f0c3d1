"""Every registered query of the core against its SQL."""

import os
from importlib import import_module

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.exists(oracle.TESTDATA), reason="no test tables")
MODULES = [import_module(m) for m in entry._CORE]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    ours, theirs = oracle.rows_of_both(spark, con, QUERIES[name], SQL[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, oracle.TESTDATA).columns


def test_automata_run_in_all_pieces(spark):
    assert QUERIES["error_like"](spark, oracle.TESTDATA).rdd.getNumPartitions() == 4
    tasks = QUERIES["reader_verdicts"](spark, oracle.TESTDATA).select(F.spark_partition_id()).distinct()
    assert tasks.count() > 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
