"""Functions for SQL users."""

import pytest

from brindle import functions
from brindle.relang import automaton as at


@pytest.fixture(scope="module")
def sql(spark):
    assert set(functions.register(spark)) >= set(functions.SCALARS)
    return lambda text: [tuple(r) for r in spark.sql(text).collect()]


def test_scalars(sql):
    assert sql("SELECT logfmt('a=1 b=\"x y\" a=2 bare').a, logfmt('a=1').b, logfmt(''), logfmt(NULL)") == [("2", None, {}, None)]
    a, b, none = sql("""SELECT logql_canonical('{ a = "b" }'), logql_canonical('(({a=`b`}))'), logql_canonical(NULL)""")[0]
    assert a == b and none is None
    assert sql("SELECT logql_selections('no query'), size(logql_selections('{a=\"b\"}'))") == [(None, 1)]
    assert sql("SELECT 'x5' rlike re2_java('^x\\\\d$'), re2_java('('), re2_java(NULL)") == [(True, None, None)]
    assert sql("SELECT 'app.log' rlike re2_java(glob_re2('a*.lo?')), 'xapp.log' rlike re2_java(glob_re2('a*.lo?'))") == [(True, False)]


def test_witness(sql):
    w, none, broken = sql("SELECT language_witness('^a[0-9]{2}$', '7'), language_witness('^a[0-9]$', 'b'), language_witness('(', 'b')")[0]
    assert at.matches(at.compile("^a[0-9]{2}$"), w) and "7" in w and none is None and broken is None


def test_language_of_a_group(sql):
    got = dict(sql("SELECT t, infer_language(t, x) FROM (SELECT 'kiln <*>' AS t, 'kiln ' || id AS x FROM range(100, 160) UNION ALL SELECT 'rare <*>', 'rare 1' UNION ALL SELECT NULL, NULL) GROUP BY t"))
    assert got["kiln <*>"] == r"\Akiln [0-9]{3}\z" and got["rare <*>"] is None and got[None] is None


def test_drain_of_a_table(sql):
    got = sql("SELECT template, count(*) FROM drain(TABLE(SELECT 'kiln ' || (id % 3) || ' is hot' AS text FROM range(30) UNION ALL SELECT NULL) PARTITION BY 1) GROUP BY 1")
    assert got == [("kiln <*> is hot", 30)]
