"""Lists read whole or told to be incomplete; members of languages."""

import random

import pytest

from brindle.relang import automaton as at
from brindle.relang import members as mb
from brindle.relang import syntax as sx
from brindle.sources import completeness as cp


def paged(ids, size=3):
    return lambda n: [{"id": i} for i in ids[n * size : (n + 1) * size]]


def test_pages():
    assert list(cp.read_pages(paged("abcdefg"), size=3).objects) == list("abcdefg")
    assert cp.read_pages(paged("abcdef"), size=3).gaps == [] and cp.read_pages(paged(""), size=3).objects == {}
    stalled = cp.read_pages(lambda n: [{"id": "a"}, {"id": "b"}], size=2)
    assert set(stalled.objects) == {"a", "b"} and "repeats" in stalled.gaps[0][1]
    assert "more than" in cp.read_pages(lambda n: [{"id": 2 * n}, {"id": 2 * n + 1}], size=2, pages=5).gaps[0][1]

    def refused(n):
        raise OSError("403")

    assert cp.read_pages(refused, name="orgs").gaps == [("orgs", "page 0: 403")]


def test_readings_until_two_agree():
    readings = iter(["ab", "bc", "bc"])
    settled = cp.read_until_stable(lambda: cp.Listing({x: {} for x in next(readings)}))
    assert set(settled.objects) == set("abc") and not settled.gaps
    restless = iter(["a", "b", "a", "b"])
    assert cp.read_until_stable(lambda: cp.Listing({next(restless): {}})).gaps


def test_what_a_search_finds_is_read_or_a_gap():
    def one(uid):
        if uid == "x":
            raise OSError("timeout")
        return None if uid == "y" else {"uid": uid}

    got = cp.read_missing(cp.Listing({"a": {}}), ["a", "b", "x", "y"], one)
    assert set(got.objects) == {"a", "b"} and [k for k, _ in got.gaps] == ["dashboard:x", "dashboard:y"]


def test_organisations():
    def read(org):
        if org == "2":
            raise OSError("gone")
        return cp.Listing({"d": {}}, [("e", "why")])

    got = cp.by_organisation(cp.Listing({"1": {}, "2": {}}), read, "1")
    assert set(got.objects) == {"1/d"} and [k for k, _ in got.gaps] == ["1/e", "organisation:2"]
    alone = cp.by_organisation(cp.Listing(gaps=[("organisations", "403")]), lambda org: cp.Listing({org: {}}), "7")
    assert set(alone.objects) == {"7/7"} and alone.gaps == [("organisations", "403")]


def test_tables(spark):
    t = lambda *ids: spark.createDataFrame([(i, i * 2) for i in ids], "uid string, body string")
    objects, gaps = cp.completeness(t("a", "b", "c", "d"), t("a", "b"), t("b", "c"))
    assert {r.uid for r in objects.collect()} == set("abc") and [r.key for r in gaps.collect()] == ["object:d"]
    assert cp.completeness(t("a").limit(0), t("a"))[1].count() == 0
    assert cp.search_pipeline_gaps({}) == [] and [k for k, _ in cp.search_pipeline_gaps({"b": {}, "a": {}})] == ["search-pipeline:a", "search-pipeline:b"]


@pytest.mark.parametrize("expression", [r"\Akiln [0-9]{2,4} (?:hot|cold)\z", "a|bc*", r"\A[a-f]+x?\z", r"^\w+@\d\.[^a-z]$"])
def test_members_and_near_misses(expression):
    """The automaton, the printed expression and the tree agree on texts of the language and on texts just outside."""
    import re

    rng = random.Random(4)
    inside, outside = mb.members(expression, 40, rng), mb.near_misses(expression, 40, rng)
    assert len(inside) == 40 and (outside or expression == "a|bc*")
    plain = re.compile(expression.replace(r"\z", r"\Z"), re.ASCII)
    assert sx.parse(expression)
    for t in inside:
        assert plain.search(t) and at.matches(at.compile(expression), t)
        assert at.intersects(at.compile(expression), at.compile(rf"\A{sx.quote(t)}\z")) == t
    for t in outside:
        assert not plain.search(t) and at.intersects(at.compile(expression), at.compile(rf"\A{sx.quote(t)}\z")) is None
