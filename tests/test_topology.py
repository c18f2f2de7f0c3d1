"""Pipeline graphs."""

import pytest

from brindle import topology as tp

BASE = {
    "receivers": {"otlp": {}}, "processors": {"batch": {}, "filter": {}}, "exporters": {"store": {}, "s3": {}, "prom": {}}, "connectors": {"count": {}, "forward": {}},
    "service": {"pipelines": {
        "logs": {"receivers": ["otlp"], "processors": ["batch", "filter"], "exporters": ["store", "count", "forward"]},
        "logs/two": {"receivers": ["forward"], "exporters": ["s3", "forward"]},
        "metrics": {"receivers": ["count"], "exporters": ["prom"]},
    }},
}


def test_collector():
    r = tp.Collector(BASE).downstream("logs", 1)
    assert set(r.sinks) == {"store", "s3", "prom"} and r.derived == ["count"] and r.visited == ["logs", "logs/two", "metrics"]
    assert r.sinks["s3"] == ["logs->forward", "logs/two->s3"]
    with pytest.raises(tp.BadTopology):
        tp.Collector(BASE).downstream("logs", 2)
    with pytest.raises(tp.BadTopology):
        tp.Collector(BASE).downstream("none")
    with pytest.raises(tp.BadTopology):
        tp.Collector(BASE, {"service": {"pipelines": {"logs": {"exporters": ["nowhere"]}}}})


def test_later_files_win_and_lists_are_replaced():
    c = tp.Collector(BASE, {"service": {"pipelines": {"logs": {"exporters": ["store"]}}}})
    assert set(c.downstream("logs").sinks) == {"store"}
    assert tp.merge({"a": {"b": 1, "c": [1, 2]}}, {"a": {"c": [3]}}) == {"a": {"b": 1, "c": [3]}}


def test_input_graph():
    g = tp.InputGraph({
        "sources": {"in": {}, "other": {}},
        "transforms": {"route": {"inputs": ["in"]}, "m": {"type": "log_to_metric", "inputs": ["route.errors"]}, "loop": {"inputs": ["route", "loop"]}},
        "sinks": {"a": {"inputs": ["route._unmatched"]}, "b": {"inputs": ["lo*"]}, "c": {"inputs": ["other"]}, "d": {"inputs": ["m"]}},
    })
    r = g.downstream("in")
    assert set(r.sinks) == {"a", "b", "d"} and r.derived == ["m"]
    with pytest.raises(tp.BadTopology):
        g.downstream("a")


def test_tag_pipeline():
    p = tp.TagPipeline({"pipeline": {
        "filters": [{"Name": "grep", "Match": "*", "Alias": "mine"}, {"name": "rewrite_tag", "match": "app.*"}, {"name": "log_to_metrics", "match": "sys.*"}],
        "outputs": [{"name": "loki", "match": "app.*"}, {"name": "es", "match_regex": "^sys"}, {"name": "s3", "match_regex": "("}, {"name": "null"}],
    }})
    r = p.downstream("app.*", "mine")
    assert set(r.sinks) == {"loki#0", "s3#2"} and r.derived == ["rewrite_tag#1"]
    assert p.receiving("sys.log") == ["es#1", "s3#2"]
    with pytest.raises(tp.BadTopology):
        p.downstream("*", "nobody")


def test_gaps():
    r = tp.Collector(BASE).downstream("logs")
    assert [k for k, _ in tp.destination_gaps(r, ["store"], ["derived:count"])] == ["sink:prom", "sink:s3"]
