"""Dashboards, links, rules, audited requests."""

import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from brindle.sources import dashboards as db
from brindle.sources import search_audit as sa

SOURCES = (db.Datasource("loki1", "Logs", "loki", True), db.Datasource("loki2", "Other logs", "loki"), db.Datasource("prom", "Metrics", "prometheus"))
LOKI, PROM = {"type": "loki", "uid": "loki1"}, {"type": "prometheus", "uid": "prom"}
CLASSIC = {
    "templating": {"list": [{"type": "datasource", "name": "ds", "query": "loki"}, {"type": "datasource", "name": "m", "query": "prometheus"}]},
    "annotations": {"list": [{"datasource": LOKI, "expr": "{a=\"ann\"}", "enable": False}, {"datasource": "Logs", "target": {"expr": "{a=\"t\"}"}}]},
    "panels": [
        {"id": 1, "datasource": LOKI, "targets": [{"refId": "A", "expr": "{a=\"1\"}"}, {"refId": "B", "expr": "up", "datasource": PROM}, {"refId": "C", "expr": "{a=\"h\"}", "hide": True}]},
        {"id": 2, "type": "row", "panels": [{"id": 3, "datasource": "${ds}", "targets": [{"refId": "A", "expr": "{a=\"3\"}"}]}]},
        {"id": 4, "targets": [{"refId": "A", "expr": "{a=\"default\"}"}]},
        {"id": 5, "libraryPanel": {"uid": "known"}, "targets": [{"refId": "A", "expr": "{a=\"no\"}"}]},
        {"id": 6, "libraryPanel": {"uid": "gone"}},
        {"id": 7, "datasource": "$m", "targets": [{"refId": "A", "expr": "up"}]},
        {"id": 8, "datasource": {"uid": "nowhere"}, "targets": [{"refId": "A", "expr": "{a=\"unknown\"}"}]},
        None,
    ],
}
V2 = {
    "elements": {
        "p1": {"kind": "Panel", "spec": {"data": {"spec": {"queries": [{"spec": {"query": {"group": "loki", "datasource": {"name": "loki2"}, "spec": {"expr": "{a=\"v2\"}"}}}}, {"spec": {"query": {"group": "prometheus", "spec": {"expr": "up"}}}}]}}}},
        "p2": {"kind": "LibraryPanel", "spec": {"libraryPanel": {"uid": "known"}}},
        "p3": {"kind": "Hologram", "spec": {}},
    },
    "annotations": [{"spec": {"query": {"group": "", "spec": {"expr": "{a=\"ann2\"}"}}}}],
}


def read(spark, rows):
    df = spark.createDataFrame([(1, *r) for r in rows], "org long, type string, uid string, body string")
    return db.read_documents(df, SOURCES, libraries=frozenset({"known"}))


def test_classic_dashboard(spark):
    got = read(spark, [("dashboard", "d", json.dumps(CLASSIC))]).collect()
    q = {r.origin: (r.datasources, r.expr, r.hidden) for r in got if r.expr}
    assert q == {
        "dashboard:d/annotation:0": (["loki1"], '{a="ann"}', True), "dashboard:d/annotation:1": (["loki1"], '{a="t"}', False), "dashboard:d/panel:1/A": (["loki1"], '{a="1"}', False), "dashboard:d/panel:1/C": (["loki1"], '{a="h"}', True),
        "dashboard:d/panel:3/A": (["loki1", "loki2"], '{a="3"}', False), "dashboard:d/panel:4/A": (["loki1"], '{a="default"}', False), "dashboard:d/panel:8/A": (["nowhere"], '{a="unknown"}', False),
    }
    assert [r.origin for r in got if r.note] == ["dashboard:d/panel:6"]


def test_second_schema_and_gaps(spark):
    got = read(spark, [("dashboard", "v", json.dumps(V2)), ("dashboard", "bad", "{"), ("dashboard", "none", None), ("ufo", "u", "{}")]).collect()
    assert {(r.origin, r.expr) for r in got if r.expr} == {("dashboard:v/p1/0", '{a="v2"}'), ("dashboard:v/annotation:0", '{a="ann2"}')}
    assert {r.origin for r in got if r.gap} == {"dashboard:v/p3", "dashboard:bad", "dashboard:none", "ufo:u"}


def test_rules_links_history(spark):
    rule = {"data": [{"datasourceUid": "loki1", "model": {"expr": "{a=\"r\"}"}}, {"datasourceUid": "__expr__", "model": {"expr": "$A > 1"}}], "record": None}
    panes = json.dumps({"x": {"datasource": "loki2", "queries": [{"expr": "{a=\"link\"}"}]}})
    rows = [("rule", "r1", json.dumps(rule)), ("link", "s1", "explore?panes=" + quote(panes)), ("link", "s2", "d/abc"), ("link", "s3", "explore?panes={"), ("link", "s4", "explore"), ("history", "h", json.dumps({"datasourceUid": "loki1", "queries": [{"expr": "{a=\"h\"}"}]})), ("correlation", "c", json.dumps({"targetUID": "loki1", "config": {"type": "external", "target": {"expr": "x"}}})), ("library", "known", json.dumps({"model": CLASSIC["panels"][0]}))]
    got = read(spark, rows).collect()
    assert {(r.origin, r.expr) for r in got if r.expr} == {("alertrule:r1/0", '{a="r"}'), ("shorturl:s1/x/0", '{a="link"}'), ("history:h/0", '{a="h"}'), ("library:known/panel:1/A", '{a="1"}'), ("library:known/panel:1/C", '{a="h"}')}
    assert {r.origin for r in got if r.gap} == {"shorturl:s3", "shorturl:s4"}


def test_views_of_one_dashboard_count_once(spark):
    rows = [("dashboard", "d", json.dumps(CLASSIC)), ("dashboard", "d", json.dumps(CLASSIC)), ("dashboard", "e", json.dumps(CLASSIC))]
    assert db.drop_views(read(spark, rows)).where("expr is not null").count() == 2 * 7


def test_ruler(spark):
    body = json.dumps({"ns": [{"name": "g", "rules": [{"alert": "A", "expr": "x"}, {"record": "r", "expr": "y"}, {"expr": "z"}]}]})
    got = db.ruler_rules(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.kind, r.name, r.expr, r.gap is not None) for r in got] == [("alert", "A", "x", False), ("record", "r", "y", False), (None, None, "z", True)]


# --- Search store ----------------------------------------------------------------------------------------------------

CATALOG = sa.Catalog(
    ("kiln-2026.01", "kiln-2026.02", "ferry-2026.01", ".ds-looms-1", ".ds-looms-2", "weather"),
    (("harbour", ("ferry-2026.01",)), ("workshop", ("kiln-2026.02", ".ds-looms-1"))),
    (("looms", (".ds-looms-1", ".ds-looms-2")),),
)
#: A service whose documents lie in dated indices, one whose documents lie in a data stream.
KILN = sa.Scope(("kiln-*",), "app", "kiln").expanded(CATALOG)
LOOM = sa.Scope(("looms",), "app.name", "loom").expanded(CATALOG)


def reads(scope, indices, query=None, source="stored", opaque=False):
    return not sa.cannot_read(source, indices, json.dumps(query) if query is not None else None, opaque, scope)


def test_scopes_hold_every_name_over_them():
    assert set(KILN.indices) == {"kiln-*", "kiln-2026.01", "kiln-2026.02", "workshop"}
    assert set(LOOM.indices) == {"looms", ".ds-looms-1", ".ds-looms-2", "workshop"}
    assert sa.Scope((), "app", "x").expanded(CATALOG).indices == ()


def test_names_of_indices():
    for scope, near, far in ((KILN, ["kiln-2026.01", "kiln-2026.0*", "*", "work*", "away:kiln-2026.02"], ["ferry-*", "weather", "looms", "harbour", "away:ferry"]), (LOOM, ["looms", ".ds-*", "workshop", "loom*"], ["kiln-*", "weather", "harbour"])):
        for name in near:
            assert reads(scope, [name]) and reads(scope, ["weather", name]), name
        for name in far:
            assert not reads(scope, [name]) and not reads(scope, [name, "weather"]), name
        assert reads(scope, []), "no index means every index"
        assert reads(scope, [near[0], "-" + near[0]]), "an exclusion proves nothing"
    # A name that the catalog has no more may have been an alias when the audited request ran.
    assert reads(KILN, ["attic"], source="audit") and not reads(KILN, ["attic"], source="monitor") and not reads(KILN, ["attic"], {"term": {"app": "ferry"}}, "audit")


def within(kind, clause):
    return {"bool": {kind: [clause]}}


def test_clauses():
    mine, other = {"term": {"app": "kiln"}}, {"term": {"app": "ferry"}}
    sure = [other, {"terms": {"app": ["ferry", "loom"]}}, {"terms": {"app": ["ferry"], "boost": 2}}, {"term": {"app": {"value": "ferry"}}}]
    open_ = [mine, {"terms": {"app": ["ferry", "kiln"]}}, {"terms": {"app": {"index": "i", "id": "1"}}}, {"term": {"app": {"value": "ferry", "case_insensitive": True}}}, {"match": {"app": "ferry"}}, {"term": {"pod": "ferry"}}, {"term": {"app": "ferry", "pod": "x"}}, {}, [], "text"]
    for clauses, excluded in ((sure, True), (open_, False)):
        for c in clauses:
            assert sa.excludes(c, KILN) == excluded, c
            for kind in ("filter", "must"):
                assert sa.excludes(within(kind, c), KILN) == excluded and sa.excludes({"bool": {kind: c}}, KILN) == excluded, c
            assert not sa.excludes(within("should", c), KILN)
            assert sa.excludes({"constant_score": {"filter": c}}, KILN) == excluded
            assert sa.excludes(within("filter", within("must", c)), KILN) == excluded
    assert sa.excludes(within("must_not", mine), KILN) and not sa.excludes(within("must_not", other), KILN) and not sa.excludes(within("must_not", {"match": {"app": "kiln"}}), KILN)
    assert not reads(KILN, ["kiln-*"], other) and reads(KILN, ["kiln-*"], other, opaque=True) and reads(KILN, ["kiln-*"])


#: By what a request does: reads content through a search that is understood, reads it otherwise, or doesn't.
REQUESTS = {
    (True, True): ["POST /kiln-*/_search", "GET /_count", "get /a,b/_SEARCH"],
    (True, False): ["POST /kiln/_msearch", "POST /_plugins/_sql", "GET /kiln/_doc/7", "POST /a/_delete_by_query", "POST /_plugins/_alerting/monitors/9/_execute", "PUT /something/_new"],
    (False, False): ["PUT /kiln/_doc/7", "POST /kiln/_bulk", "GET /_cat/health", "DELETE /_search/scroll", "GET /_plugins/_alerting/monitors", "HEAD /", "POST /kiln/_create/3"],
}


def test_requests(spark):
    rows = [(*r.split(" "), *kind) for kind, requests in REQUESTS.items() for r in requests] + [(None, None, False, False)]
    for r in spark.createDataFrame(rows, "method string, path string, reads boolean, understood boolean").withColumn("e", sa.endpoint(F.col("method"), F.col("path"))).collect():
        assert (r.e.reads, r.e.understood) == (r.reads, r.understood), r


def test_bodies_of_searches():
    known = {"size": 3, "from": 1, "_source": ["a"], "aggs": {"by_app": {"terms": {"field": "app"}, "meta": {"n": 1}, "aggregations": {"first": {"top_hits": {}}}}}}
    query = {"term": {"app": "kiln"}}
    assert sa.search_query(json.dumps(known | {"query": query})) == (query, True) and sa.search_query("{}") == (None, True)
    deep = lambda name: {"aggs": {"a": {"terms": {}, "aggs": {"b": {"range": {}, "aggs": {"c": {name: {}}}}}}}}
    assert sa.search_query(json.dumps(deep("sum")))[1]
    for body in (deep("global"), deep("invented"), {"aggs": []}, {"aggs": {"a": 1}}, {"runtime_mappings": {}}, {"pit": {"id": "x"}}, [query], 7, None):
        assert sa.search_query(json.dumps(body)) == (None, False), body
    assert sa.search_query("{") == sa.search_query("") == sa.search_query("[" * 100_000) == (None, False)


def test_ranges_are_emptied():
    span = {"range": {"at": {"gte": 5}}}
    q = {"bool": {"filter": [span, {"term": {"app": "x"}}], "must": span, "should": []}, "constant_score": {"filter": span}, "match": {"range": {"at": 1}}}
    assert sa.without_ranges(q) == {"bool": {"filter": [{"range": {}}, {"term": {"app": "x"}}], "must": {"range": {}}, "should": []}, "constant_score": {"filter": {"range": {}}}, "match": {"range": {"at": 1}}}
    assert sa.without_ranges(None) is None and sa.without_ranges({"bool": 3}) == {"bool": 3}


def test_audit_fold_and_scopes(spark):
    body = lambda t: json.dumps({"query": {"bool": {"filter": [{"range": {"ts": {"gte": t}}}, {"term": {"app": "ferry"}}]}}})
    rows = [(i, "REST", "AUTHENTICATED", "u", "POST", "/kiln-*/_search", body(i)) for i in range(5)]
    rows += [(6, "REST", "AUTHENTICATED", "u", "POST", "/_msearch", "x"), (7, "TRANSPORT", "AUTHENTICATED", "u", "POST", "/a/_search", "{}"), (8, "REST", "AUTHENTICATED", "u", "POST", "/_bulk", None), (99, "REST", "AUTHENTICATED", "u", "GET", "/x/_search", None), (9, "REST", "AUTHENTICATED", None, "GET", "/kiln-2026.01,weather/_search", None)]
    audit = spark.createDataFrame(rows, "ts_ms long, layer string, category string, user string, method string, path string, body string")
    uses = sa.audit_uses(audit, 0, 50)
    got = {(tuple(r.indices), r.opaque): (r.n, r.last_ms) for r in uses.collect()}
    assert got == {(("kiln-*",), False): (5, 4), ((), True): (1, 6), (("kiln-2026.01", "weather"), False): (1, 9)}
    readers = sa.scoped_readers(uses.withColumn("source", F.lit("audit")), [KILN]).collect()
    assert sorted(r.origin for r in readers) == ["", "u"]


def test_saved_searches(spark):
    o = spark.createDataFrame([("s1", "p1"), ("s1", "p9"), ("s2", "p1")], "id string, ref_id string")
    p = spark.createDataFrame([("p1", "logs-*")], "pattern_id string, title string")
    assert {r.id: (r.titles, r.unresolved) for r in sa.saved_searches(o, p).collect()} == {"s1": (["logs-*"], True), "s2": (["logs-*"], False)}


def test_monitors(spark):
    docs = [
        {"name": "m", "inputs": [{"search": {"indices": ["logs-*"], "query": {"query": {"bool": {"filter": [{"range": {"t": {"gte": 1}}}]}}}}}, {"doc_level_input": {"indices": ["a"], "queries": []}}, {"uri": {}}, {"new": {}}]},
        {"name": "s", "inputs": [{"search": {"indices": ["_all"], "query": {"suggest": {}}}}]},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("x",), (None,)], "body string")
    got = {(r.origin, tuple(r.indices), r.query, r.opaque) for r in sa.monitors(df).collect()}
    assert got == {("monitor:m/0", ("logs-*",), '{"bool": {"filter": [{"range": {}}]}}', False), ("monitor:m/1", ("a",), None, True), ("monitor:m/3", (), None, True), ("monitor:s/0", (), None, True), ("monitor:?", (), None, True)}


def test_catalog_scope_and_audit_settings(spark):
    df = spark.createDataFrame([(["b", "a"], {"x": ["a"]}, None)], "indices array<string>, aliases map<string,array<string>>, data_streams map<string,array<string>>")
    assert sa.read_catalog(df) == sa.Catalog(("a", "b"), (("x", ("a",)),), ()) and sa.read_catalog(df.limit(0)) == sa.Catalog()
    docs = spark.createDataFrame([(["c"],), (["c", "d"],), (["d"],), ([],), (None,)], "svc array<string>")
    assert tuple(sa.verified_scope(docs, "svc", "c").first()) == (2, 2, 1, 2)
    audit = spark.createDataFrame([(50,), (None,)], "ts_ms long")
    assert sa.audit_reaches_back(audit, 40, 10).first().covers and not sa.audit_reaches_back(audit, 40, 9).first().covers and not sa.audit_reaches_back(audit.limit(0), 40, 9).first().covers
    assert [k for k, _ in sa.audit_gaps({"config": {"enabled": True, "audit": {"enable_rest": True, "ignore_users": ["kibanaserver"]}}})] == ["plugins", "transport"]
    assert len(sa.audit_gaps({"config": {"audit": {"disabled_rest_categories": ["AUTHENTICATED"], "ignore_requests": ["x"]}}})) == 6


def test_lists_sources_and_write_back(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "name string, v string")
    b = spark.createDataFrame([("y", "1"), ("z", "3")], "name string, v string")
    assert {tuple(r) for r in db.stable_union(a, b).collect()} == {("x", "1"), ("y", "1"), ("z", "3")}
    assert [r.name for r in db.unlisted(b, a, "name").collect()] == ["z"]
    f = spark.createDataFrame([(["loki1"],), (["prom"],), (["new", "prom"],)], "datasources array<string>")
    assert [r.relevance for r in db.classify_sources(f, ("loki1",), ("loki1", "prom")).collect()] == ["read", "other", "unknown"]
    assert db.without_credentials("https://u:p@host/x@y") == "https://host/x@y"
    docs = spark.createDataFrame([("d", json.dumps(CLASSIC)), ("e", "no json"), ("f", None)], "uid string, body string")
    got = {r.uid: r for r in db.replace_expressions(docs, {'{a="1"}': "new", "up": "down"}).collect()}
    assert got["d"].replaced == 3 and json.loads(got["d"].body)["panels"][0]["targets"][0]["expr"] == "new"
    assert got["e"].body == "no json" and got["f"].body is None
