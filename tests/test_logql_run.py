"""LogQL on small frames: stages and operators that the event queries don't reach, edge cases, and faults."""

import math

import pytest

from brindle.logql.compile import LogStore, flatten_json, pattern_expression
from brindle.logql.syntax import QueryFault

S = 10**9
SCHEMA = "labels map<string,string>, ts_ns long, line string, value string"
ROWS = [
    ({"app": "a", "pod": "p1"}, 1 * S, '{"level":"error","took":"1.5s","size":"2KB","nested":{"x":1,"y":null},"list":[1],"app":"inner"}'),
    ({"app": "a", "pod": "p1"}, 2 * S, '{"level":"info","took":"oops","size":"10MiB"}'),
    ({"app": "a", "pod": "p2"}, 2 * S, "not json"),
    ({"app": "b", "pod": "p3"}, 3 * S, 'level=info msg="two words" took=30ms n=5 addr=10.1.2.3'),
    ({"app": "b", "pod": "p3"}, 4 * S, "\x1b[31mred\x1b[0m level=warn n=7 addr=192.168.1.9"),
    ({"app": "c"}, 5 * S, '{"_entry":"packed line","user":"u1"}'),
    ({"app": "c"}, 6 * S, None),
    (None, 7 * S, "no labels"),
    ({"app": "d"}, None, "no time"),
    ({"app": "e"}, 8 * S, "multi\nline\nEND"),
    ({"app": "e"}, 8 * S, "multi\nline\nEND"),
]


@pytest.fixture(scope="module")
def store(spark):
    return LogStore(spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA))


def lines(store, q):
    return [r.line for r in store.logs(q).orderBy("ts_ns", "line").collect()]


def labels(store, q):
    return [r.labels for r in store.logs(q).orderBy("ts_ns", "line").collect()]


def values(store, q, at=100):
    return {tuple(sorted(r.labels.items())): r.value for r in store.instant(q, at * S).collect()}


def test_json_flattens_and_marks_errors(store):
    got = labels(store, '{app="a"} | json')
    assert got[0] == {"app": "a", "pod": "p1", "level": "error", "took": "1.5s", "size": "2KB", "nested_x": "1", "nested_y": "", "app_extracted": "inner"}
    assert got[2]["level"] == "info" and got[1] == {"app": "a", "pod": "p2", "__error__": "JSONParserErr"}
    assert len(labels(store, '{app="a"} | json | __error__=""')) == 2
    assert labels(store, '{app="a"} | json lvl="level", deep="nested.x" | deep="1"') == [{"app": "a", "pod": "p1", "lvl": "error", "deep": "1"}]
    assert flatten_json("[1]") is None and flatten_json(None) is None and flatten_json('{"a b":true,"1":2}') == {"a_b": "true", "_1": "2"}


def test_logfmt(store):
    got = labels(store, '{app="b"} | logfmt')
    assert got[0]["msg"] == "two words" and got[0]["n"] == "5"
    assert len(labels(store, '{app="b"} | logfmt --strict | __error__=""')) == 2
    assert labels(store, '{app="b"} | logfmt who="addr", n | n="7"')[0] == {"app": "b", "pod": "p3", "who": "192.168.1.9", "n": "7"}


def test_typed_label_filters(store):
    assert len(lines(store, '{app="a"} | json | took > 1s')) == 2 + 0  # a duration that can't be read stays, with an error
    assert labels(store, '{app="a"} | json | took > 1s | __error__=""')[0]["took"] == "1.5s"
    assert len(lines(store, '{app="a"} | json | took > 1s | __error__=""')) == 1
    assert len(lines(store, '{app="a"} | json | size >= 1MB | __error__=""')) == 1
    assert len(lines(store, '{app="b"} | logfmt | n > 5 or took < 1s')) == 2
    assert len(lines(store, '{app="b"} | logfmt | n > 5 and missing > 1')) == 0
    assert len(lines(store, '{app="b"} | logfmt | n != 5')) == 1


def test_addresses(store):
    assert len(lines(store, '{app="b"} |= ip("10.0.0.0/8")')) == 1
    assert len(lines(store, '{app="b"} != ip("10.0.0.0/8")')) == 1
    assert len(lines(store, '{app="b"} |= ip("192.168.1.0-192.168.1.20")')) == 1
    assert len(lines(store, '{app="b"} | logfmt | addr = ip("10.1.2.3")')) == 1
    with pytest.raises(QueryFault):
        store.logs('{app="b"} |= ip("nowhere")')


def test_unpack_decolorize_formats(store):
    assert lines(store, '{app="c"} | unpack') == ["packed line", ""]
    assert labels(store, '{app="c"} | unpack | user="u1"') == [{"app": "c", "user": "u1"}]
    assert lines(store, '{app="b"} | decolorize |= "red level"') == ["red level=warn n=7 addr=192.168.1.9"]
    assert lines(store, '{app="b"} | logfmt | line_format "{{.n | default \\"0\\"}}-{{ ToUpper .level }}-{{.gone}}"') == ["5-INFO-", "7-WARN-"]
    assert labels(store, '{app="e"} | label_format app2=app | drop app')[0] == {"app2": "e"}
    assert labels(store, '{app="b"} | logfmt | keep level="warn", app')[0] == {"app": "b"}
    for bad in ("{{ if .x }}y{{ end }}", "{{ nope .x }}", "{{.x"):
        with pytest.raises(QueryFault):
            store.logs(f'{{app="b"}} | line_format "{bad}"')


def test_whole_lines_and_anchors(store):
    assert len(lines(store, '{app="e"} |~ "multi.line"')) == 0  # a dot is no newline in a filter
    assert len(lines(store, '{app="e"} |~ "(?s)multi.line"')) == 2
    assert len(lines(store, '{app="e"} |~ "END$" |~ "^multi"')) == 2 and len(lines(store, '{app="e"} |~ "line$"')) == 0 and len(lines(store, '{app="e"} |~ "(?m)line$"')) == 2
    assert len(lines(store, '{app=~"e.*"} |> "multi<_>END"')) == 2
    assert lines(store, '{app="c"} != "packed"') == [""]  # a null line is an empty one
    assert len(lines(store, '{pod="", app=~".+"}')) == 5  # an absent label is empty; rows without time are in unbounded reads only


def test_regexp_with_deep_loops_runs_on_the_automaton(spark):
    df = spark.createDataFrame([({"a": "b"}, S, "ab" * 50_000), ({"a": "b"}, S, "ab" * 50_000 + "c")], "labels map<string,string>, ts_ns long, line string")
    assert LogStore(df).logs('{a="b"} |~ "^(?:ab|a)*c"').count() == 1


def test_pattern_stage():
    assert pattern_expression("<ip> - <_> [<when>]")[1] == ["ip", "when"]


def test_range_edges(store):
    q = 'sum(count_over_time({app=~".+"} [2s]))'
    assert values(store, q, 4) == {(): 2.0}  # (2s, 4s]
    assert values(store, 'sum(count_over_time({app=~".+"} [2s] offset 1s))', 4) == {(): 3.0}
    assert values(store, 'sum(count_over_time({app=~".+"} [2s] offset -1s))', 3) == {(): 2.0}
    assert values(store, 'sum(count_over_time({app="nobody"} [1h]))') == {}
    assert values(store, 'absent_over_time({app="nobody", x="y", z=~"q"} [1h])') == {(("app", "nobody"), ("x", "y")): 1.0}


def test_errors_are_left_out_of_metrics(store):
    assert values(store, 'sum_over_time({app="a"} | json | unwrap duration(took) [1h]) by (app)') == {(("app", "a"),): 1.5}
    assert values(store, 'sum_over_time({app="a"} | json | unwrap bytes(size) [1h]) by (app)') == {(("app", "a"),): 2000 + 10 * 1024**2}
    assert values(store, 'avg by (app) (sum_over_time({app="b"} | logfmt | unwrap n [1h]))') == {(("app", "b"),): 6.0}


A = 'sum by (app) (count_over_time({app=~".+"} [1h]))'


def test_operators(store):
    assert values(store, f"{A} / 0")[(("app", "a"),)] == math.inf and math.isnan(values(store, f"({A} - {A}) / 0")[(("app", "a"),)])
    assert values(store, f"-{A} % 2")[(("app", "a"),)] == -1.0
    assert values(store, f"{A} == 3") == {(("app", "a"),): 3.0} and values(store, f"3 == bool {A}")[(("app", "a"),)] == 1.0
    assert values(store, f"2 ^ 3 ^ 2 * {A}")[(("app", "a"),)] == 3 * 512
    assert values(store, "1 / 0 + vector(1)") == {(): math.inf}
    assert values(store, f"{A} and on() vector(1)").keys() == values(store, A).keys() and values(store, f"{A} unless on() vector(1)") == {}
    with pytest.raises(Exception, match="group_left"):
        values(store, f'count_over_time({{app=~".+"}} [1h]) + on(app) {A}')
    pods = 'count_over_time({app=~".+", pod=~".+"} [1h])'
    assert values(store, f"{pods} * on(app) group_left(none) {A}")[(("app", "a"), ("pod", "p1"))] == 6.0
    assert values(store, f'label_replace({A}, "app", "", "app", "(.*)")') and all(k == () for k in values(store, f'label_replace(topk(1, {A}), "app", "", "app", ".*")'))
    assert values(store, f'label_replace({A}, "x", "${{1}}!", "app", "([ab])")')[(("app", "a"), ("x", "a!"))] == 3.0


def test_faults(store):
    for q in ('{app="a"}', 'sum_over_time({app="a"} [1h])', 'quantile_over_time({app="a"} | unwrap x [1h])', "sum(1)", '1 and 2', 'sum(rate({app=~"("} [1h]))', 'count_over_time({app="a"} | regexp "x" [1h])', 'count_over_time({app="a"} | json | level > "x" [1h])', 'count_over_time({$x, app="a"} [1h])', 'count_over_time({app="a"} | $stage [1h])'):
        with pytest.raises(QueryFault):
            store.instant(q, S)
    with pytest.raises(QueryFault):
        store.logs(A)
    with pytest.raises(QueryFault):
        store.over(A, 5 * S, S, S)


def test_empty_logs(spark):
    s = LogStore(spark.createDataFrame([], SCHEMA))
    assert s.logs('{a="b"}').count() == 0 and s.instant('sum(rate({a="b"}[1m]))', S).count() == 0 and s.instant('absent_over_time({a="b"}[1m])', S).count() == 1
    assert s.over('sum(rate({a="b"}[1m]))', 0, 10 * S, S).count() == 0


def test_sorted_output(store):
    v = [r.value for r in store.instant(f"sort_desc({A})", 100 * S).collect()]
    assert v == sorted(v, reverse=True) and [r.value for r in store.instant(f"sort({A})", 100 * S).collect()] == sorted(v)


def test_metadata_is_no_stream_label(spark):
    df = spark.createDataFrame([({"app": "a"}, S, "x", {"trace": "t1"})], "labels map<string,string>, ts_ns long, line string, meta map<string,string>")
    s = LogStore(df, metadata="meta")
    assert s.logs('{trace="t1", app="a"}').count() == 0 and s.logs('{app="a"} | trace="t1"').count() == 1
    assert [r.name for r in s.label_names('{app="a"}', 0, 2 * S).collect()] == ["app"]


def test_required_texts_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([({"a": "b"}, S, "x took 1"), ({"a": "b"}, S, None)], "labels map<string,string>, ts_ns long, line string").write.parquet(str(tmp_path / "logs"))
    s = LogStore(spark.read.parquet(str(tmp_path / "logs")))
    df = s.instant('sum(count_over_time({a="b"} |= "took" != "y" |= "x" [1h]))', 100 * S)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(line,took)" in plan and "StringContains(line,x)" in plan and "GreaterThan(ts_ns" in plan
    assert [r.value for r in df.collect()] == [1.0]
    assert s.logs('{a="b"} |= ""').count() == 2
