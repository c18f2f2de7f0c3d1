"""Verdicts, coverage, rewriting and decisions."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.logql.syntax import parse
from brindle.operators import decide as de
from brindle.operators import usage as us
from brindle.operators.usage import Target
from brindle.relang import automaton as at

S = "service_name"
HEALTH = Target("health", ((S, "checkout"),), r"\AINFO GET /healthz 200 [0-9]{1,3}ms\z")
REQUEST = Target("request", ((S, "checkout"),), r"\AINFO request [0-9a-f]{16} status (?:200|201|404|503) took [0-9]{1,3}ms\z")
LOGIN = Target("login", ((S, "auth"),), r"\AINFO user (?:alice|bob|carol|dave|erin|frank) logged in\z")
ROUTE = Target("route", ((S, "orders"),), r"\Ahandled route in [0-9]{1,3}ms\z", True)
C = '{service_name="checkout"}'

VERDICTS = [
    (C, HEALTH, True), ('{service_name="auth"}', HEALTH, False), ('{service_name=~"check.*"}', HEALTH, True), ('{service_name=~"check"}', HEALTH, False), ('{service_name!="checkout", c=~".+"}', HEALTH, False),
    ('{service_name!~"auth|orders", c=~".+"}', HEALTH, True), ('{namespace="prod"}', HEALTH, True), ('{service_name="$svc"}', HEALTH, True), ('{service_name=~"(?i)CHECKOUT"}', HEALTH, True),
    (C + ' |= "healthz"', HEALTH, True), (C + ' |= "heartbeat"', HEALTH, False), (C + ' |= "status 503"', REQUEST, True), (C + ' |= "status=503"', REQUEST, False), (C + ' |= "status 500"', REQUEST, False),
    (C + ' |~ "status 5[0-9]{2}"', REQUEST, True), (C + ' |~ "took [0-9]{4}ms"', REQUEST, False), (C + ' |= "x" or "healthz"', HEALTH, True), (C + ' |= "x" or "y"', HEALTH, False), (C + ' |= "GET" |= "POST"', HEALTH, False),
    (C + ' != "healthz"', HEALTH, False), (C + ' != "200 1"', HEALTH, True), (C + ' !~ "^INFO"', HEALTH, False), (C + ' != "x" or "healthz"', HEALTH, False), (C + ' != "x" or "y"', HEALTH, True),
    (C + ' |~ "(?i)HEALTHZ"', HEALTH, True), (C + ' |~ "(?i)heartbeat"', HEALTH, False), (C + ' !~ "(?i)healthz"', HEALTH, True), (C + ' |> "<_> nomatch <_>"', HEALTH, True), (C + ' |= ip("10.0.0.0/8")', HEALTH, True),
    (C + ' |= "$search"', HEALTH, True), (C + ' | line_format "x" |= "heartbeat"', HEALTH, True), (C + ' |= "heartbeat" | line_format "x"', HEALTH, False), (C + ' | logfmt | level="nothing"', HEALTH, True),
    (f'sum(count_over_time({C} |= "healthz" [5m]))', HEALTH, True), (f'absent_over_time({C} |= "healthz" [5m])', HEALTH, True), ('{service_name="orders"} |= "nothing like this"', ROUTE, True), ('{service_name="orders"}', ROUTE, True),
    (C + ' |= "x"', ROUTE, False), ('{service_name="auth"} |= "failed MFA"', LOGIN, False), ('{service_name="auth"} |= "logged in"', LOGIN, True),
]


def verdict(q, rule):
    found = [us.evaluate(s, rule) for s in de.readings(parse(q))]
    return next((v for v in found if v.used), found[-1])


@pytest.mark.parametrize("q,rule,used", VERDICTS)
def test_verdict(q, rule, used):
    v = verdict(q, rule)
    assert v.used == used, v
    if v.witness is not None:
        assert at.matches(at.compile(rule.language), v.witness)
    assert not v.widened if not v.used else True


def test_exact_verdicts_have_witnesses_and_widened_ones_say_why():
    assert verdict(C + ' |= "healthz"', HEALTH).widened == ()
    kinds = {q: {w.kind for w in verdict(q, HEALTH).widened} for q, r, u in VERDICTS if u and r is HEALTH}
    assert kinds[C + ' |~ "(?i)HEALTHZ"'] == {"case-insensitive filter"}
    assert kinds['{namespace="prod"}'] == {"selector without a scope label"}
    assert kinds['{service_name="$svc"}'] == {"template variable"}
    assert kinds[C + ' | logfmt | level="nothing"'] == {"label filter"}
    assert verdict(f"rate({C}[1m])", HEALTH).counting and not verdict(C, HEALTH).counting


def test_named_values():
    m = lambda q: us.named_values(parse(q).root.matchers[0])
    assert m('{a="x"}') == ["x"] and m('{a=~"ab-c|d.*"}') is None and m('{a=~"ab-c|(?:de)|f"}') == ["ab-c", "de", "f"] and m('{a=~"a.c"}') is None and m('{a="$x"}') is None and m('{a=~"(?i)ab"}') is None and m('{a!="x",b="y"}') is None


def test_substring_stores_widen():
    s = de.readings(parse(C + ' |~ "heart.*(?:beat|x)"'))[0]
    assert not us.evaluate(s, HEALTH).used and us.evaluate(s, HEALTH, True).used
    plain = de.readings(parse(C + ' |~ ".*heartbeat.*"'))[0]
    assert not us.evaluate(plain, HEALTH, True).used


def test_not_used_is_never_contradicted():
    """Random filters: where a verdict says that no line is read, no sampled line of the language passes."""
    rng = random.Random(3)
    words = ["INFO", "GET", "healthz", "200", "ms", "1", "status", " ", "/", "0ms", "[0-9]{2}ms", "^INFO", "ms$", "(?i)get", "2.*m"]
    lines = [f"INFO GET /healthz 200 {n}ms" for n in range(0, 1000, 7)]
    teeth = 0
    for _ in range(400):
        q = C + "".join(f" {rng.choice(['|=', '!=', '|~', '!~'])} `{rng.choice(words)}`" for _ in range(rng.randint(1, 3)))
        sel = de.readings(parse(q))[0]
        v = us.evaluate(sel, HEALTH)

        def passes(line, sel=sel):
            for f in sel.filters:
                hit = any(t in line if k == "contains" else at.matches(at.compile(t), line) for k, t in f.alternatives)
                if hit == f.negated:
                    return False
            return True

        read = [x for x in lines if passes(x)]
        if not v.used:
            teeth += 1
            assert not read, q
        elif not v.widened:
            assert passes(v.witness), q
        if us.covers(sel, HEALTH):
            assert len(read) == len(lines), q
    assert teeth > 50


CACHE = Target("r-cache", ((S, "checkout"),), r"\ADEBUG cache (?:hit|miss) key [0-9a-f]{8}\z")
SHAPES = [
    (f'sum(count_over_time({C} |= "cache" [5m]))', True), (f'sum(count_over_time({C} |= "cache" [5m])) > 10', True), (f'sum by (ns) (rate({C} |~ "DEBUG" [1m] offset 5m))', True), (f"sum(count_over_time({C} [$__interval]))", True),
    (f"sum((count_over_time({C}[5m])))", True), (f'sum(count_over_time({C} |= "cache" [5m])) by (ns)', True), (f"sum(rate({C} [$__interval]))", False), (f"sum by (trace_id) (count_over_time({C} [5m]))", False),
    (f"sum without (pod) (count_over_time({C} [5m]))", False), (f'count_over_time({C} |= "cache" [5m])', False), (f"sum(bytes_over_time({C} [5m]))", False), (f'sum(count_over_time({C} |= "cache miss" [5m]))', False),
    (f"sum(count_over_time({C} | json [5m]))", False), (f'sum(count_over_time({C} |~ "(?i)cache" [5m]))', False), (f'sum(count_over_time({C} |= "cache" or "x" [5m]))', True), (f'sum(count_over_time({C} != "hit" [5m]))', False),
    (f'sum(count_over_time({C} != "ERROR" [5m]))', True), (f"topk(3, sum(count_over_time({C} [5m])))", True), ('sum(count_over_time({service_name="auth"} [5m]))', False), (f'absent_over_time({C} |= "cache" [5m])', False),
    (f"sum(sum_over_time({C} | logfmt | unwrap x [5m]))", False),
]


@pytest.mark.parametrize("q,changed", SHAPES)
def test_rewritable_shapes(q, changed):
    text, ids = de.rewrite_counts(q, [CACHE], {S, "ns"})
    assert (ids == ["r-cache"]) == changed and (text != q) == changed
    if changed:
        again = de.readings(parse(text))
        assert any(de.compensated(again, s, "r-cache", {"r-cache": CACHE.language}) for s in again)
        assert not any(us.evaluate(s, CACHE).used and not de.compensated(again, s, "r-cache", {"r-cache": CACHE.language}) for s in again)
        assert not any(de.reads_rollups(s, "r-cache", CACHE.scope) for s in again)


def test_rewritten_query_keeps_its_number(spark):
    """Raw lines before, rollup records after, and any mix of both: the rewritten query counts the same."""
    from pyspark.sql import functions as F

    from brindle.logql.compile import LogStore

    raw = [(i, f"DEBUG cache hit key {i:08x}" if i % 3 else f"DEBUG cache stats {i}") for i in range(1, 200)]
    q = f'sum by (service_name) (count_over_time({C} |= "cache" [1m]))'
    text, _ = de.rewrite_counts(q, [CACHE], {S})
    base = {S: "checkout"}

    def answer(query, rows):
        df = spark.createDataFrame(rows, "ts_ns long, line string, labels map<string,string>, meta map<string,string>")
        return [r.value for r in LogStore(df, metadata="meta").instant(query, 10**9).select(F.col("value")).collect()]

    want = answer(q, [(t, x, base, {}) for t, x in raw])
    for removed_from in (0, 100, 500):
        left = [(t, x, base, {}) for t, x in raw if t < removed_from or "hit" not in x]
        n = len(raw) - len(left)
        records = [(150, de.marker("r-cache"), base, {de.RULE_LABEL: "r-cache", de.COUNT_LABEL: str(n)})] if n else []
        assert answer(text, left + records) == want


def candidate(cid="r-1", **kw):
    return de.Candidate(cid, "checkout", HEALTH.language, HEALTH.scope, **({"bytes": 2400.0, "window_hours": 24.0, "stream_labels": (S, "ns")} | kw))


def one(queries=(), gaps=(), policy=None, by_service=(), **kw):
    return de.decide([candidate(**kw)], queries, gaps, policy or de.Policy(), by_service)[0]


def test_actions():
    assert one().action == "aggregate" and one().removed_per_day == 2400
    assert one(policy=de.Policy(("dedupe", "sample"))).action == "sample" and one(policy=de.Policy(("dedupe", "sample"))).removed_per_day == 2160
    assert one(policy=de.Policy(("dedupe",)), constant=True).upper_bound
    assert one(policy=de.Policy(("dedupe",))).blockers == ["no allowed action applies"]
    assert one(policy=de.Policy(("rollup",)), structured=True).action == "none"
    with pytest.raises(ValueError):
        one(policy=de.Policy(("melt",)))


def test_blockers_in_order():
    used = [de.UsedQuery("querylog", "x", C + ' |= "GET"')]
    got = one(used, [de.Gap("k", "s", "o", "why")], de.Policy(exempt=("r-1", "GET"), min_daily_bytes=1e9), severities=("WARNING", "info"), template="INFO GET <*>")
    assert [b.split(" ")[0] for b in got.blockers] == ["evidence", "1", "sampled", "exempt", "template", "only"]
    assert one(gaps=[de.Gap("k", "s", "o", "why")], policy=de.Policy(acknowledged=("k",))).action == "aggregate"
    bad = de.decide([de.Candidate("r-2", "checkout", r"\AERROR x\z", HEALTH.scope, bytes=1.0, window_hours=1.0)], [])[0]
    assert "error-like" in bad.blockers[0]
    assert one([de.UsedQuery("ruler", "x", "not a query")]).readers[0].widened[0].kind == us.UNREADABLE


def test_rollup_needs_every_reader_rewritten():
    stored = de.UsedQuery("dashboard", "d1", f"sum(count_over_time({C} [5m]))", "grafana")
    executed = de.UsedQuery("querylog", "frontend", f"sum(count_over_time({C}[5m]))")
    policy = de.Policy(("rollup",))
    got = one([stored, executed], policy=policy)
    assert got.action == "rollup" and {r[0] for r in got.rewrites} == {"dashboard", "querylog"}
    assert one([stored, de.UsedQuery("querylog", "x", C)], policy=policy).action == "none"
    assert one([stored], policy=policy, by_service=[("checkout", de.Reader("audit", "a", "", True, "x"))]).action == "none"
    again = de.UsedQuery("dashboard", "d1", got.rewrites[0][2], "grafana")
    second = one([again], policy=policy)
    assert second.action == "rollup" and second.readers[0].compensated


def test_verdicts_over_tables(spark):
    rules = spark.createDataFrame([(r.id, dict(r.scope)[S], r.language) for r in (HEALTH, REQUEST, LOGIN)] + [(None, "x", "y")], "id string, service string, language string")
    texts = sorted({q for q, _, _ in VERDICTS}) + ["broken {", None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    got = {(r.rule, r.query_id): r.used for r in de.verdicts(rules, queries, block_rows=15).collect()}
    for i, q in enumerate(texts):
        if q is None:
            continue
        for rule in (HEALTH, REQUEST, LOGIN):
            want = True if q == "broken {" else any(us.evaluate(s, rule).used for s in de.readings(parse(q)))
            assert got.get((rule.id, i), False) == want, (rule.id, q)
    assert len(got) < 3 * len(texts)


@pytest.mark.parametrize("selector", ['{service_name="checkout"}', '{service_name=~"check.+"}'])
def test_verdicts_of_one_service_are_spread(spark, selector):
    """Queries of one service, or of none, are judged in several tasks, however few bytes they are."""
    rules = spark.createDataFrame([("r", "checkout", r"\Auser [0-9]{1,2} in\z")], "id string, service string, language string")
    queries = spark.createDataFrame([(i, f'{selector} |= "user {i} "') for i in range(95, 120)], "query_id long, query string").coalesce(1)
    got = de.verdicts(rules, queries, block_rows=3).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.query_id, r.used) for r in got} == {(i, i < 100) for i in range(95, 120)} and len(got) == 25
    assert len({r.task for r in got}) > 1


def test_one_rewrite_for_all_rules_that_a_query_reads():
    """Two rolled-up rules in one stored query: one text keeps both counts, and each rule is proved in it."""
    hot = de.Candidate("r-hot", "kiln", r"\Akiln hot [0-9]{3}\z", ((S, "kiln"),), bytes=10.0, window_hours=1.0, stream_labels=(S, "pod"))
    cold = de.Candidate("r-cold", "kiln", r"\Akiln cold [0-9]{3}\z", ((S, "kiln"),), bytes=20.0, window_hours=1.0, stream_labels=(S, "pod"))
    board = de.UsedQuery("dashboard", "d/1", 'sum by (pod) (count_over_time({service_name="kiln"} [5m]))', "grafana")
    only = de.UsedQuery("dashboard", "d/2", 'sum(count_over_time({service_name="kiln"} |= "hot" [5m]))', "grafana")
    recs = {r.candidate.id: r for r in de.decide([hot, cold], [board, only], policy=de.Policy(("rollup",)))}
    assert {r.action for r in recs.values()} == {"rollup"}
    texts = {i: dict((o, t) for _, o, t in r.rewrites) for i, r in recs.items()}
    assert texts["r-hot"]["d/1"] == texts["r-cold"]["d/1"] and "d/2" not in texts["r-cold"]
    both = texts["r-hot"]["d/1"]
    assert all(f"{de.MARKER}{i}" in both for i in recs)
    languages = {c.id: c.language for c in (hot, cold)}
    assert all(de._holds(both, c, languages) for c in (hot, cold)) and not de._holds(board.expr, hot, languages)
    # Rewritten for each rule by itself, the text written last would lose the other rule's records.
    alone, _ = de.rewrite_counts(board.expr, [cold.target()], {S, "pod"})
    assert not de._holds(alone, hot, languages)


def test_readers_in_a_table(spark):
    rules = spark.createDataFrame([(r.id, dict(r.scope)[S], r.language, r.structured) for r in (HEALTH, REQUEST, LOGIN, ROUTE)], "id string, service string, language string, structured boolean")
    texts = sorted({q for q, _, _ in VERDICTS}) + ["not a query {"]
    executed = spark.createDataFrame([(i, q, "frontend") for i, q in enumerate(texts)], "query_id long, query string, component string")
    got = {r.rule: r for r in de.executed_readers(rules, executed).collect()}
    for rule in (HEALTH, REQUEST, LOGIN, ROUTE):
        want = [q for q in texts if q.startswith("not") or any(us.evaluate(s, rule).used for s in de.readings(parse(q)))]
        assert got[rule.id].readers == len(want) and got[rule.id].query in want
    assert got["health"].by_kind[us.UNREADABLE] == 1 and got["health"].kinds == []
    none = de.executed_readers(rules, executed.limit(0)).count()
    assert none == 0
    rec = de.decide([de.Candidate("health", "checkout", HEALTH.language, HEALTH.scope, bytes=1.0, window_hours=1.0)], [], executed={"health": (7, de.Reader("querylog", "x", C, False, "r"))})[0]
    assert rec.action == "none" and any("7 queries read" in b for b in rec.blockers)
