"""Mining, enforcement in batch and on streams, and the query log."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators import enforce as en
from brindle.operators import mining, querylog
from brindle.operators.mining import LineRule
from brindle.relang import automaton as at
from brindle.sources import logs
from brindle.streaming.enforcement import OUTPUTS, start_enforcement

IP = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}"

# --- Templates and languages -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    return logs.synthetic_logs(spark, 4000, seed=11).select("service", "template_id", "message").collect()


def seeds(corpus):
    """A template of each ground-truth pattern: tokens that vary are wild, addresses masked."""
    by = {}
    for r in corpus:
        by.setdefault((r.service, r.template_id), []).append(re.sub(IP, "<ip>", r.message).split(" "))
    return {k: " ".join(c[0] if len(set(c)) == 1 else "<*>" for c in zip(*v, strict=True)) for k, v in by.items()}


def drained(corpus, seeded):
    out = {}
    for service in ("kiln", "ferry", "loom"):
        rows = [r for r in corpus if r.service == service]
        config = mining.DrainConfig(masks=[("ip", IP)], seeds=[t for (s, _), t in sorted(seeds(corpus).items()) if s == service] if seeded else [])
        for r, t in zip(rows, mining.templates_of([r.message for r in rows], config), strict=True):
            out.setdefault((service, t), set()).add(r.template_id)
    return out


def test_seeded_templates(corpus):
    by = drained(corpus, True)
    assert len(by) == 12
    assert {t: ids for (_, t), ids in by.items() if len(ids) > 1} == {"DEBUG door sensor <*> reads <*>": {"door-open", "door-shut"}}
    assert len({i for ids in by.values() for i in ids}) == 13
    assert any("<ip>" in t and ids == {"token"} for (_, t), ids in by.items())  # literal mask text is taken for a mask


def test_config_digest_changes_with_everything():
    a = mining.DrainConfig()
    others = [mining.DrainConfig(depth=5), mining.DrainConfig(similarity=0.5), mining.DrainConfig(masks=[("a", "b")]), mining.DrainConfig(seeds=["x"])]
    assert len({c.digest() for c in [a, *others]}) == 5 and a.digest() == mining.DrainConfig().digest()


def languages(corpus):
    out = {}
    by = {}
    for (service, t), _ in drained(corpus, True).items():
        by[(service, t)] = []
    for service in ("kiln", "ferry", "loom"):
        rows = [r for r in corpus if r.service == service]
        config = mining.DrainConfig(masks=[("ip", IP)], seeds=[t for (s, _), t in sorted(seeds(corpus).items()) if s == service])
        for r, t in zip(rows, mining.templates_of([r.message for r in rows], config), strict=True):
            by[(service, t)].append(r.message)
    for (service, t), texts in by.items():
        if len(texts) >= 20:
            out[f"{service}|{t}"] = mining.infer_language(t, texts, [("ip", IP)])["regex"]
    return out


def test_languages_of_the_corpus(corpus):
    got = languages(corpus)
    assert got["kiln|INFO kiln idle"] == r"\AINFO kiln idle\z"
    assert got["kiln|INFO batch <*> fired at <*> for <*>"] == r"\AINFO batch [0-9]{6} fired at [0-9]{3,4}C for [0-9]{1,3}ms\z"
    assert got["kiln|INFO probe /ready answered <*> in <*>"] == r"\AINFO probe /ready answered (?:200|204|429|503) in [0-9]{1,3}ms\z"
    assert got["kiln|DEBUG door sensor <*> reads <*>"] == r"\ADEBUG door sensor [0-9a-f]{8} reads (?:open|shut)\z"
    assert got["kiln|WARN vent <*> sticks near <ip>"] == rf"\AWARN vent (?:1|2|3|4|5) sticks near (?:{IP})\z"
    assert got["ferry|INFO passenger <*> boarded deck <*>"] == r"\AINFO passenger (?:ines|jorn|kofi|lena|mira|noor) boarded deck (?:1|2|3|4|5)\z"
    assert got["loom|cloth <*> woven on frame <*>"] == r"\Acloth [0-9]{6} woven on frame [0-9a-f]{16}\z"
    rules = [LineRule(f"r-{i}", k.split("|")[0], v) for i, (k, v) in enumerate(got.items())]
    assert mining.overlapping(rules) == []
    probe, boarded = (at.compile(got[k]) for k in ("kiln|INFO probe /ready answered <*> in <*>", "ferry|INFO passenger <*> boarded deck <*>"))
    assert at.overlap(probe, at.literal("answered 429")) and not at.overlap(probe, at.literal("answered 500"))
    assert not at.overlap(boarded, at.literal("WARN passenger ines missed the gate and boarded late"))


def test_too_few_and_misaligned():
    with pytest.raises(mining.TooFewSamples):
        mining.infer_language("a <*>", ["a 1", "a 2"])
    got = mining.infer_language("user <*> logged in", ["user alice logged in"] * 30 + ["user  alice logged in", " user alice logged in"])
    assert got["skipped"] == 2 and not at.matches(at.compile(got["regex"]), "user  alice logged in")
    assert "[a-z]+" in mining.infer_language("blob <*>", ["blob " + "x" * (1200 + i) for i in range(25)])["regex"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="aB1_-.é\n ", min_size=0, max_size=4), min_size=3, max_size=3), min_size=20, max_size=30))
def test_language_accepts_its_samples(rows):
    samples = [" ".join(x.replace(" ", "") for x in r) for r in rows]
    got = mining.infer_language("<*> <*> <*>", samples)
    p = at.compile(got["regex"])
    assert all(at.matches(p, s) for s in samples)


def test_rule_ids(spark):
    import hashlib

    df = spark.createDataFrame([("svc", "", r"\Ax\z")], "s string, f string, l string")
    want = "r-" + hashlib.sha256(b"svc\0\0\\Ax\\z").hexdigest()[:12]
    assert df.select(mining.rule_id(F.col("s"), F.col("f"), F.col("l"))).first()[0] == want


def test_strict_field(spark):
    rows = ['{"m": "x"}', '{"m": 5}', '{"m": "x"} trailing', "[1]", "no", None, '{"m": NaN}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "line string")
    assert [r[0] for r in df.select(mining.strict_field(F.col("line"), "m")).collect()] == ["x", None, None, None, None, None, None, None]


def test_level_cascade(spark):
    df = spark.createDataFrame([({"log_level": "WARN"},), ({"level": "", "lvl": "x"},), (None,)], "labels map<string,string>")
    assert [r[0] for r in df.select(mining.level_of(F.col("labels"), None, ["level", "log.level", "lvl"])).collect()] == ["WARN", "x", ""]


#: Lines before, after and in rollup records for which each action has done what it should, within 5%; what else is counted is a mismatch.
DONE = {
    ("drop", 0): lambda b, a, r: a == 0,
    ("aggregate", 0): lambda b, a, r: a == 0,
    ("archive", 0): lambda b, a, r: a == 0,
    ("sample", 20): lambda b, a, r: abs(a / b - 0.2) <= 0.05 if b else None,
    ("rollup", 0): lambda b, a, r: a == 0 and r > 0,
    ("dedupe", 0): lambda b, a, r: a < b,
    ("vaporise", 0): lambda b, a, r: False,
}


def test_reconcile_statuses(spark):
    rows = [(action, keep, b, a, r, a / b if b else 0.0) for action, keep in DONE for b in (0, 200, 5000) for a in sorted({0, 1, b // 5, b // 2, b}) for r in (0, 40) if a <= b]
    df = spark.createDataFrame(rows, "action string, keep int, b long, a long, r long, kept double")
    seen = set()
    for x in df.withColumn("got", mining.reconcile_status(F.col("action"), F.col("keep"), F.col("b"), F.col("a"), F.col("r"), F.col("kept"), 0.05)).collect():
        seen.add(x.got)
        if x.b or x.action == "vaporise":
            assert (x.got == "ok") == bool(DONE[x.action, x.keep](x.b, x.a, x.r)), x
    assert {"ok", "mismatch", "no-traffic"} <= seen


def test_thousands_of_rules(spark):
    rules = [LineRule(f"r-{i}", f"svc{i % 2}", rf"\AINFO step{i} done in [0-9]{{1,3}}ms\z") for i in range(5000)]
    rules += [LineRule("r-a", "svc0", r"\A[a-z]+ only\z"), LineRule("r-b", "svc1", r"\AINFO (?:up|down)\z"), LineRule("r-c", "svc1", r"\AINFO total [0-9]+\z")]
    assert mining.leading_words(rules[7].language) == "INFO step7 done" and mining.leading_words(r"\AINFO (?:up|down)\z") == "INFO" and mining.leading_words("INFO x y") == "" and mining.leading_words(r"\Aa b*\z") == "a"
    texts = [(f"svc{i % 3}", f"INFO step{i} done in {i % 1500}ms", "own") for i in range(0, 6000, 7)] + [("svc0", "word only", "o"), ("svc1", "INFO up", "o"), ("svc1", "INFO total 7", "o"), ("svc1", "INFO", "o"), (None, "INFO up", "o"), ("svc1", None, "o"), ("svc1", "", "o")]
    df = spark.createDataFrame(texts, "service string, text string, rule_name string")
    got = {(r.service, r.text): r.rule for r in mining.with_rule(df, F.col("service"), F.col("text"), rules).collect()}
    for service, text, _ in texts:
        want = [r.id for r in rules if r.service == service and text is not None and re.fullmatch(r.language[2:-2], text)]
        assert got[service, text] == (want[0] if want else None), (service, text)
    assert mining.overlapping([*rules, LineRule("r-x", "svc1", r"\AINFO step7 .*\z")]) == [("r-7", "r-x")]
    assert mining.with_rule(df, F.col("service"), F.col("text"), rules).columns == [*df.columns, "rule"]
    assert mining.measure(df, F.col("service"), F.col("text"), rules).count() == len({r for r in got.values() if r})


# --- Enforcement -----------------------------------------------------------------------------------------------------

RULES = [
    LineRule("r-a", "web", r"\Aa [0-9]+\z", "drop"), LineRule("r-b", "web", r"\Ab [0-9]+\z", "aggregate"), LineRule("r-c", "web", r"\Ac [0-9]+\z", "sample", 30), LineRule("r-d", "web", r"\Adup\z", "dedupe"),
    LineRule("r-e", "web", r"\Ae [0-9]+\z", "rollup"), LineRule("r-f", "web", r"\Af [0-9]+\z", "archive"), LineRule("r-g", "api", r"\Aa [0-9]+\z", "drop"),
]
SCHEMA = "service string, pod string, text string, ts_ns long, observed_ns long, severity_number int, severity_text string, attributes map<string,string>, rule_name string"


def records(spark, n=600):
    rows = []
    for i in range(n):
        text = [f"a {i}", f"b {i}", f"c {i}", "dup", f"e {i}", f"f {i}", "a x", None, "", "a 1\n"][i % 10]
        service = ["web", "web", "web", "api", None][i % 5 if i % 3 else 0]
        level = [None, "info", "warn", " Error", "WARNING"][i % 5 if i % 7 == 0 else 0]
        rows.append((service, f"p{i % 2}", text, None if i % 11 == 0 else i, i + 7, 17 if i % 13 == 0 else None, "FATAL" if i % 17 == 0 else None, {"log.level": level} if level else None, "own"))
    return spark.createDataFrame(rows, SCHEMA)


def test_enforced_counts_conserve(spark):
    df = records(spark)
    e = en.enforce(df, RULES, ("service", "pod"))
    volume = {r.rule: r.lines for r in e.volume.collect()}
    sampled_out = df.count() - e.kept.count() - sum(volume.get(r, 0) for r in ("r-a", "r-b", "r-d", "r-e", "r-f", "r-g"))
    assert 0 < sampled_out < volume["r-c"]
    counts = {r.rule: r.n for r in e.records.groupBy("rule").agg(F.sum("dedup_count").alias("n")).collect()}
    assert counts == {"r-d": volume["r-d"], "r-e": volume["r-e"]}
    assert e.archive.count() == volume["r-f"] and {r.archive for r in e.archive.select("archive").collect()} == {"r-f"}
    assert e.kept.columns == df.columns


def test_guard_wins_over_every_rule(spark):
    df = records(spark)
    kept = en.enforce(df, RULES, ("service",)).kept
    severe = df.where(en.severe(df, en.Layout()))
    assert severe.count() > 50 and severe.drop("attributes").exceptAll(kept.drop("attributes")).isEmpty()


def test_shadow_changes_nothing(spark):
    df = records(spark)
    e, real = en.enforce(df, RULES, ("service",), shadow=True), en.enforce(df, RULES, ("service",))
    a, b = e.kept.drop("attributes"), df.drop("attributes")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and e.records.isEmpty() and e.archive.isEmpty()
    assert {tuple(r) for r in e.volume.collect()} == {tuple(r) for r in real.volume.collect()}


def test_sample_is_the_hash_predicate(spark):
    import hashlib

    df = records(spark)
    got = Counter((r.text, r.ts_ns) for r in df.where(en.sample_keeps(df, 30)).collect())
    limit = (1 << 256) * 30 // 100
    want = Counter((r.text, r.ts_ns) for r in df.collect() if int(hashlib.sha256(f"{r.text or ''}|{r.ts_ns or r.observed_ns}".encode()).hexdigest(), 16) < limit)
    assert got == want
    many = spark.range(100_000).select(F.lit("same").alias("text"), F.col("id").alias("ts_ns"))
    assert abs(many.where(en.sample_keeps(many, 25)).count() / 100_000 - 0.25) < 0.01


def test_empty_and_bad_rules(spark):
    e = en.enforce(records(spark).limit(0), RULES, ("service",))
    assert e.kept.count() == e.records.count() == e.archive.count() == e.volume.count() == 0
    assert en.enforce(records(spark), [], ("service",)).kept.count() == 600
    for bad in ([LineRule("x", "s", "a")], [LineRule("r-x", "s", "a", "melt")], [LineRule("r-x", "s", "(", "drop")], [LineRule("r-x", "s", "a", "sample", 100)], [LineRule("r-x", "s", r"\Aa+\z"), LineRule("r-y", "s", r"\Aaa\z")], [LineRule("r-x", "s", "a"), LineRule("r-x", "t", "a")]):
        with pytest.raises(ValueError):
            en.check_rules(bad)


def test_stream_equals_batch(spark, tmp_path):
    df = records(spark)
    source = str(tmp_path / "in")
    df.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(source)
    q = start_enforcement(stream, RULES, str(tmp_path / "out"), str(tmp_path / "cp"), ("service", "pod"), interval=None)
    q.awaitTermination(120)
    got = {name: spark.read.parquet(str(tmp_path / "out" / name)) for name in OUTPUTS}
    e = en.enforce(df, RULES, ("service", "pod"))
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    key = lambda d: d.select("service", "pod", "text", "ts_ns")
    assert same(key(got["kept"]), key(e.kept)) and same(key(got["archive"]), key(e.archive))
    total = lambda d, n, c: {r[0]: r[1] for r in d.groupBy("rule").agg(F.sum(c).alias(n)).collect()}
    assert total(got["volume"], "n", "lines") == total(e.volume, "n", "lines")
    assert total(got["records"], "n", "dedup_count") == total(e.records, "n", "dedup_count")
    assert got["volume"].select("batch").distinct().count() > 1


# --- The query log ---------------------------------------------------------------------------------------------------

S = 10**9


def line(query, component="frontend", kind="metric", extra=""):
    c = f" component={component}" if component else ""
    q = query.replace("\\", "\\\\").replace('"', '\\"')
    return f'level=info caller=metrics.go:237{c} org_id=fake query_type={kind} query="{q}"{extra}'


def read(spark, rows):
    r = querylog.classify_requests(spark.createDataFrame(rows, "ts_ns long, line string"))
    return querylog.request_summary(r).first(), {x.query: x for x in querylog.merge_executions(querylog.fold_executions(r)).collect()}


def test_index_only_requests(spark):
    s, q = read(spark, [(i, line('{a="b"}' + f' |= "{i}"', kind=k)) for i, k in enumerate(["labels", "series", "stats", "filter", "metric"])] + [(9, None), (9, ""), (9, "caller=metrics.go x=\"")])
    assert (s.metadata, s.queries, s.unparsed, s.oldest, len(q)) == (3, 2, 1, 0, 2)


def test_every_component_counts(spark):
    full = 'sum(count_over_time({a="b"} |= "x" [5m])) > 1'
    rows = [
        (0, line(full)), (1, line('sum(count_over_time({a="b"} |= "x"[5m] offset 1h0m0s)) > 1', "querier")), (2, line('(sum(count_over_time({a="b"} |= "x"[5m])) > 1)', "ruler")),
        (3, line('{a="direct"}', "querier")), (4, line('{a="nocomponent"}', "")),
        (5, 'caller=tailer.go msg="starting to tail logs" selectors="{a=\\"t\\"}"'), (6, 'caller=http.go path=/loki/api/v1/patterns param_query="{a=\\"p\\"}" status=200'),
        (7, line('{a="own"}', extra=" source=Brindle")), (8, line('{brindle_probe="brindle_probe_1"}')), (9, line('{a="b"} |= "brindle_probe_"')),
    ]
    s, q = read(spark, rows)
    assert {k: x.n for k, x in q.items()} == {full: 3, '{a="direct"}': 1, '{a="nocomponent"}': 1, '{a="t"}': 1, '{a="p"}': 1, '{a="b"} |= "brindle_probe_"': 1}
    assert (s.tails, s.patterns) == (1, 1) and (q[full].first_ns, q[full].last_ns, q[full].component) == (0, 0, "frontend")  # legs add to the count only


def test_legs(spark):
    full = '(sum(count_over_time({a="b"} != "x" [5m])) + sum(count_over_time({a="b"} |~ "y" [5m])))'
    _, q = read(spark, [(0, line('sum(count_over_time({a="b"} |~ "y"[5m] offset 1m0s))', "querier")), (S, line(full)), (480 * S, line('sum(count_over_time({a="b"} |~ "y"[5m]))', "querier"))])
    # Both texts of the leg are one execution set each: the first lies near its host, the other doesn't.
    assert {k: x.n for k, x in q.items()} == {full: 2, 'sum(count_over_time({a="b"} |~ "y"[5m]))': 1}


def test_a_query_that_reads_more_is_its_own(spark):
    host = '{a="b"} |= "x" |= "y"'
    rows = [(0, line(host, kind="filter")), (S, line('{a="b"} |= "x"', "querier")), (2 * S, line('{a="b"}', "querier")), (3 * S, line(host + " offset 1m0s", "querier")), (4 * S, line('sum(count_over_time({a="b"} |= "x" |= "y" [5m]))', "querier"))]
    _, q = read(spark, rows)
    assert {k: x.n for k, x in q.items()} == {host: 2, '{a="b"} |= "x"': 1, '{a="b"}': 1, 'sum(count_over_time({a="b"} |= "x" |= "y" [5m]))': 1}


def test_empty_query_log(spark):
    r = querylog.classify_requests(spark.createDataFrame([], "ts_ns long, line string"))
    assert querylog.request_summary(r).first().lines == 0 and querylog.merge_executions(querylog.fold_executions(r)).count() == 0


# --- Sources ---------------------------------------------------------------------------------------------------------


def test_decoders(spark):
    body = '{"status":"success","data":{"resultType":"streams","result":[{"stream":{"a":"b"},"values":[["1","x"],["2","y"]]},{"stream":{},"values":[]}]}}'
    df = spark.createDataFrame([(body,), (None,), ("bad",)], "body string")
    assert [tuple(r) for r in logs.decode_streams(df).collect()] == [({"a": "b"}, 1, "x"), ({"a": "b"}, 2, "y")]
    body = '{"status":"success","data":{"resultType":"vector","result":[{"metric":{"a":"b"},"value":[12.5,"3"]}]}}'
    assert [tuple(r) for r in logs.decode_vector(spark.createDataFrame([(body,)], "body string")).collect()] == [({"a": "b"}, 12.5, 3.0)]


def test_days_are_pruned(spark, tmp_path):
    day = 86_400 * S
    df = spark.createDataFrame([(i * day // 2, f"l{i}") for i in range(10)], "ts_ns long, line string")
    logs.write_by_day(df, str(tmp_path / "logs"))
    got = logs.day_pruned(str(tmp_path / "logs"), spark, day, 2 * day)
    assert sorted(r.ts_ns for r in got.collect()) == [day, day + day // 2]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="outside"):
        logs.in_range(df, 0, day).collect()


def test_languages_are_those_of_the_folder(spark, tmp_path):
    from brindle.plans import rule_queries

    rows = [(i, {"service_name": "kiln"}, 1_767_571_200 * logs.NS + i * logs.NS, f"INFO batch {i % 7} left kiln") for i in range(60)]
    spark.createDataFrame(rows, "entry_id long, labels map<string,string>, ts_ns long, line string").write.parquet(str(tmp_path / "log_entries.parquet"))
    got = rule_queries.infer_languages(spark, str(tmp_path)).collect()
    assert [(r.key, r.template, r.levels) for r in got] == [("kiln", "INFO batch <*> left kiln", ["info"])]
    assert re.fullmatch(got[0].regex.replace(r"\A", "").replace(r"\z", ""), "INFO batch 3 left kiln")
