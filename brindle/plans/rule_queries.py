"""Mining and enforcement over the events and the query log, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.logql.compile import LogStore
from brindle.operators import decide, mining, querylog
from brindle.operators import enforce as en
from brindle.operators.mining import LineRule
from brindle.plans.logql_queries import AT, BASE, DAY
from brindle.plans.problems import _CELLS
from brindle.sources.logs import NS, events_as_logs
from brindle.session import table

_LANG = r"\AINFO user [0-9]{1,4} did {} took [0-9]{1,3}ms\z"
RULES = (
    LineRule("r-view", "view", _LANG.replace("{}", "view"), "drop"),
    LineRule("r-click", "click", _LANG.replace("{}", "click"), "sample", 10),
    LineRule("r-signup", "signup", r"\AINFO user [0-9]{1,4} did signup took [0-9]ms\z", "dedupe"),
    LineRule("r-purchase", "purchase", _LANG.replace("{}", "purchase"), "rollup"),
    LineRule("r-error", "error", r"\AERROR user [0-9]{1,4} did error took [0-9]{2}ms\z", "archive", template="ERROR user <*> did error took <*>"),
    LineRule("r-signup-slow", "signup", r"\AINFO user [0-9]{1,4} did signup took [0-9]{3}ms\z", "aggregate"),
)
_SQL_RULE = r"""CASE WHEN service_name = 'view' AND regexp_full_match(line, 'INFO user [0-9]{1,4} did view took [0-9]{1,3}ms') THEN 'r-view'
        WHEN service_name = 'click' AND regexp_full_match(line, 'INFO user [0-9]{1,4} did click took [0-9]{1,3}ms') THEN 'r-click'
        WHEN service_name = 'signup' AND regexp_full_match(line, 'INFO user [0-9]{1,4} did signup took [0-9]ms') THEN 'r-signup'
        WHEN service_name = 'purchase' AND regexp_full_match(line, 'INFO user [0-9]{1,4} did purchase took [0-9]{1,3}ms') THEN 'r-purchase'
        WHEN service_name = 'error' AND regexp_full_match(line, 'ERROR user [0-9]{1,4} did error took [0-9]{2}ms') THEN 'r-error'
        WHEN service_name = 'signup' AND regexp_full_match(line, 'INFO user [0-9]{1,4} did signup took [0-9]{3}ms') THEN 'r-signup-slow' END"""
#: Records at warning or above in the guarded queries: those of pod-3.
_TAGGED = f"WITH {BASE}, tagged AS (SELECT *, {_SQL_RULE} AS hit, CASE WHEN pod <> 'pod-3' THEN hit END AS rule FROM logs)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    e = events_as_logs(spark, d)
    pod = F.col("labels")["pod"]
    return e.select(F.col("labels")["service_name"].alias("service"), pod.alias("pod"), F.col("line").alias("text"), "ts_ns", F.create_map(F.lit("level"), F.when(pod == "pod-3", " Warning").otherwise("info")).alias("attributes"))


def _enforced(spark: SparkSession, d: str) -> en.Enforced:
    return en.enforce(_records(spark, d), RULES, ("service", "pod"))


def rule_measure(spark: SparkSession, d: str) -> DataFrame:
    """Exact lines and bytes of each rule."""
    r = _records(spark, d)
    return mining.measure(r, F.col("service"), F.col("text"), RULES)


def severity_guard(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each rule that the guard keeps from it."""
    r = _records(spark, d)
    both = en.tag(r, RULES).withColumn("hit", mining.rule_of(F.col("service"), F.col("text"), RULES))
    return both.where("hit is not null and rule is null").groupBy("hit").agg(F.count(F.lit(1)).alias("guarded"))


def drop_rule(spark: SparkSession, d: str) -> DataFrame:
    """What passes once all rules act."""
    return _enforced(spark, d).kept.select("service", "pod", "ts_ns", "text")


def aggregate_counter(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the rules."""
    return _enforced(spark, d).volume


def sample_hash_10pct(spark: SparkSession, d: str) -> DataFrame:
    """The deterministic sample of ten percent of all lines."""
    r = _records(spark, d)
    return r.where(en.sample_keeps(r, 10)).select("ts_ns", "text")


def sample_hash_short(spark: SparkSession, d: str) -> DataFrame:
    """The same by the first 15 and the first 13 digits of the digest."""
    r = _records(spark, d)
    return r.select("ts_ns", "text", en.sample_keeps(r, 37, digits=15).alias("by_15"), en.sample_keeps(r, 37, digits=13).alias("by_13"))


def dedupe_batch(spark: SparkSession, d: str) -> DataFrame:
    """Identical lines of a rule folded into one with their count."""
    return _enforced(spark, d).records.where("rule = 'r-signup'").select("service", "pod", "text", "ts_ns", "dedup_count")


def dedupe_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The same per ten minutes of event time."""
    r = en.tag(_records(spark, d), RULES).select("service", "text", "ts_ns", "rule")
    return en.deduped(r, RULES, interval_ns=600 * NS).select("service", "text", F.expr(f"ts_ns div {600 * NS} * 600").alias("window_s"), "dedup_count")


def rollup_records(spark: SparkSession, d: str) -> DataFrame:
    """Marker records of a rollup rule with the lines that they stand for."""
    return _enforced(spark, d).records.where("rule = 'r-purchase'").select("service", "pod", "rule", "text", "ts_ns", "dedup_count")


def archive_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines moved to the archive."""
    return _enforced(spark, d).archive.select("archive", "ts_ns", "text")


def keep_streams(spark: SparkSession, d: str) -> DataFrame:
    """Streams that each rule would empty."""
    r = _records(spark, d)
    return mining.stream_preservation(r, F.col("service"), F.col("pod"), F.col("text"), RULES)


def drift(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a rule's template outside its language."""
    r = _records(spark, d)
    rules = [x for x in RULES if x.template] + [LineRule("r-none", "view", r"\Ax\z", template="no such line <*>"), LineRule("r-all", "view", _LANG.replace("{}", "view"), template="INFO user <*> did view took <*>")]
    return mining.drift(r, F.col("service"), F.col("text"), rules, ts=F.col("ts_ns")).select("rule", "template_lines", "out_of_rule", "status", F.array_join("examples", "|").alias("examples"))


_HALF = (AT - 15 * DAY) * NS


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Each rule's lines in the first and the second half of the window, against its action."""
    r = _records(spark, d)
    out = mining.reconcile(r, F.col("service"), F.col("text"), F.col("ts_ns"), RULES, ((AT - 30 * DAY) * NS, _HALF), (_HALF, AT * NS), F.create_map(F.lit("r-purchase"), F.lit(5)))
    return out.select("rule", "before_lines", "after_lines", "before_bytes", "after_bytes", F.round("kept", 9).alias("kept"), "status")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of each service spread over the window: a bounded sample is the feature."""
    r = _records(spark, d)
    return mining.stratified_sample(r, "service", "ts_ns", "text", (AT - 30 * DAY) * NS, AT * NS, 6, 150).select("service", "ts_ns", "text")


_MASKS = [("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b")]


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    """The sample of each service of log_entries with the template of each line."""
    e = table(spark, d, "log_entries").where("line <> ''").select(F.col("labels")["service_name"].alias("service"), "ts_ns", "line")
    s = mining.stratified_sample(e, "service", "ts_ns", "line", 1_767_571_200 * NS, 1_767_744_000 * NS, 8, 400)
    return mining.template_lines(s, "service", "ts_ns", "line", mining.DrainConfig(masks=_MASKS))


def drain_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of the sample of each service of log_entries, with how many lines of the sample each has."""
    return _sampled(spark, d).groupBy("service", "template").agg(F.count(F.lit(1)).alias("n"))


def infer_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the templates of log_entries: the sample of each service is the feature."""
    level = F.lower(F.regexp_extract("line", r"(?i)\b(trace|debug|info|warn|error|fatal)\b", 1))
    out = mining.infer_languages(_sampled(spark, d).withColumn("severity", level), "service", "line", "severity", _MASKS)
    return out.select("key", "template", "regex", mining.rule_id(F.col("key"), F.lit(""), F.coalesce("regex", F.lit(""))).alias("rule"), "samples", "constant", "levels", "reason")


def querylog_summary(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of requests in the query log."""
    return querylog.request_summary(querylog.classify_requests(table(spark, d, "query_log")))


def querylog_fold(spark: SparkSession, d: str) -> DataFrame:
    """Executions of each query text by component."""
    return querylog.fold_executions(querylog.classify_requests(table(spark, d, "query_log")))


def querylog_merge(spark: SparkSession, d: str) -> DataFrame:
    """One row for each query: writings and legs merged."""
    return querylog.merge_executions(querylog.fold_executions(querylog.classify_requests(table(spark, d, "query_log")))).select("query", "component", "n", "first_ns", "last_ns")


def removed_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Volume and cost a month of each rule, from what it measured over the window."""
    m = rule_measure(spark, d)
    per_day = lambda c: F.col(c) / 30.0
    return m.select("rule", F.round(per_day("bytes"), 6).alias("bytes_per_day"), F.round(mining.monthly_cost(per_day("bytes"), per_day("lines"), 0.5, 2.0), 7).alias("cost"))


def rollup_xyz_equals_original(spark: SparkSession, d: str) -> DataFrame:
    """A count over lines and rollup records, rewritten, equals the count over the lines before they were rolled up."""
    rolled = [LineRule("r-purchase", "purchase", _LANG.replace("{}", "purchase"), "rollup")]
    done = en.enforce(_records(spark, d), rolled, ("service", "pod"))
    labels = F.create_map(F.lit("service_name"), F.col("service"), F.lit("pod"), F.col("pod"))
    raw = done.kept.select(labels.alias("labels"), "ts_ns", F.col("text").alias("line"), F.lit(None).cast("map<string,string>").alias("metadata"))
    meta = F.create_map(F.lit(decide.RULE_LABEL), F.col("rule"), F.lit(decide.COUNT_LABEL), F.col("dedup_count").cast("string"))
    records = done.records.select(labels.alias("labels"), "ts_ns", F.col("text").alias("line"), meta.alias("metadata"))
    rule = decide.Target("r-purchase", (("service_name", "purchase"),), rolled[0].language)
    query, _ = decide.rewrite_counts('sum by (pod) (count_over_time({service_name="purchase"} |= "purchase" [31d]))', [rule], {"service_name", "pod"})
    out = LogStore(raw.unionByName(records), metadata="metadata").instant(query, AT * NS)
    return out.select(F.col("labels")["pod"].alias("pod"), "value")


def canonical_queries(spark: SparkSession, d: str) -> DataFrame:
    """Executed queries in one writing each: whitespace, quoting, outer parentheses and offsets make no difference."""
    q = table(spark, d, "executed_queries").where("query_text is not null").select(F.col("query_text").alias("query"), F.coalesce("exec_count", F.lit(0)).cast("long").alias("n"))
    forms = querylog.with_forms(q.groupBy("query").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("writings")))
    return forms.groupBy("canonical").agg(F.min("query").alias("query"), F.sum("n").alias("n"), F.sum("writings").alias("writings"), F.first(F.size("selections")).alias("selections"))


QUERIES = {
    f.__name__: f
    for f in (
        rollup_xyz_equals_original, canonical_queries,
        rule_measure, severity_guard, drop_rule, aggregate_counter, sample_hash_10pct, sample_hash_short, dedupe_batch, dedupe_tumbling, rollup_records, archive_split, keep_streams, drift, reconcile, stratified_sample,
        drain_templates, infer_languages, querylog_summary, querylog_fold, querylog_merge, removed_per_day,
    )
}

_T10 = f"{(1 << 256) * 10 // 100:064x}"
_KEY = "sha256(line || '|' || ts_ns::VARCHAR)"
_SLICE = 5 * DAY * NS
#: Requests of the query log by kind, as querylog.classify_requests tells them.
_LAST = lambda k: f"coalesce(list_filter(cells, lambda x: x.k = '{k}')[-1].v, '')"
_REQUESTS = rf"""
    WITH {_CELLS(f"regexp_matches(line, '{querylog.PRELIMINARY}')")},
    v AS (SELECT ts_ns, form, {", ".join(f"{_LAST(k)} AS {k}" for k in ("msg", "selectors", "path", "param_query", "caller", "query", "query_type", "source", "component"))} FROM c),
    r AS (SELECT *, CASE WHEN form <> 'good' THEN 'unparsed' WHEN msg = '{querylog.TAIL_MESSAGE}' AND selectors <> '' THEN 'tail' WHEN path = '{querylog.PATTERNS_PATH}' AND param_query <> '' THEN 'patterns'
        WHEN starts_with(caller, 'metrics.go') AND query <> '' THEN CASE WHEN query_type IN ('labels', 'series', 'stats') THEN 'metadata' ELSE 'query' END ELSE 'other' END AS kind FROM v)"""

SQL = {
    "querylog_summary": f"""{_REQUESTS} SELECT count(*) AS lines, count(*) FILTER (kind = 'unparsed') AS unparsed, count(*) FILTER (kind = 'query') AS queries, count(*) FILTER (kind = 'tail') AS tails,
        count(*) FILTER (kind = 'patterns') AS patterns, count(*) FILTER (kind = 'metadata') AS metadata, min(ts_ns) FILTER (kind NOT IN ('unparsed', 'other')) AS oldest FROM r""",
    "querylog_fold": f"""{_REQUESTS}, u AS (SELECT ts_ns, CASE kind WHEN 'query' THEN component ELSE kind END AS component, CASE kind WHEN 'tail' THEN selectors WHEN 'patterns' THEN param_query ELSE query END AS query,
        CASE kind WHEN 'query' THEN query_type ELSE kind END AS query_type, CASE WHEN kind = 'query' THEN nullif(source, '') END AS source FROM r WHERE kind IN ('query', 'tail', 'patterns'))
        SELECT component, query, arg_min(query_type, (ts_ns, query_type)) AS query_type, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, coalesce(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), []) AS sources FROM u GROUP BY 1, 2""",
    "rollup_xyz_equals_original": f"WITH {BASE} SELECT pod, count(*)::DOUBLE AS value FROM logs WHERE service_name = 'purchase' GROUP BY 1",
    "rule_measure": f"{_TAGGED} SELECT hit AS rule, count(*) AS lines, sum(octet_length(encode(line)))::BIGINT AS bytes FROM tagged WHERE hit IS NOT NULL GROUP BY 1",
    "severity_guard": f"{_TAGGED} SELECT hit, count(*) AS guarded FROM tagged WHERE hit IS NOT NULL AND pod = 'pod-3' GROUP BY 1",
    "drop_rule": f"{_TAGGED} SELECT service_name AS service, pod, ts_ns, line AS text FROM tagged WHERE rule IS NULL OR (rule = 'r-click' AND {_KEY} < '{_T10}')",
    "aggregate_counter": f"{_TAGGED} SELECT rule, count(*) AS lines, sum(octet_length(encode(line)))::BIGINT AS bytes FROM tagged WHERE rule IS NOT NULL GROUP BY 1",
    "sample_hash_10pct": f"WITH {BASE} SELECT ts_ns, line AS text FROM logs WHERE {_KEY} < '{_T10}'",
    "sample_hash_short": f"WITH {BASE} SELECT ts_ns, line AS text, {_KEY}[:15] < '{(1 << 60) * 37 // 100:015x}' AS by_15, {_KEY}[:13] < '{(1 << 52) * 37 // 100:013x}' AS by_13 FROM logs",
    "dedupe_batch": f"{_TAGGED} SELECT service_name AS service, pod, line AS text, min(ts_ns) AS ts_ns, count(*) AS dedup_count FROM tagged WHERE rule = 'r-signup' GROUP BY 1, 2, 3",
    "dedupe_tumbling": f"{_TAGGED} SELECT service_name AS service, line AS text, ts_ns // {600 * NS} * 600 AS window_s, count(*) AS dedup_count FROM tagged WHERE rule = 'r-signup' GROUP BY 1, 2, 3",
    "rollup_records": f"{_TAGGED} SELECT service_name AS service, pod, rule, 'brindle rollup r-purchase' AS text, min(ts_ns) AS ts_ns, count(*) AS dedup_count FROM tagged WHERE rule = 'r-purchase' GROUP BY 1, 2, 3",
    "archive_split": f"{_TAGGED} SELECT rule AS archive, ts_ns, line AS text FROM tagged WHERE rule = 'r-error'",
    "keep_streams": f"""{_TAGGED}, s AS (SELECT service_name AS service, pod, min(coalesce(hit, '')) AS low, max(coalesce(hit, '')) AS high FROM tagged GROUP BY 1, 2),
        k AS (SELECT unnest(['view', 'click', 'signup', 'purchase', 'error', 'signup']) AS service, unnest(['r-view', 'r-click', 'r-signup', 'r-purchase', 'r-error', 'r-signup-slow']) AS rule
              UNION SELECT DISTINCT service, '*' FROM s)
        SELECT service, rule, count(*) AS streams, count(*) FILTER (CASE WHEN rule = '*' THEN low <> '' ELSE low = rule AND high = rule END) AS emptied FROM k JOIN s USING (service) GROUP BY 1, 2""",
    "drift": rf"""WITH {BASE} SELECT 'r-error' AS rule, count(*) AS template_lines, count(*) FILTER (NOT regexp_full_match(line, 'ERROR user [0-9]{{1,4}} did error took [0-9]{{2}}ms')) AS out_of_rule,
            CASE WHEN out_of_rule > 0 THEN 'drifting' WHEN template_lines = 0 THEN 'no-traffic' ELSE 'stable' END AS status,
            (SELECT coalesce(string_agg(line, '|' ORDER BY ts_ns, line), '') FROM (SELECT DISTINCT ts_ns, line FROM logs WHERE service_name = 'error' AND regexp_full_match(line, 'ERROR user \S+ did error took \S+')
                AND NOT regexp_full_match(line, 'ERROR user [0-9]{{1,4}} did error took [0-9]{{2}}ms') ORDER BY ts_ns, line LIMIT 3)) AS examples
        FROM logs WHERE service_name = 'error' AND regexp_full_match(line, 'ERROR user \S+ did error took \S+')
        UNION ALL SELECT 'r-none', 0, 0, 'no-traffic', '' UNION ALL SELECT 'r-all', count(*), 0, 'stable', '' FROM logs WHERE service_name = 'view'""",
    "reconcile": f"""{_TAGGED}, m AS (SELECT hit AS rule, count(*) FILTER (ts_ns > {(AT - 30 * DAY) * NS} AND ts_ns <= {_HALF}) AS before_lines, count(*) FILTER (ts_ns > {_HALF} AND ts_ns <= {AT * NS}) AS after_lines,
            coalesce(sum(octet_length(encode(line))) FILTER (ts_ns > {(AT - 30 * DAY) * NS} AND ts_ns <= {_HALF}), 0)::BIGINT AS before_bytes,
            coalesce(sum(octet_length(encode(line))) FILTER (ts_ns > {_HALF} AND ts_ns <= {AT * NS}), 0)::BIGINT AS after_bytes FROM tagged WHERE hit IS NOT NULL GROUP BY 1)
        SELECT *, round(after_lines / before_lines::DOUBLE, 9) AS kept, CASE WHEN rule IN ('r-view', 'r-error', 'r-signup-slow', 'r-purchase') THEN CASE WHEN after_lines = 0 THEN 'ok' ELSE 'mismatch' END
            WHEN before_lines = 0 THEN 'no-traffic' WHEN rule = 'r-click' THEN CASE WHEN abs(kept - 0.1) <= 0.05 THEN 'ok' ELSE 'mismatch' END WHEN kept < 1 THEN 'ok' ELSE 'mismatch' END AS status FROM m""",
    "stratified_sample": f"""WITH {BASE}, i AS (SELECT service_name AS service, ts_ns, line, least((ts_ns - {(AT - 30 * DAY) * NS}) // {_SLICE}, 5) AS slice FROM logs WHERE ts_ns >= {(AT - 30 * DAY) * NS} AND ts_ns < {AT * NS}),
        c AS (SELECT service, slice, count(*) AS n, greatest(1, floor(150.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY service)))::BIGINT AS share FROM i GROUP BY 1, 2),
        p AS (SELECT i.*, n, share, least(20, share) AS parts, least((ts_ns - ({(AT - 30 * DAY) * NS} + slice * {_SLICE})) // ({_SLICE} // least(20, share)), least(20, share) - 1) AS part FROM i JOIN c USING (service, slice)),
        r AS (SELECT *, row_number() OVER (PARTITION BY service, slice, part ORDER BY ts_ns, line) AS rank FROM p)
        SELECT service, ts_ns, line AS text FROM r WHERE share >= n OR rank <= (share + parts - 1) // parts""",
    "removed_per_day": f"{_TAGGED} SELECT hit AS rule, round(sum(octet_length(encode(line))) / 30.0::DOUBLE, 6) AS bytes_per_day, round(30 * (sum(octet_length(encode(line))) / 30.0::DOUBLE / 1e9 * 0.5 + count(*) / 30.0::DOUBLE / 1e6 * 2.0), 7) AS cost FROM tagged WHERE hit IS NOT NULL GROUP BY 1",
}
