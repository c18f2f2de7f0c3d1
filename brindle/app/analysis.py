"""Analysis: sample, templates, languages, exact volume, evidence, decision, streams kept; and its verification later.

Lines and the queries that ran are only touched by DataFrame jobs. The driver sees what is bounded by the configuration: languages of templates (from a bounded sample), one volume
and one reader for each rule, and the queries that are stored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.app.config import Config, window_hours
from brindle.app.files import code, rule_key
from brindle.logql.syntax import canonical
from brindle.operators import decide as de
from brindle.operators import mining, querylog
from brindle.operators.mining import DrainConfig, LineRule
from brindle.operators.usage import Note
from brindle.session import materialize
from brindle.sources.dashboards import ruler_rules

NS = 10**9
REMOVING = ("aggregate", "drop", "sample", "archive")


@dataclass
class Skipped:
    service: str
    template: str
    samples: int
    reason: str


@dataclass
class Report:
    start_ns: int
    end_ns: int
    recommendations: list[de.Recommendation]
    skipped: list[Skipped]
    gaps: list[de.Gap]
    volumes: dict[str, tuple[int, int]] = field(default_factory=dict)
    assumptions: list[tuple[str, int]] = field(default_factory=list)

    def rules(self) -> list[LineRule]:
        return [LineRule(r.candidate.id, r.candidate.service, r.candidate.language, r.action, r.keep, r.candidate.template) for r in self.recommendations if r.action != "none"]

    def removed_per_day(self) -> float:
        return sum(r.removed_per_day for r in self.recommendations)


def drain_config(c: Config, service: str | None = None) -> DrainConfig:
    seeds = c.templating.seeds.get(service, []) if service is not None else [s for k in sorted(c.templating.seeds) for s in c.templating.seeds[k]]
    return DrainConfig(c.templating.depth, c.templating.similarity, masks=sorted(c.templating.masks.items()), seeds=seeds)


def log_rows(spark: SparkSession, c: Config, start_ns: int, end_ns: int) -> DataFrame:
    """service, ts_ns, text, level, labels of the lines of the window: text is the line, or the templated field of a structured service."""
    df = spark.read.parquet(c.logs)
    service = F.col("labels")[c.scope_label]
    df = df.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns) & service.isNotNull() & F.col("line").isNotNull())
    if c.services:
        df = df.where(service.isin(*c.services))
    text = F.col("line")
    for name in sorted(set(c.structured.values())):
        these = [s for s, f in c.structured.items() if f == name]
        text = F.when(service.isin(*these), mining.strict_field(F.col("line"), name)).otherwise(text)
    return df.select(service.alias("service"), "ts_ns", text.alias("text"), mining.level_of(F.col("labels"), None, c.all_severity_keys()).alias("level"), "labels")


def evidence(spark: SparkSession, c: Config, start_ns: int) -> tuple[list[de.UsedQuery], DataFrame | None, list[de.Gap]]:
    """Queries that are stored, those that ran (query_id, query, component; a table, as they may be any number), and what is missing.

    A query that ran and is stored as well is left out of those that ran: it says nothing more.
    """
    queries: list[de.UsedQuery] = []
    executed: DataFrame | None = None
    gaps: list[de.Gap] = []
    ruler_known = False
    if c.ruler_rules:
        found = ruler_rules(spark.read.text(c.ruler_rules, wholetext=True).withColumnRenamed("value", "body")).collect()
        queries += [de.UsedQuery("ruler", f"{r.namespace}/{r.group}/{r.name}", r.expr, "ruler") for r in found if r.gap is None]
        gaps += [de.Gap("ruler", "ruler", f"{r.namespace}/{r.group}", r.gap) for r in found if r.gap is not None]
        ruler_known = not any(r.gap for r in found)
    else:
        gaps.append(de.Gap("ruler", "ruler", "", "not read"))
    if c.query_log:
        requests = materialize(querylog.classify_requests(spark.read.parquet(c.query_log)))
        s = querylog.request_summary(requests).first()
        tolerance = min(max((1 / 100) * 24 * 3600, 60), 3600) * NS
        if s.lines == 0 or s.oldest is None or s.oldest > start_ns + tolerance:
            gaps.append(de.Gap("query-log-window", "querylog", "", "the query log doesn't reach back over the window"))
        if s.unparsed:
            gaps.append(de.Gap("query-log-unparsed", "querylog", "", f"{s.unparsed} request lines don't parse"))
        merged = querylog.merge_executions(querylog.fold_executions(requests))
        if ruler_known:
            merged = merged.where("component is null or component <> 'ruler'")  # the ruler's own rules say more
        if queries:
            stored = spark.createDataFrame([(canonical(q.expr),) for q in queries], "canonical string").distinct()
            merged = merged.join(stored, "canonical", "left_anti")
        executed = materialize(merged.select(F.xxhash64("canonical").alias("query_id"), "query", F.coalesce("component", F.lit("")).alias("component")))
    else:
        gaps.append(de.Gap("query-log", "querylog", "", "not read"))
    return queries, executed, gaps


def _executed_readers(spark: SparkSession, candidates: list[de.Candidate], executed: DataFrame | None, scope_label: str) -> tuple[dict[str, tuple[int, de.Reader]], dict[str, int]]:
    """For each candidate that is read, how many of the queries that ran read it and one of them; and how many of all readings assumed what. A row for each candidate reaches the driver."""
    if executed is None or not candidates:
        return {}, {}
    rules = spark.createDataFrame([(x.id, x.service, x.language, x.structured) for x in candidates], "id string, service string, language string, structured boolean")
    found, kinds = {}, {}
    for r in de.executed_readers(rules, executed, scope_label).collect():
        notes = tuple(Note(k, k) for k in r.kinds or ())
        found[r.rule] = (r.readers, de.Reader("querylog", r.component, r.query, r.counting, r.reason, r.witness, notes))
        for k, n in (r.by_kind or {}).items():
            kinds[k] = kinds.get(k, 0) + n
    return found, kinds


def analyze(spark: SparkSession, c: Config, end_ns: int) -> Report:
    """Rules, who reads their lines, and what may be done about them, over the window that ends at end_ns."""
    hours = window_hours(c.discovery.window)
    start_ns = end_ns - int(hours * 3600 * NS)
    rows = log_rows(spark, c, start_ns, end_ns)
    sample = materialize(mining.stratified_sample(rows.where("text is not null").select("service", "ts_ns", "text", "level"), "service", "ts_ns", "text", start_ns, end_ns, c.discovery.slices, c.discovery.sample_lines))
    masks = sorted(c.templating.masks.items())
    templated = mining.template_lines(sample, "service", "ts_ns", "text", drain_config(c))
    languages = mining.infer_languages(templated, "service", "text", "level", masks).collect()
    skipped = [Skipped(r.key, r.template, r.samples, r.reason) for r in languages if r.regex is None]
    known = {rule_key(r.key, c.structured.get(r.key, ""), r.regex): r for r in languages if r.regex is not None}
    rules = [LineRule(i, r.key, r.regex, template=r.template) for i, r in sorted(known.items())]
    clash = {x for pair in mining.overlapping(rules) for x in pair}
    skipped += [Skipped(r.service, r.template, known[r.id].samples, "overlaps another rule of its service") for r in rules if r.id in clash]
    rules = [r for r in rules if r.id not in clash]
    volumes = {r.rule: (r.lines, r.bytes) for r in mining.measure(rows, F.col("service"), F.col("text"), rules).collect()} if rules else {}
    names = {r.service: tuple(r.names) for r in rows.groupBy("service").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.map_keys("labels")))))).alias("names")).collect()}
    candidates = [
        de.Candidate(r.id, r.service, r.language, ((c.scope_label, r.service),), r.template, r.service in c.structured, known[r.id].constant, float(volumes.get(r.id, (0, 0))[1]), hours, tuple(known[r.id].levels), names.get(r.service, ()))
        for r in rules
    ]
    queries, executed, gaps = evidence(spark, c, start_ns)
    ran, kinds = _executed_readers(spark, candidates, executed, c.scope_label)
    p = c.policy
    policy = de.Policy(tuple(p.actions), p.sample_percent, p.error_pattern, tuple(p.exempt), tuple(p.acknowledged), p.min_daily_bytes)
    recs = de.decide(candidates, queries, gaps, policy, executed=ran)
    _keep_streams(rows, recs)
    recs.sort(key=lambda r: (-r.removed_per_day, r.candidate.id))
    for reader in {(r.source, r.origin, r.expr): r for x in recs for r in x.readers if r.source != "querylog"}.values():
        for k in {w.kind for w in reader.widened}:
            kinds[k] = kinds.get(k, 0) + 1
    return Report(start_ns, end_ns, recs, skipped, gaps, volumes, sorted(kinds.items(), key=lambda kv: (-kv[1], kv[0])))


def _keep_streams(rows: DataFrame, recs: list[de.Recommendation]) -> None:
    """Take away actions that would empty a stream: of a rule by itself, then of all the remaining rules of a service together."""
    by_id = {r.candidate.id: r for r in recs}
    stream = F.xxhash64(F.sort_array(F.map_entries("labels")))

    def block(r: de.Recommendation, why: str) -> None:
        r.action, r.keep, r.removed_per_day, r.rewrites = "none", 0, 0.0, []
        r.blockers.append(why)

    for together in (False, True):
        acting = [LineRule(i, r.candidate.service, r.candidate.language) for i, r in by_id.items() if r.action in REMOVING]
        if not acting:
            return
        for x in mining.stream_preservation(rows, F.col("service"), stream, F.coalesce("text", F.lit("")), acting).where("emptied > 0").collect():
            if not together and x.rule != "*":
                block(by_id[x.rule], f"{x.emptied} of {x.streams} streams hold only these lines; removing them would make those streams disappear")
            elif together and x.rule == "*":
                for r in acting:
                    if r.service == x.service:
                        block(by_id[r.id], f"together with the other rules of {x.service}, removing these lines would empty {x.emptied} streams")


def report_json(r: Report) -> str:
    rec = lambda x: {
        "id": x.candidate.id, "service": x.candidate.service, "template": x.candidate.template, "language": x.candidate.language, "action": x.action, "keep": x.keep, "removed_bytes_per_day": x.removed_per_day, "upper_bound": x.upper_bound,
        "blockers": x.blockers, "rewrites": [list(w) for w in x.rewrites], "readers": [{"source": q.source, "origin": q.origin, "expr": q.expr, "counting": q.counting, "witness": q.witness, "reason": q.reason, "widened": list(q.widened)} for q in x.readers],
    }
    return json.dumps({
        "start_ns": r.start_ns, "end_ns": r.end_ns, "removed_bytes_per_day": r.removed_per_day(), "recommendations": [rec(x) for x in r.recommendations], "skipped": [vars(s) for s in r.skipped],
        "gaps": [vars(g) for g in r.gaps], "assumptions": [list(a) for a in r.assumptions],
    }, indent=1, ensure_ascii=False)


def report_markdown(r: Report) -> str:
    out = ["# Log usage", "", f"{len(r.recommendations)} rules, {sum(x.action != 'none' for x in r.recommendations)} acting; {r.removed_per_day() / 1e6:.1f} MB a day.", "", "| rule | service | template | action | bytes a day | why not |", "|---|---|---|---|---|---|"]
    for x in r.recommendations:
        c = x.candidate
        why = "; ".join(code(b).replace("|", "\\|") for b in x.blockers[:3])
        out.append(f"| {c.id} | {code(c.service)} | {code(c.template).replace('|', chr(92) + '|')} | {x.action} | {x.removed_per_day:.0f} | {why} |")
    if r.gaps:
        out += ["", "## Evidence that is missing", ""] + [f"- {code(g.key)}: {code(g.reason)}" for g in r.gaps]
    if r.assumptions:
        out += ["", "## Readers by assumption", ""] + [f"- {k}: {n}" for k, n in r.assumptions]
    if r.skipped:
        out += ["", "## Templates without a rule", ""] + [f"- {code(s.service)} {code(s.template)}: {code(s.reason)}" for s in r.skipped]
    return "\n".join(out) + "\n"


@dataclass
class Verification:
    violations: list[tuple[str, de.Reader]]
    drift: list[tuple[str, str, int, int]]
    gaps: list[de.Gap]
    keep: list[str]

    @property
    def ok(self) -> bool:
        return not self.violations and not self.gaps and all(status != "drifting" for _, status, _, _ in self.drift)


def verify(spark: SparkSession, c: Config, rules: list[LineRule], end_ns: int) -> Verification:
    """Whether rules in force may stay: nobody reads their lines now, evidence is whole, and no template has grown out of its rule."""
    start_ns = end_ns - int(window_hours(c.discovery.window) * 3600 * NS)
    queries, executed, gaps = evidence(spark, c, start_ns)
    gaps = [g for g in gaps if g.key not in c.policy.acknowledged]
    parsed = de._parsed(queries)
    languages = {r.id: r.language for r in rules}
    found = []
    candidates = [de.Candidate(r.id, r.service, r.language, ((c.scope_label, r.service),), r.template, r.service in c.structured) for r in rules]
    ran, _ = _executed_readers(spark, candidates, executed, c.scope_label)
    for r, cand in zip(rules, candidates, strict=True):
        found += [(r.id, ran[r.id][1])] if r.id in ran else []
        found += [(r.id, q) for q in de.readers_of(cand, parsed, languages, False) if not (r.action == "rollup" and q.compensated)]
    rows = log_rows(spark, c, start_ns, end_ns)
    drifting = mining.drift(rows, F.col("service"), F.col("text"), rules, sorted(c.templating.masks)).collect() if rules else []
    bad = {i for i, _ in found} | {d.rule for d in drifting if d.status == "drifting"}
    return Verification(found, [(d.rule, d.status, d.template_lines, d.out_of_rule) for d in drifting], gaps, [] if gaps else [r.id for r in rules if r.id not in bad])
