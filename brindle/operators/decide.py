"""From measured rules and evidence of reading to recommendations; and the rewriting of counts that a rollup would change."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.logql import ast
from brindle.logql.syntax import QueryFault, canonical, go_quote, parse, quote
from brindle.operators.enforce import SEVERE
from brindle.operators.ordering import piece_count
from brindle.operators.usage import BROKEN, UNREADABLE, Note, Reading, Target, covers, evaluate, named_values, reading
from brindle.relang import automaton as at
from brindle.relang import syntax as sx
from brindle.session import materialize

RULE_LABEL = "brindle_rule"
COUNT_LABEL = "dedup_count"
MARKER = "brindle rollup "
#: Fixed value: words that make a line error-like.
ERROR_WORDS = r"(?i)(?:\b|_)(?:err|error|errors|warn|warning|fatal|crit|critical|panic|exception|fail|failed|failure|denied|refused|timeout|timed out|unavailable|declined|emerg|alert)(?:\b|_)"
#: The queries that name a service are dealt to so many parts at most, each with a copy of the service's rules.
PARTS = 32
ACTIONS = ("archive", "aggregate", "dedupe", "sample", "drop", "rollup")


@dataclass(frozen=True)
class Candidate:
    id: str
    service: str
    language: str
    scope: tuple[tuple[str, str], ...]
    template: str = ""
    structured: bool = False
    constant: bool = False
    bytes: float = 0.0
    window_hours: float = 0.0
    severities: tuple[str, ...] = ()
    stream_labels: tuple[str, ...] = ()

    def target(self) -> Target:
        return Target(self.id, self.scope, self.language, self.structured)


@dataclass(frozen=True)
class UsedQuery:
    source: str
    origin: str
    expr: str
    #: The store that holds the query, empty where it can't be rewritten.
    store: str = ""


@dataclass(frozen=True)
class Gap:
    """Evidence that is missing; it blocks every rule unless its key is acknowledged."""

    key: str
    source: str
    origin: str
    reason: str


@dataclass(frozen=True)
class Policy:
    actions: tuple[str, ...] = ("aggregate", "dedupe", "sample")
    sample_percent: int = 10
    error_pattern: str = ERROR_WORDS
    exempt: tuple[str, ...] = ()
    acknowledged: tuple[str, ...] = ()
    min_daily_bytes: float = 0.0


@dataclass(frozen=True)
class Reader:
    source: str
    origin: str
    expr: str
    counting: bool
    reason: str
    witness: str | None = None
    widened: tuple[str, ...] = ()
    rewrite: str | None = None
    #: Already rewritten for a rollup of these lines.
    compensated: bool = False


@dataclass
class Recommendation:
    candidate: Candidate
    action: str = "none"
    keep: int = 0
    readers: list[Reader] = field(default_factory=list)
    blockers: list[str] = field(default_factory=list)
    rewrites: list[tuple[str, str, str]] = field(default_factory=list)
    removed_per_day: float = 0.0
    upper_bound: bool = False


def readings(query: ast.Query) -> list[Reading]:
    return [reading(q, counting, RULE_LABEL) for q, counting in query.logs]


def marker(rule: str) -> str:
    return MARKER + rule


def marker_ids(f: ast.LineFilter) -> list[str]:
    """The rules whose rollup records a filter selects, none where it isn't such a filter."""
    ids = [t[len(MARKER) :] for k, t in f.alternatives if k == "contains" and t.startswith(MARKER)]
    return ids if not f.negated and len(ids) == len(f.alternatives) and all(ids) else []


def union_of(languages: Sequence[str]) -> str:
    return languages[0] if len(languages) == 1 else "|".join(f"(?:{x})" for x in languages)


def reads_rollups(sel: Reading, rule: str, scope: tuple[tuple[str, str], ...]) -> bool:
    """Whether a selection can select a rule's rollup records other than as a rollup's own term."""
    if sel.no_rollups or any(rule in marker_ids(f) for f in sel.filters):
        return False
    return evaluate(sel, Target(rule, scope, rf"\A{sx.quote(marker(rule))}\z")).used


def compensated(sels: Sequence[Reading], sel: Reading, rule: str, languages: dict[str, str]) -> bool:
    """Whether a selection counts exactly the raw lines whose rollup records the same query counts through the same selector."""
    if not sel.counting or sel.rewritten or len(sel.filters) != 1 or sel.filters[0].negated or len(sel.filters[0].alternatives) != 1 or sel.filters[0].alternatives[0][0] != "regex":
        return False
    for other in sels:
        if other.matchers != sel.matchers:
            continue
        for f in other.filters:
            ids = marker_ids(f)
            if rule in ids and all(i in languages for i in ids) and sel.filters[0].alternatives[0][1] == union_of([languages[i] for i in ids]):
                return True
    return False


# --- Rewriting of counts ---------------------------------------------------------------------------------------------

_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "y": 31_536_000}


def range_seconds(text: str) -> float | None:
    if not re.fullmatch(r"(?:[0-9]+(?:ms|[smhdwy]))+", text):
        return None
    return sum(int(n) * _SECONDS[u] for n, u in re.findall(r"([0-9]+)(ms|[smhdwy])", text)) or None


def _outer_sum(a: str, b: str) -> str:
    return f"(({a} + {b}) or {a} or {b})"


def rewrite_counts(expr: str, rules: Sequence[Target], stream_labels: set[str]) -> tuple[str, list[str]]:
    """(query, ids of the rules it was rewritten for): counts that read rules' lines read their rollup records too.

    A sum by stream labels of a plain count_over_time or rate that keeps every line of some rules becomes X + Y + Z: the count without the rules' lines, the count that
    their rollup records hold, and the raw lines still there. Every other count is left as it is.
    """
    q = parse(expr)
    sel_of = {id(log): reading(log, c, RULE_LABEL) for log, c in q.logs}
    edits: list[tuple[int, int, str]] = []
    done: set[str] = set()
    for v in q.vectors:
        inner = v.inner
        if v.func != "sum" or v.param is not None or not isinstance(inner, ast.RangeAgg) or v.grouping is not None and (v.grouping.without or not set(v.grouping.labels) <= stream_labels):
            continue
        if not inner.plain or inner.func not in ("count_over_time", "rate"):
            continue
        sel = sel_of[id(inner.log)]
        covered = [r for r in rules if evaluate(sel, r).used and covers(sel, r)]
        per_second = range_seconds(inner.range_text) if inner.func == "rate" else 0.0
        if not covered or per_second is None:
            continue
        by = f" by ({', '.join(v.grouping.labels)})" if v.grouping is not None else ""
        window = f"[{inner.range_text}]" + (f" offset {inner.offset_text}" if inner.offset_text else "")
        selector = expr[slice(*inner.log.selector)]
        filters = "".join(" " + expr[a:b] for a, b in inner.log.filters)
        lines = quote(union_of([r.language for r in covered]))
        ids = [r.id for r in covered]
        marked = " or ".join(quote(marker(i)) for i in ids)
        named = f"{RULE_LABEL}={go_quote(ids[0])}" if len(ids) == 1 else f"{RULE_LABEL}=~{go_quote('|'.join(ids))}"
        x = f'sum{by}({inner.func}({selector}{filters} !~ {lines} | {RULE_LABEL}="" {window}))'
        y = f"sum{by}(sum_over_time({selector} |= {marked} | {named} | unwrap {COUNT_LABEL} {window}))" + (f" / {per_second:g}" if per_second else "")
        z = f"sum{by}({inner.func}({selector} |~ {lines} {window}))"
        edits.append((v.span[0], v.span[1], _outer_sum(_outer_sum(x, y), z)))
        done |= set(ids)
    for a, b, text in sorted(edits, reverse=True):
        expr = expr[:a] + text + expr[b:]
    return expr, [r.id for r in rules if r.id in done]


# --- Decision --------------------------------------------------------------------------------------------------------


def readers_of(c: Candidate, queries: Sequence[tuple[UsedQuery, ast.Query | str]], languages: dict[str, str], rollup: bool) -> list[Reader]:
    """The queries that read a candidate's lines. The first reading selection says whether lines are counted; an exact one is shown where there is any."""
    out = []
    rule = c.target()
    for used, q in queries:
        if isinstance(q, str):
            out.append(Reader(used.source, used.origin, used.expr, True, f"query does not parse ({q}); taken to read and count every line", None, (Note(UNREADABLE, "the query does not parse"),)))
            continue
        sels = readings(q)
        first = chosen = None
        part = False
        for sel in sels:
            if compensated(sels, sel, c.id, languages):
                part = True
                continue
            v = evaluate(sel, rule)
            if v.used and (chosen is None or chosen.widened and not v.widened):
                first, chosen = first or v, v
                if not v.widened:
                    break
        if chosen is not None:
            new = None
            if rollup and used.store:
                text, ids = rewrite_counts(used.expr, [rule], set(c.stream_labels))
                # A rewrite counts only if what is left of the query reads the lines no more.
                new = text if ids and not any(evaluate(s, rule).used and not compensated(readings(parse(text)), s, c.id, languages) for s in readings(parse(text))) else None
            out.append(Reader(used.source, used.origin, used.expr, first.counting, chosen.reason, chosen.witness, chosen.widened, new))
        elif part:
            out.append(Reader(used.source, used.origin, used.expr, True, "already rewritten for a rollup of these lines; any other removal changes its count", compensated=True))
    return out


def _parsed(queries: Sequence[UsedQuery]) -> list[tuple[UsedQuery, ast.Query | str]]:
    out: list[tuple[UsedQuery, ast.Query | str]] = []
    for u in queries:
        try:
            out.append((u, parse(u.expr)))
        except QueryFault as e:
            out.append((u, str(e)))
    return out


def decide(
    candidates: Sequence[Candidate], queries: Sequence[UsedQuery], gaps: Sequence[Gap] = (), policy: Policy = Policy(), by_service: Sequence[tuple[str, Reader]] = (), executed: Mapping[str, tuple[int, Reader]] | None = None
) -> list[Recommendation]:
    """One recommendation for each candidate, largest removal first.

    queries: those that are stored, or a few that ran. executed: candidate -> (how many more queries read it, one of them), as executed_readers finds them in a table
    of any size; nothing can be rewritten in them. by_service: readers that are known by service only, which no rollup can keep either.
    """
    executed = executed or {}
    if bad := set(policy.actions) - set(ACTIONS):
        raise ValueError(f"unknown actions {sorted(bad)}")
    errors = at.compile(policy.error_pattern)
    blocking = sorted(f"evidence gap {g.key!r} ({g.source} {g.origin}): {g.reason}" for g in gaps if g.key not in policy.acknowledged)
    exempt_ids = {e for e in policy.exempt if e.startswith("r-")}
    exempt = [at.compile(e) for e in policy.exempt if not e.startswith("r-")]
    parsed = _parsed(queries)
    languages = {c.id: c.language for c in candidates}
    severe = at.compile(SEVERE)
    out = []
    for c in candidates:
        rec = Recommendation(c)
        may_roll = "rollup" in policy.actions and not c.structured
        rec.readers = readers_of(c, parsed, languages, may_roll)
        rewritten = {canonical(r.expr): r.rewrite for r in rec.readers if r.rewrite}
        # An executed query that is a stored query in the same writing is replaced with it.
        rec.readers = [replace(r, rewrite=rewritten.get(canonical(r.expr))) if r.source == "querylog" and not r.rewrite else r for r in rec.readers]
        keeps = may_roll and bool(rec.readers) and all(r.rewrite or r.compensated for r in rec.readers)
        conflicts: list[str] = []
        if may_roll:
            replaced = {canonical(r.expr) for r in rec.readers if r.rewrite or r.compensated}
            conflicts = [
                f"{u.source} {u.origin} would also select this rule's rollup records: {u.expr}"
                for u, q in parsed
                if not isinstance(q, str) and canonical(u.expr) not in replaced and any(reads_rollups(s, c.id, c.scope) for s in readings(q))
            ]
        keeps = keeps and not conflicts
        more = [r for service, r in by_service if service == c.service]
        others, example = executed.get(c.id, (0, None))
        rec.readers += [*more, *([example] if example else [])]
        keeps = keeps and not more and not others
        total = len(rec.readers) + max(0, others - 1)
        per_day = c.bytes / c.window_hours * 24 if c.window_hours > 0 else 0.0
        rec.blockers = list(blocking)
        if rec.readers and not keeps:
            rec.blockers.append(f"{total} {'query reads' if total == 1 else 'queries read'} these lines")
        try:
            w = at.intersects(at.compile(c.language), errors)
            if w is not None:
                rec.blockers.append(f"lines can be error-like, such as {w!r}")
        except at.Undecided:
            rec.blockers.append("could not prove that the lines are not error-like")
        rec.blockers += [f"sampled lines carry severity {s}" for s in c.severities if at.matches(severe, s)]
        if c.id in exempt_ids:
            rec.blockers.append("exempt by policy")
        rec.blockers += [f"template exempt by policy ({e.text})" for e in exempt if at.matches(e, c.template)]
        if per_day < policy.min_daily_bytes:
            rec.blockers.append(f"only {per_day:.0f} bytes a day, under the policy's minimum")
        if not rec.blockers:
            _choose(rec, policy, per_day, conflicts)
        out.append(rec)
    _combine(out, languages)
    return sorted(out, key=lambda r: (-r.removed_per_day, r.candidate.id))


def _choose(rec: Recommendation, policy: Policy, per_day: float, conflicts: list[str]) -> None:
    c = rec.candidate
    for a in policy.actions:
        if a == "dedupe" and not c.constant or a == "rollup" and (c.structured or conflicts) or rec.readers and a != "rollup":
            continue
        rec.action = a
        break
    if rec.action == "none":
        rec.blockers += [*conflicts, "no allowed action applies"]
        return
    rec.removed_per_day = per_day * (100 - policy.sample_percent) / 100 if rec.action == "sample" else per_day
    rec.keep = policy.sample_percent if rec.action == "sample" else 0
    rec.upper_bound = rec.action == "dedupe"
    if rec.action == "rollup":
        rec.rewrites = sorted({(r.source, r.origin, r.rewrite) for r in rec.readers if r.rewrite})


def _holds(text: str, c: Candidate, languages: dict[str, str]) -> bool:
    """Whether a rewritten query counts a rolled-up rule's lines as before: what it still reads of them is compensated, and no other term meets their records."""
    sels = readings(parse(text))
    return not any(evaluate(s, c.target()).used and not compensated(sels, s, c.id, languages) or reads_rollups(s, c.id, c.scope) for s in sels)


def _combine(recs: Sequence[Recommendation], languages: dict[str, str]) -> None:
    """One rewrite of each stored query for all the rules that are rolled up, in place of one for each rule.

    A rule whose part of a common rewrite can't be proved is rolled up no more, which changes the others' rewrites: repeated until nothing changes.
    """
    while True:
        rolled = [r for r in recs if r.action == "rollup"]
        reading_of: dict[str, list[Recommendation]] = {}
        for r in rolled:
            for expr in dict.fromkeys(x.expr for x in r.readers if x.rewrite and x.source != "querylog"):
                reading_of.setdefault(expr, []).append(r)
        texts: dict[str, str] = {}
        unproved: list[Recommendation] = []
        for expr, together in reading_of.items():
            text, done = rewrite_counts(expr, [r.candidate.target() for r in together], shared_labels([r.candidate for r in together]))
            texts[canonical(expr)] = text
            unproved += [r for r in together if r.candidate.id not in done or not _holds(text, r.candidate, languages)]
        if not unproved:
            break
        for r in unproved:
            if r.action == "rollup":
                r.action, r.removed_per_day, r.rewrites = "none", 0.0, []
                r.blockers.append("its counts can't be kept together with those of other rules in one query")
    for r in rolled:
        r.readers = [replace(x, rewrite=texts.get(canonical(x.expr), x.rewrite)) if x.rewrite else x for x in r.readers]
        r.rewrites = sorted({(x.source, x.origin, x.rewrite) for x in r.readers if x.rewrite})


def shared_labels(candidates: Sequence[Candidate]) -> set[str]:
    """Labels that the streams of all candidates have."""
    sets = [set(c.stream_labels) for c in candidates]
    return set.intersection(*sets) if sets else set()


# --- Many rules and many queries -------------------------------------------------------------------------------------

def verdicts(rules: DataFrame, queries: DataFrame, scope_label: str = "service_name", block_rows: int = 1000) -> DataFrame:
    """rule, query_id, used, counting, exact, witness, reason, kinds (of what was assumed) of every query that isn't excluded by its selector, for each rule.

    rules: id, service, language, and structured where the language is that of a field. queries: query_id, query. A query whose selectors all name services, by equality or by an alternation of names, meets only the rules of those, by a join on the
    service and a part of its queries; the others meet every rule: each block of about block_rows of them is held against each rule's row. Null queries and rules without a language are left out; a rule without a service
    meets every query; a query that doesn't parse reads everything.
    """
    label = scope_label

    def services(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["query"]:
                try:
                    found = [next((v for m in q.matchers if m.label == label and (v := named_values(m)) is not None), None) for q, _ in parse(text).logs]
                    out.append(sorted({v for f in found for v in f}) if all(f is not None for f in found) else None)
                except QueryFault:
                    out.append(None)
            yield b.assign(services=out)

    # Parsing and judging cost by the row, not by the byte: rows are dealt to all pieces, and each text is parsed once for all three ways below.
    pieces = piece_count(queries)
    known = materialize(queries.where("query is not null").select("query_id", "query").repartition(pieces).mapInPandas(services, "query_id long, query string, services array<string>"))
    blocks = max(1, -(-known.count() // block_rows))
    parts = min(PARTS, blocks)
    held = rules.withColumn("structured", F.lit(False)) if "structured" not in rules.columns else rules
    held = held.where("id is not null and language is not null").select("id", "service", "language", F.coalesce("structured", F.lit(False)).alias("structured"))
    # Rules that remove the same lines are judged together.
    r = held.groupBy("service", "language", "structured").agg(F.collect_set("id").alias("ids"))
    columns = ["ids", "service", "language", "structured"]
    dealt = lambda n: F.pmod(F.xxhash64("query_id"), F.lit(n))
    asking = known.where("services is not null").select("query_id", "query", F.explode("services").alias("service"), dealt(parts).alias("part")).repartition(pieces, "service", "part")
    named = asking.join(r.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["service", "part"]).select(*columns, F.struct("query_id", "query").alias("q"))
    anywhere = known.where("services is not null").select("query_id", "query")
    wide = known.where("services is null").select("query_id", "query")

    def in_blocks(some_rules: DataFrame, some_queries: DataFrame) -> DataFrame:
        block = some_queries.withColumn("block", dealt(blocks)).repartition(pieces, "block").groupBy("block").agg(F.collect_list(F.struct("query_id", "query")).alias("qs"))
        return some_rules.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(block, "block").select(*columns, F.explode("qs").alias("q"))

    # A rule without a service has no label that a query could exclude.
    spread = in_blocks(r, wide).unionByName(in_blocks(r.where("service is null"), anywhere))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ids, service, language, structured, q in zip(b["ids"], b["service"], b["language"], b["structured"], b["q"], strict=True):
                target = Target("", ((label, service),) if service is not None else (), language, bool(structured))
                try:
                    found = [evaluate(s, target) for s in readings(parse(q["query"]))]
                    used = [v for v in found if v.used]
                    shown = next((v for v in used if not v.widened), used[0]) if used else found[0] if found else None
                    if shown is None:
                        continue
                    answer = (q["query_id"], bool(used), used[0].counting if used else shown.counting, not shown.widened, shown.witness, shown.reason, sorted({w.kind for w in shown.widened}))
                except QueryFault as e:
                    answer = (q["query_id"], True, True, False, None, f"query does not parse ({e})", [UNREADABLE])
                except (sx.SyntaxFault, at.Undecided) as e:
                    answer = (q["query_id"], True, True, False, None, f"language does not compile ({e})", [BROKEN])
                rows += [(i, *answer) for i in ids]
            yield pd.DataFrame(rows, columns=["rule", "query_id", "used", "counting", "exact", "witness", "reason", "kinds"])

    both = named.unionByName(spread)
    return both.mapInPandas(judge, "rule string, query_id long, used boolean, counting boolean, exact boolean, witness string, reason string, kinds array<string>")


def executed_readers(rules: DataFrame, executed: DataFrame, scope_label: str = "service_name") -> DataFrame:
    """rule, readers, kinds (map kind of assumption -> readers), and one of the readers (an exact one where there is any): query, component, counting, witness, reason.

    rules as for verdicts; executed: query_id (unique), query, component. One row for each rule that is read, however many queries read it.
    """
    used = verdicts(rules, executed.select("query_id", "query"), scope_label).where("used").join(executed.select("query_id", "query", "component"), "query_id")
    shown = F.min(F.struct(~F.col("exact"), "query", "component", "counting", "witness", "reason", "kinds")).alias("x")
    by_rule = used.groupBy("rule").agg(F.count(F.lit(1)).alias("readers"), shown)
    kinds = used.select("rule", F.explode("kinds").alias("kind")).groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("n"))
    # A dozen kinds for each rule.
    kinds = kinds.groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("by_kind"))
    return by_rule.join(kinds, "rule", "left").select("rule", "readers", "by_kind", *[F.col(f"x.{c}").alias(c) for c in ("query", "component", "counting", "witness", "reason", "kinds")])
