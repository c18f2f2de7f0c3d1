"""What rules do to a stream of lines: tag, guard, measure, drop, aggregate, sample, dedupe, roll up, archive. The same in batch and on streams.

Every operator is a transformation of a DataFrame with the columns named in Layout. Counts conserve: kept lines, and the counts of the records that stand for
others, sum to the lines that came in, whatever the action.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.mining import LineRule, overlapping, with_rule
from brindle.relang import automaton
from brindle.relang.syntax import SyntaxFault, java

#: Where a level may stand, and what a level of warning or above begins with.
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel", "log.level")
SEVERE = r"(?i)\A\s*(?:warn|err|fatal|crit|alert|emerg|panic|severe)"
WARN_NUMBER = 13
ACTIONS = ("drop", "aggregate", "sample", "dedupe", "rollup", "archive")


@dataclass(frozen=True)
class Layout:
    """Names of the columns of a record; attributes is a map of strings. observed_ns, severity_number and severity_text may be missing in a table."""

    service: str = "service"
    text: str = "text"
    ts_ns: str = "ts_ns"
    observed_ns: str = "observed_ns"
    attributes: str = "attributes"
    severity_number: str = "severity_number"
    severity_text: str = "severity_text"

    def get(self, df: DataFrame, name: str) -> Column | None:
        column = getattr(self, name)
        return F.col(column) if column in df.columns else None


def check_rules(rules: Sequence[LineRule]) -> None:
    """Refuse rules that can't be enforced: bad ids, actions or shares, languages that don't compile, rules of a service that overlap."""
    seen = set()
    for r in rules:
        if not re.fullmatch(r"r-[0-9a-z][0-9a-z-]*", r.id) or r.id in seen:
            raise ValueError(f"bad or repeated rule id {r.id!r}")
        seen.add(r.id)
        if r.action not in ACTIONS:
            raise ValueError(f"{r.id}: unknown action {r.action!r}")
        if r.action == "sample" and not 1 <= r.keep <= 99:
            raise ValueError(f"{r.id}: a sample keeps 1 to 99 percent")
        if not r.service:
            raise ValueError(f"{r.id}: no service")
        try:
            automaton.compile(r.language)
        except SyntaxFault as e:
            raise ValueError(f"{r.id}: {e}") from e
    if clash := overlapping(rules):
        raise ValueError(f"rules overlap: {clash}")


def severe(df: DataFrame, layout: Layout, level_keys: Sequence[str] = ()) -> Column:
    """Whether a record is at warning or above by its severity number, its severity text or one of its level fields. Given keys add to the defaults."""
    out = F.lit(False)
    number, text, attributes = (layout.get(df, n) for n in ("severity_number", "severity_text", "attributes"))
    if number is not None:
        out = out | (F.coalesce(number, F.lit(0)) >= WARN_NUMBER)
    pattern = java(SEVERE)
    if text is not None:
        out = out | F.coalesce(text, F.lit("")).rlike(pattern)
    if attributes is not None:
        for k in dict.fromkeys([*LEVEL_KEYS, *level_keys]):
            out = out | F.coalesce(attributes[k], F.lit("")).rlike(pattern)
    return out


def tag(df: DataFrame, rules: Sequence[LineRule], layout: Layout = Layout(), level_keys: Sequence[str] = ()) -> DataFrame:
    """df with `rule`: the id of the rule that the record falls under, null for records of none and for all records at warning or above."""
    hit = with_rule(df, F.col(layout.service), F.col(layout.text), rules, "__hit")
    return hit.withColumn("rule", F.when(~severe(df, layout, level_keys), F.col("__hit"))).drop("__hit")


def measured(tagged: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """rule, lines, bytes of the tagged records: a delta, to be added up over batches."""
    b = F.octet_length(F.col(layout.text)).cast("long")
    return tagged.where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(b), F.lit(0)).alias("bytes"))


# --- Sampling --------------------------------------------------------------------------------------------------------


def sample_threshold(keep: int, digits: int = 64) -> str:
    """Hex digits below which a digest is kept: keep percent of all."""
    return f"{(1 << 4 * digits) * keep // 100:0{digits}x}"


def sample_key(df: DataFrame, layout: Layout) -> Column:
    """Text and time of a record, so that identical lines are drawn independently; a record without a time has the one it was observed at."""
    t = F.coalesce(F.col(layout.ts_ns), F.lit(0))
    observed = layout.get(df, "observed_ns")
    if observed is not None:
        t = F.when(t != 0, t).otherwise(F.coalesce(observed, F.lit(0)))
    return F.concat_ws("|", F.coalesce(F.col(layout.text), F.lit("")), t.cast("string"))


def sample_keeps(df: DataFrame, keep: int, layout: Layout = Layout(), digits: int = 64) -> Column:
    """Whether a record is in a sample of keep percent: the first hex digits (64, or 15 or 13 where a runtime has fewer) of the SHA-256 of its key stand below the threshold."""
    return F.substring(F.sha2(sample_key(df, layout), 256), 1, digits) < sample_threshold(keep, digits)


# --- Actions ---------------------------------------------------------------------------------------------------------


def _with_action(rules: Sequence[LineRule], *actions: str) -> list[str]:
    return [r.id for r in rules if r.action in actions]


def _in(ids: list[str]) -> Column:
    return F.coalesce(F.col("rule").isin(*ids), F.lit(False)) if ids else F.lit(False)


def kept_lines(tagged: DataFrame, rules: Sequence[LineRule], layout: Layout = Layout()) -> DataFrame:
    """The records that pass as they are: all but those dropped, aggregated, archived, sampled out, deduped or rolled up."""
    out = tagged.where(~_in(_with_action(rules, "drop", "aggregate", "archive", "dedupe", "rollup")))
    for r in rules:
        if r.action == "sample":
            out = out.where(~_in([r.id]) | sample_keeps(tagged, r.keep, layout))
    return out


def deduped(tagged: DataFrame, rules: Sequence[LineRule], layout: Layout = Layout(), interval_ns: int | None = None) -> DataFrame:
    """Identical records of dedupe rules folded into one with `dedup_count`: the first by time stands for them.

    Works on the rows at hand: a batch, or each interval of interval_ns of their times (records without a time are one interval).
    """
    rows = tagged.where(_in(_with_action(rules, "dedupe")))
    times = [c for c in (layout.ts_ns, layout.observed_ns) if c in rows.columns]
    keys = [c for c in rows.columns if c not in times]
    if interval_ns is not None:
        keys.append(F.expr(f"`{layout.ts_ns}` div {interval_ns}").alias("__interval"))
    return rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in times], F.count(F.lit(1)).alias("dedup_count")).select(*rows.columns, "dedup_count")


def rollup_marker(rule: Column) -> Column:
    return F.concat(F.lit("brindle rollup "), rule)


def rolled_up(tagged: DataFrame, rules: Sequence[LineRule], stream_cols: Sequence[str], layout: Layout = Layout()) -> DataFrame:
    """A marker record for each stream and rollup rule, with the number of lines that it stands for; their attributes are gone."""
    rows = tagged.where(_in(_with_action(rules, "rollup")))
    out = rows.groupBy(*stream_cols, "rule").agg(F.min(layout.ts_ns).alias(layout.ts_ns), F.count(F.lit(1)).alias("dedup_count"))
    return out.withColumn(layout.text, rollup_marker(F.col("rule")))


def archived(tagged: DataFrame, rules: Sequence[LineRule]) -> DataFrame:
    """Records of archive rules, marked with the rule in `archive`; they leave the main stream."""
    return tagged.where(_in(_with_action(rules, "archive"))).withColumn("archive", F.col("rule"))


@dataclass(frozen=True)
class Enforced:
    kept: DataFrame
    records: DataFrame
    archive: DataFrame
    volume: DataFrame


def enforce(df: DataFrame, rules: Sequence[LineRule], stream_cols: Sequence[str] = ("service",), layout: Layout = Layout(), level_keys: Sequence[str] = (), shadow: bool = False, dedupe_ns: int | None = None) -> Enforced:
    """Apply rules. kept: records that pass unchanged (df's columns). records: those that stand for several, with dedup_count. archive: moved away. volume: what each rule saw.

    shadow: measure only; every record is kept. dedupe_ns: the interval within which identical records are folded, by default the whole of df. Null texts and services fall under no rule. An empty table gives empty results.
    """
    check_rules(rules)
    tagged = tag(df, rules, layout, level_keys)
    volume = measured(tagged, layout)
    if shadow:
        none = tagged.where(F.lit(False)).withColumn("dedup_count", F.lit(0).cast("long"))
        return Enforced(df, none, tagged.where(F.lit(False)).withColumn("archive", F.col("rule")), volume)
    columns = list(dict.fromkeys([*stream_cols, "rule", layout.ts_ns, layout.text, "dedup_count"]))
    records = deduped(tagged, rules, layout, dedupe_ns).select(*columns).unionByName(rolled_up(tagged, rules, stream_cols, layout).select(*columns))
    return Enforced(kept_lines(tagged, rules, layout).select(*df.columns), records, archived(tagged, rules), volume)


Sink = Callable[[DataFrame, int], None]
