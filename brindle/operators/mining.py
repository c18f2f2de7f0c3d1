"""From log lines to rules: a stratified sample, line templates, an exact language for each, and its exact volume."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.relang import automaton
from brindle.relang import syntax as sx
from brindle.relang.syntax import java, quote
from brindle.session import materialize

# --- Sample ----------------------------------------------------------------------------------------------------------

#: Pieces of a slice from which its share is read.
PARTS = 20


def slice_number(ts: Column, start: int, end: int, n: int) -> Column:
    """Which of n equal slices of [start, end) a time lies in; the last ends exactly at end."""
    return F.least(F.floor((ts - start) / F.lit((end - start) // n).cast("decimal(20,0)")), F.lit(n - 1)).cast("int")


def stratified_sample(df: DataFrame, key: str, ts: str, line: str, start: int, end: int, slices: int, budget: int) -> DataFrame:
    """About `budget` rows of each key in [start, end), spread over the window; df's columns unchanged.

    Each slice has a share of the budget by its rows, rounded down, one at least. A slice with no more rows than its share is taken whole; another is cut
    into min(20, share) pieces, and the oldest ceil(share / pieces) rows of each are taken, ties by line. Rows with a null key or time are in no sample.
    """
    t = F.col(ts)
    inside = df.where((t >= start) & (t < end) & F.col(key).isNotNull()).withColumn("__slice", slice_number(t, start, end, slices))
    counts = inside.groupBy(F.col(key).alias("__key"), "__slice").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy("__key"))
    share = F.greatest(F.lit(1), F.floor(F.lit(float(budget)) * F.col("__n") / total)).cast("long")
    plan = counts.withColumn("__share", share).withColumn("__parts", F.least(F.lit(PARTS), "__share"))
    step = (end - start) // slices
    # A row for each key and slice; broadcast where they are few.
    plan = materialize(plan.withColumnRenamed("__slice", "__s"))
    plan = F.broadcast(plan) if plan.count() <= 100_000 else plan
    joined = inside.join(plan, (F.col(key) == F.col("__key")) & (F.col("__slice") == F.col("__s")))
    begin = F.lit(start) + F.col("__slice") * F.lit(step).cast("long")
    finish = F.when(F.col("__slice") == slices - 1, F.lit(end)).otherwise(begin + step)
    width = F.floor((finish - begin) / F.col("__parts").cast("decimal(20,0)"))
    part = F.least(F.floor((t - begin) / F.greatest(width, F.lit(1)).cast("decimal(20,0)")), F.col("__parts") - 1)
    whole = F.col("__share") >= F.col("__n")
    # A slice that is taken whole is one piece with a quota of all its rows, which are no more than the budget.
    pieces = joined.withColumn("__part", F.when(whole, F.lit(0)).otherwise(part)).withColumn("__quota", F.when(whole, F.col("__n")).otherwise(F.ceil(F.col("__share") / F.col("__parts"))))
    rank = F.row_number().over(Window.partitionBy("__key", "__slice", "__part").orderBy(ts, line))
    # No piece gives more rows than the budget: each partition is cut to them before the shuffle.
    return pieces.withColumn("__rank", rank).where(F.col("__rank") <= max(budget, 1)).where(F.col("__rank") <= F.col("__quota")).select(*df.columns)


# --- Templates -------------------------------------------------------------------------------------------------------

#: Version of the templating; rules are kept with it, as another one may group lines otherwise.
DRAIN_VERSION = "1"


@dataclass
class DrainConfig:
    depth: int = 4
    similarity: float = 0.4
    max_children: int = 100
    max_clusters: int = 10_000
    masks: list[tuple[str, str]] = field(default_factory=list)
    seeds: list[str] = field(default_factory=list)

    def digest(self) -> str:
        """Hash of everything that templates depend on."""
        state = {"version": DRAIN_VERSION, "depth": self.depth, "similarity": self.similarity, "children": self.max_children, "clusters": self.max_clusters, "masks": self.masks, "seeds": self.seeds}
        return hashlib.sha256(json.dumps(state, sort_keys=True).encode()).hexdigest()


WILDCARD = "<*>"


class Drain:
    """Fixed-depth tree of templates (He et al., ICWS 2017): by number of tokens, then by leading tokens; the most similar template of a leaf takes the line.

    Positions at which lines of one template differ become <*>. Masks are applied before a line is cut at spaces. A line that fits no template starts one.
    """

    def __init__(self, config: DrainConfig):
        self.config = config
        self.masks = [(re.compile(p), f"<{name}>") for name, p in config.masks]
        self.leaves: dict[tuple, list[list[str]]] = {}
        self.branches: dict[tuple, set[str]] = {}
        self.count = 0
        for s in config.seeds:
            self.add(s)

    def mask(self, text: str) -> str:
        for p, name in self.masks:
            text = p.sub(name, text)
        return text

    def _leaf(self, tokens: list[str]) -> tuple:
        path: tuple = (len(tokens),)
        for token in tokens[: self.config.depth - 2]:
            if any(c.isdigit() for c in token) or token == WILDCARD:
                token = WILDCARD
            known = self.branches.setdefault(path, set())
            if token not in known:
                if len(known) >= self.config.max_children:
                    token = WILDCARD
                known.add(token)
            path = (*path, token)
        return path

    def add(self, text: str) -> list[str]:
        """The template that the line joins or starts, a list of tokens that later lines may widen."""
        tokens = self.mask(text).split(" ")
        leaf = self.leaves.setdefault(self._leaf(tokens), [])
        best, score = None, (-1.0, -1)
        for t in leaf:
            same = sum(a == b for a, b in zip(t, tokens, strict=True))
            free = t.count(WILDCARD)
            s = (same / len(tokens), free)
            if s > score:
                best, score = t, s
        if best is not None and score[0] >= self.config.similarity:
            for i, (a, b) in enumerate(zip(best, tokens, strict=True)):
                if a != b:
                    best[i] = WILDCARD
            return best
        if self.count >= self.config.max_clusters:
            raise OverflowError(f"more than {self.config.max_clusters} templates")
        leaf.append(tokens)
        self.count += 1
        return tokens


def templates_of(texts: Sequence[str], config: DrainConfig) -> list[str]:
    """Template of each text. The texts pass twice: the first pass settles the tree, the second assigns."""
    d = Drain(config)
    for t in texts:
        d.add(t)
    return [" ".join(x) for x in [d.add(t) for t in texts]]


def template_lines(sample: DataFrame, key: str, ts: str, text: str, config: DrainConfig) -> DataFrame:
    """sample (bounded by its budget for each key) with the template of each row's text; a null text has none."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in sample.schema.fields)}, template string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, text], kind="stable")
        given = pdf[text].notna()
        pdf["template"] = None
        pdf.loc[given, "template"] = templates_of(pdf.loc[given, text].tolist(), config)
        return pdf

    return sample.groupBy(key).applyInPandas(run, schema)


def strict_field(line: Column, name: str) -> Column:
    """A string field of a line that is strictly one JSON object; null for any other line, and for a field that is no string."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            try:
                r = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))) if text else None
            except (ValueError, RecursionError):
                return None
            v = r.get(name) if isinstance(r, dict) else None
            return v if isinstance(v, str) else None

        return s.map(one)

    return run(line)


def level_of(labels: Column, record: Column | None, keys: Sequence[str]) -> Column:
    """The first of the level keys that a label, the label with dots as underscores, or the record's string holds; empty where none does."""
    found: list[Column] = []
    for k in keys:
        found += [F.nullif(labels[k], F.lit("")), F.nullif(labels[k.replace(".", "_")], F.lit(""))]
        if record is not None:
            found.append(F.nullif(record[k], F.lit("")))
    return F.coalesce(*found, F.lit(""))


# --- Languages -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class InferOptions:
    min_samples: int = 20
    max_enum: int = 16
    enum_support: int = 4


class TooFewSamples(ValueError):
    """A template has too little evidence for a rule."""


#: Classes of characters, narrowest first.
LADDER = ("[0-9]", "[0-9a-f]", "[0-9A-F]", "[a-z]", "[A-Z]", "[A-Za-z]", "[0-9A-Za-z]", r"[0-9A-Za-z_.\-]", "[^ ]")
_LADDER = [re.compile(rf"(?:{c})*\Z") for c in LADDER]
_PIECE = re.compile(r"[0-9]+|[A-Za-z]+|.", re.DOTALL)


def _bounded(values: Sequence[str]) -> str:
    """The narrowest class that holds all values, with the bounds of their lengths."""
    cls = next(c for c, p in zip(LADDER, _LADDER, strict=True) if all(p.match(v) for v in values))
    lo, hi = min(map(len, values)), max(map(len, values))
    if hi > 1000:
        return cls + ("*" if lo == 0 else "+")
    return cls + (f"{{{lo}}}" if lo == hi else f"{{{lo},{hi}}}")


def _shape(values: Sequence[str]) -> str | None:
    """Pieces of digits, letters and single others that all values have in the same order; null where they don't."""
    cut = [_PIECE.findall(v) for v in values]
    if len({len(c) for c in cut}) > 1:
        return None
    out = []
    for column in zip(*cut, strict=True):
        kinds = {"d" if x[0].isascii() and x[0].isdigit() else "a" if x[0].isascii() and x[0].isalpha() else x for x in column}
        if len(kinds) > 1:
            return None
        out.append(quote(column[0]) if len(set(column)) == 1 else _bounded(column))
    return "".join(out)


def _masked(token: str, masks: Sequence[tuple[str, str]]) -> str | None:
    """Expression of a template's token with masks in it, None where it has none."""
    if not masks:
        return None
    parts = re.split("(" + "|".join(re.escape(f"<{n}>") for n, _ in masks) + ")", token)
    if len(parts) == 1:
        return None
    pattern = {f"<{n}>": p for n, p in masks}
    return "".join(f"(?:{pattern[x]})" if i % 2 else quote(x) for i, x in enumerate(parts))


@dataclass(frozen=True)
class Slot:
    """A position of a template and what stood there: its token, and how often each value did."""

    token: str
    counts: dict[str, int]
    masks: tuple[tuple[str, str], ...]
    options: InferOptions

    @cached_property
    def values(self) -> list[str]:
        return sorted(self.counts, key=lambda v: v.encode())

    def constant(self) -> str | None:
        return quote(self.values[0]) if len(self.counts) == 1 else None

    def mask(self) -> str | None:
        expression = _masked(self.token, self.masks)
        if expression is None:
            return None
        whole = automaton.compile(rf"\A(?:{expression})\z")
        return expression if all(automaton.matches(whole, v) for v in self.values) else None

    def listing(self) -> str | None:
        seen = sum(self.counts.values())
        few = len(self.counts) <= min(self.options.max_enum, seen // self.options.enum_support)
        return f"(?:{'|'.join(map(quote, self.values))})" if few else None

    def outline(self) -> str:
        return _shape(self.values) or _bounded(self.values)


#: Descriptions of a slot, the most telling first; the first that holds is taken.
DESCRIPTIONS: tuple[tuple[str, Callable[[Slot], str | None]], ...] = (("literal", Slot.constant), ("mask", Slot.mask), ("enum", Slot.listing), ("shape", Slot.outline))


def infer_language(template: str, samples: Sequence[str], masks: Sequence[tuple[str, str]] = (), options: InferOptions = InferOptions()) -> dict:
    """The language of a template's lines: template, regex (anchored), samples, skipped, positions (token, kind, regex).

    Lines are cut at single spaces; those with another number of tokens are skipped and not covered. A position is one text each time; or its mask, where all values fit
    it; or a small set of values seen often enough; or a shape. The language accepts every aligned sample.
    """
    width = template.count(" ") + 1
    lines = Counter(s for s in samples if s.count(" ") + 1 == width)
    if lines.total() < options.min_samples:
        raise TooFewSamples(f"{lines.total()} of {len(samples)} lines have the template's tokens, {options.min_samples} are needed")
    columns: list[Counter[str]] = [Counter() for _ in range(width)]
    for line, n in lines.items():
        for column, value in zip(columns, line.split(" "), strict=True):
            column[value] += n
    slots = [Slot(token, dict(column), tuple(masks), options) for token, column in zip(template.split(" "), columns, strict=True)]
    positions = [{"token": s.token} | next({"kind": kind, "regex": text} for kind, say in DESCRIPTIONS if (text := say(s)) is not None) for s in slots]
    whole = r"\A" + " ".join(p["regex"] for p in positions) + r"\z"
    accepts = automaton.compile(whole)
    if (left := next((x for x in lines if not automaton.matches(accepts, x)), None)) is not None:
        raise AssertionError(f"{whole} leaves out {left!r}")
    return {"template": template, "regex": whole, "samples": lines.total(), "skipped": len(samples) - lines.total(), "positions": positions}


LANGUAGE = "template string, regex string, samples int, skipped int, positions array<struct<token:string,kind:string,regex:string>>, constant boolean, levels array<string>, reason string"


def infer_languages(templated: DataFrame, key: str, text: str, level: str | None = None, masks: Sequence[tuple[str, str]] = (), options: InferOptions = InferOptions()) -> DataFrame:
    """A row for each key and template: its language, or the reason why there is none. templated: a bounded sample with templates."""
    masks = list(masks)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        template = pdf["template"].iloc[0]
        row = {"key": pdf[key].iloc[0], "template": template, "regex": None, "samples": len(pdf), "skipped": 0, "positions": [], "constant": False, "levels": sorted(set(pdf[level].dropna()) - {""}) if level else [], "reason": None}
        try:
            found = infer_language(template, pdf[text].tolist(), masks, options)
            row |= found | {"constant": all(p["kind"] == "literal" for p in found["positions"])}
        except TooFewSamples as e:
            row["reason"] = str(e)
        return pd.DataFrame([row])

    kind = templated.schema[key].dataType.simpleString()
    return templated.where(F.col("template").isNotNull() & F.col(key).isNotNull()).groupBy(key, "template").applyInPandas(run, f"key {kind}, {LANGUAGE}")


def rule_id(service: Column, field_name: Column, language: Column) -> Column:
    """r- and the first six bytes of the SHA-256 of service, field and language, in hexadecimal."""
    return F.concat(F.lit("r-"), F.substring(F.sha2(F.concat_ws("\0", service, field_name, language), 256), 1, 12))


# --- Rules over lines ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineRule:
    id: str
    service: str
    language: str
    action: str = "drop"
    keep: int = 0
    template: str = ""


def rule_of(service: Column, text: Column, rules: Sequence[LineRule]) -> Column:
    """Id of the rule whose language the text is in, null where there is none. Rules of one service are disjoint, so that at most one holds."""
    by_service: dict[str, Column] = {}
    for r in rules:
        hit = text.rlike(java(r.language))
        so_far = by_service.get(r.service)
        by_service[r.service] = F.when(hit, r.id) if so_far is None else so_far.when(hit, r.id)
    out = F.lit(None).cast("string")
    for s, c in by_service.items():
        out = F.when(service == s, c).otherwise(out)
    return out


#: Rules that are tried one after another in one expression; more are looked up by the words that their lines begin with.
CASE_RULES = 50
#: Words of a rule's beginning that are looked up at most.
_LEADING = 3


def leading_words(language: str) -> str:
    """The whole words, at most _LEADING, that every text of an anchored language begins with."""
    tree = sx.parse(language)
    parts = tree.parts if isinstance(tree, sx.Concat) else (tree,)
    if not parts or not isinstance(parts[0], sx.Assert) or parts[0].kind != "text_begin":
        return ""
    known = "".join(chr(p.literal) for p in takewhile(lambda p: isinstance(p, sx.Chars) and p.literal is not None, parts[1:]))
    return " ".join(known.split(" ")[:-1][:_LEADING])


def with_rule(df: DataFrame, service: Column, text: Column, rules: Sequence[LineRule], name: str = "rule") -> DataFrame:
    """df with the id of the rule whose language each text is in, null where there is none.

    A few rules are one expression. Many are tables by the number of words that their lines are known to begin with: a text meets only the rules of its service that
    begin as it does. The tables have a row for each rule and are broadcast.
    """
    if len(rules) <= CASE_RULES:
        return df.withColumn(name, rule_of(service, text, rules))
    by_words: dict[int, list[tuple[str, str, str, str]]] = {}
    for r in rules:
        words = leading_words(r.language)
        by_words.setdefault(len(words.split(" ")) if words else 0, []).append((r.service, words, java(r.language), r.id))
    out, hits = df.withColumn("__service", service).withColumn("__text", text), []
    for n, rows in sorted(by_words.items(), reverse=True):
        table = df.sparkSession.createDataFrame(rows, f"__s{n} string, __w{n} string, __p{n} string, __r{n} string")
        begins = F.substring_index("__text", " ", n) if n else F.lit("")
        same = (F.col("__service") == F.col(f"__s{n}")) & (begins == F.col(f"__w{n}")) & F.expr(f"__text rlike __p{n}")
        out, hits = out.join(F.broadcast(table), same, "left"), [*hits, F.col(f"__r{n}")]
    return out.withColumn(name, F.coalesce(*hits)).select(*[c for c in df.columns if c != name], name)


def overlapping(rules: Sequence[LineRule]) -> list[tuple[str, str]]:
    """Pairs of rules of one service that some line may be in both of; an undecided question counts as such.

    Rules whose beginnings differ have no line in common, so that only those that may begin alike are held against each other.
    """
    begins = [tuple(leading_words(r.language).split()) for r in rules]
    bucket: dict[tuple[str, tuple[str, ...]], list[int]] = {}
    for i, r in enumerate(rules):
        bucket.setdefault((r.service, begins[i]), []).append(i)
    pairs = set()
    for i, r in enumerate(rules):
        for n in range(len(begins[i]) + 1):
            for j in bucket.get((r.service, begins[i][:n]), ()):
                if j < i or n < len(begins[i]):
                    pairs.add((min(i, j), max(i, j)))
    return [(rules[i].id, rules[j].id) for i, j in sorted(pairs) if automaton.overlap(automaton.compile(rules[i].language), automaton.compile(rules[j].language))]


def measure(df: DataFrame, service: Column, text: Column, rules: Sequence[LineRule]) -> DataFrame:
    """rule, lines, bytes: exact volume of every rule in one pass over the lines."""
    tagged = with_rule(df.select(service.alias("s"), text.alias("t"), F.octet_length(text).cast("long").alias("b")), F.col("s"), F.col("t"), rules).where("rule is not null")
    return tagged.groupBy("rule").agg(F.count(F.lit(1)).alias("lines"), F.sum("b").alias("bytes"))


def stream_preservation(df: DataFrame, service: Column, stream: Column, text: Column, rules: Sequence[LineRule]) -> DataFrame:
    """service, rule, streams, emptied: how many streams of the rule's service hold only the rule's lines; rule '*' is all rules of the service together.

    One aggregation answers every rule: a stream is emptied by one rule just if all its lines have that rule.
    """
    here = df.select(service.alias("service"), stream.alias("stream"), text.alias("t")).where(F.col("service").isin(*sorted({r.service for r in rules})))
    tagged = with_rule(here, F.col("service"), F.col("t"), rules).select("service", "stream", F.coalesce("rule", F.lit("")).alias("rule"))
    streams = tagged.groupBy("service", "stream").agg(F.min("rule").alias("low"), F.max("rule").alias("high"))
    only = F.when(F.col("low") == F.col("high"), F.nullif("low", F.lit("")))
    per = streams.groupBy("service").agg(F.count(F.lit(1)).alias("streams"), F.count(F.when(F.col("low") != "", 1)).alias("all_emptied"))
    one = streams.where(only.isNotNull()).groupBy("service", only.alias("rule")).agg(F.count(F.lit(1)).alias("emptied"))
    known = df.sparkSession.createDataFrame([(r.service, r.id) for r in rules] + [(s, "*") for s in sorted({r.service for r in rules})], "service string, rule string")
    out = known.join(per, "service").join(one, ["service", "rule"], "left")
    return out.select("service", "rule", "streams", F.when(F.col("rule") == "*", F.col("all_emptied")).otherwise(F.coalesce("emptied", F.lit(0))).alias("emptied"))


def template_language(template: str, masks: Sequence[str] = ()) -> str:
    """The wide language of a template: <*> is any token, a mask any text, anything else itself."""
    parts = []
    for token in template.split(" "):
        cut = re.split("(" + "|".join(map(re.escape, ["<*>", *(f"<{m}>" for m in masks)])) + ")", token)
        parts.append("".join((r"\S+" if x == WILDCARD else ".+") if i % 2 else quote(x) for i, x in enumerate(cut)))
    return r"\A" + " ".join(parts) + r"\z"


def drift(df: DataFrame, service: Column, text: Column, rules: Sequence[LineRule], masks: Sequence[str] = (), ts: Column | None = None, examples: int = 3) -> DataFrame:
    """rule, template_lines, out_of_rule, examples (the oldest three by ts, ties and rows without ts by text), status: lines of a rule's template that its language doesn't cover.

    status: drifting where there are any, no-traffic where the template has no lines, else stable. One pass counts; one more reads the lines that are out.
    """
    inside = [(service == r.service) & text.rlike(java(template_language(r.template, masks))) for r in rules]
    out = [here & ~text.rlike(java(r.language)) for here, r in zip(inside, rules, strict=True)]
    counts = df.agg(*[F.count(F.when(c, 1)).alias(f"{k}{i}") for k, cs in (("t", inside), ("o", out)) for i, c in enumerate(cs)])
    status = lambda i: F.when(F.col(f"o{i}") > 0, "drifting").when(F.col(f"t{i}") == 0, "no-traffic").otherwise("stable")
    rows = [F.struct(F.lit(r.id).alias("rule"), F.col(f"t{i}").alias("template_lines"), F.col(f"o{i}").alias("out_of_rule"), status(i).alias("status")) for i, r in enumerate(rules)]
    left = df.select(F.array_compact(F.array(*[F.when(c, F.lit(r.id)) for c, r in zip(out, rules, strict=True)])).alias("rules"), text.alias("text"), (ts if ts is not None else F.lit(None).cast("long")).alias("ts"))
    oldest = F.row_number().over(Window.partitionBy("rule").orderBy(F.col("ts").asc_nulls_last(), "text"))
    ranked = left.select(F.explode("rules").alias("rule"), "text", "ts").distinct().withColumn("rank", oldest).where(F.col("rank") <= examples)
    shown = ranked.groupBy("rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("examples"))
    found = counts.select(F.inline(F.array(*rows))).join(F.broadcast(shown), "rule", "left")
    return found.select("rule", "template_lines", "out_of_rule", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"), "status")


def reconcile(df: DataFrame, service: Column, text: Column, ts: Column, rules: Sequence[LineRule], before: tuple[int, int], after: tuple[int, int], rolled: Column | None = None, tolerance: float = 0.05) -> DataFrame:
    """rule, action, before_lines, after_lines, before_bytes, after_bytes, rolled, kept, status: what a rule stored in two windows (start, end] against what its action promises.

    rolled: a map column literal rule -> lines counted by its rollup records, or null. One pass over the lines.
    """
    lines = df.select(service.alias("service"), text.alias("text"), ts.alias("t"), F.octet_length(text).cast("long").alias("b"))
    t = with_rule(lines, F.col("service"), F.col("text"), rules).where("rule is not null")
    inside = lambda w: (F.col("t") > w[0]) & (F.col("t") <= w[1])
    found = t.groupBy("rule").agg(
        F.count(F.when(inside(before), 1)).alias("before_lines"), F.count(F.when(inside(after), 1)).alias("after_lines"),
        F.coalesce(F.sum(F.when(inside(before), F.col("b"))), F.lit(0)).alias("before_bytes"), F.coalesce(F.sum(F.when(inside(after), F.col("b"))), F.lit(0)).alias("after_bytes"),
    )
    known = df.sparkSession.createDataFrame([(r.id, r.action, r.keep) for r in rules], "rule string, action string, keep int")
    j = known.join(found, "rule", "left").na.fill(0)
    seconds = [math.floor((w[1] - w[0]) / 1e9) for w in (before, after)]
    j = j.withColumn("rolled", F.coalesce(rolled[F.col("rule")], F.lit(0)) if rolled is not None else F.lit(0)).withColumn("kept", F.when(F.col("before_lines") > 0, F.col("after_lines") / seconds[1] / (F.col("before_lines") / seconds[0])).otherwise(0.0))
    return j.withColumn("status", reconcile_status(F.col("action"), F.col("keep"), F.col("before_lines"), F.col("after_lines"), F.col("rolled"), F.col("kept"), tolerance)).drop("keep")


def reconcile_status(action: Column, keep: Column, before: Column, after: Column, rolled: Column, kept: Column, tolerance: float) -> Column:
    """ok, mismatch or no-traffic."""
    ok = lambda c: F.when(c, "ok").otherwise("mismatch")
    return (
        F.when(~action.isin("drop", "aggregate", "archive", "rollup", "sample", "dedupe"), "mismatch")
        .when(action.isin("drop", "aggregate", "archive"), ok(after == 0))
        .when(action == "rollup", ok((after == 0) & ((rolled > 0) | (before == 0))))
        .when(before == 0, "no-traffic")
        .when(action == "sample", ok(F.abs(kept - keep / 100.0) <= tolerance))
        .otherwise(ok(kept < 1))
    )


def monthly_cost(bytes_per_day: Column, lines_per_day: Column, per_gb: float, per_million: float) -> Column:
    """Cost of thirty days: a price for each 10^9 bytes and each 10^6 lines."""
    return 30 * (bytes_per_day / 1e9 * per_gb + lines_per_day / 1e6 * per_million)


def assumption_histogram(readers: DataFrame, widened: str) -> DataFrame:
    """kind, readers: how many readers have an assumption of each kind, a kind counted once for each reader; most frequent first."""
    return readers.select(F.explode(F.array_distinct(widened)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("readers")).orderBy(F.desc("readers"), "kind")
