"""LogQL executed on DataFrames: a query becomes a plan of filters, projections, aggregations and joins that Catalyst optimizes.

Log queries work on columns ts_ns, labels (map), line, err. Metric queries give rows of `at` (nanoseconds), k (label pairs as a sorted array, which can be
grouped and joined) and value. A row of a range aggregation is counted in each step whose range holds it: rows with the same first and last step are folded
together before they are spread over the steps, so a long range with short steps costs no copies of rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.logql import ast
from brindle.logql.syntax import QueryFault, _UNITS, duration_ns, parse
from brindle.operators.unparsed import logfmt_cells
from brindle.relang import automaton, syntax as sx

_STRINGS = "map<string,string>"
_PAIRS = "array<struct<key:string,value:string>>"
ERROR = "__error__"


def java(text: str, anchored: bool = False) -> str:
    try:
        return sx.java(text, anchored)
    except sx.SyntaxFault as e:
        raise QueryFault(f"bad expression {text!r}: {e}") from e


def matches_expression(c: Column, text: str, anchored: bool = False) -> Column:
    """c holds a match of an RE2 expression (or is one as a whole). Loops that would overflow the JVM's stack run on our automaton."""
    source = rf"\A(?s:{text})\z" if anchored else text
    printed = java(text, anchored)
    if not sx.backtracks_deeply(sx.parse(source)):
        return c.rlike(printed)

    @F.pandas_udf("boolean")
    def by_automaton(s: pd.Series) -> pd.Series:
        p = automaton.compile(source)
        return s.map(lambda x: None if x is None else automaton.matches(p, x))

    return by_automaton(c)


# --- Label maps ------------------------------------------------------------------------------------------------------


def no_labels() -> Column:
    return F.create_map().cast(_STRINGS)


def label(labels: Column, name: str) -> Column:
    """A label's value; an absent one is the empty string."""
    return F.coalesce(labels[name], F.lit(""))


def without_label(labels: Column, name: str) -> Column:
    return F.map_filter(labels, lambda k, v: k != name)


def merged(base: Column, extra: Column) -> Column:
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extra), k)), extra)


def pairs(labels: Column) -> Column:
    """Label pairs as a sorted array; a label with an empty value is an absent one."""
    return F.sort_array(F.filter(F.map_entries(labels), lambda e: e["value"] != ""))


def grouped(k: Column, names: tuple[str, ...], without: bool) -> Column:
    if not names:
        return k if without else F.array().cast(_PAIRS)
    return F.filter(k, lambda e: ~e["key"].isin(*names) if without else e["key"].isin(*names))


def key_pairs(labels: Column, groupings: list[ast.Grouping]) -> Column:
    """Pairs of a label map that are left by groupings, one after the other.

    Where the groupings name the labels that stay, only those are looked up: no map is unfolded or sorted, and unused columns are pruned.
    """
    names: set[str] | None = None
    for g in groupings:
        if not g.without:
            names = set(g.labels) if names is None else names & set(g.labels)
        elif names is not None:
            names -= set(g.labels)
    if names is None:
        k = pairs(labels)
        for g in groupings:
            k = grouped(k, g.labels, g.without)
        return k
    if not names:
        return F.array().cast(_PAIRS)
    asked = F.array(*[F.struct(F.lit(n).alias("key"), label(labels, n).alias("value")) for n in sorted(names)])
    return F.filter(asked, lambda e: e["value"] != "")


def pair_value(k: Column, name: str) -> Column:
    return F.coalesce(F.get(F.filter(k, lambda e: e["key"] == name), F.lit(0))["value"], F.lit(""))


# --- Quantities in labels --------------------------------------------------------------------------------------------


def duration_seconds(c: Column) -> Column:
    """Seconds of a duration's text, null where it is none."""
    part = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ms|ns|us|µs|μs|[ywdhms])"
    seconds = F.aggregate(
        F.regexp_extract_all(c, F.lit(part), F.lit(0)),
        F.lit(0.0),
        lambda total, x: total + F.regexp_extract(x, part, 1).try_cast("double") * _unit(F.regexp_extract(x, part, 2)),
    )
    return F.when(c.rlike(rf"\A-?(?:{part})+\z"), F.when(c.startswith("-"), -seconds).otherwise(seconds))


def _unit(u: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, ns in _UNITS.items():
        out = F.when(u == name, ns / 1e9).otherwise(out)
    return out


def byte_size(c: Column) -> Column:
    """Bytes of a size's text, null where it is none."""
    part = r"(?i)\A\s*([0-9]+\.?[0-9]*|\.[0-9]+)\s*([kmgtpe]?)(i?)b?\s*\z"
    power = F.instr(F.lit("kmgtpe"), F.lower(F.regexp_extract(c, part, 2)))
    power = F.when(F.regexp_extract(c, part, 2) == "", 0).otherwise(power)
    base = F.when(F.regexp_extract(c, part, 3) == "", 1000.0).otherwise(1024.0)
    return F.when(c.rlike(part), F.regexp_extract(c, part, 1).try_cast("double") * F.pow(base, power))


# --- Parsers ---------------------------------------------------------------------------------------------------------


def _label_name(key: str) -> str:
    key = re.sub(r"[^A-Za-z0-9_]", "_", key)
    return "_" + key if key[:1].isdigit() else key


def flatten_json(text: str | None) -> dict[str, str] | None:
    """Scalar fields of a JSON object, nested names joined by _; None for anything else. Arrays are left out, null is the empty string."""
    try:
        record = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    out: dict[str, str] = {}

    def walk(prefix: str, v: object) -> None:
        if isinstance(v, dict):
            for key, x in v.items():
                name = _label_name(key)
                walk(f"{prefix}_{name}" if prefix else name, x)
        elif not isinstance(v, list) and prefix:
            out.setdefault(prefix, "" if v is None else v if isinstance(v, str) else json.dumps(v))

    walk("", record)
    return out


def json_fields(c: Column) -> Column:
    @F.pandas_udf(_STRINGS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(flatten_json)

    return run(c)


def logfmt_fields(text: str | None, strict: bool, keep_empty: bool) -> dict[str, str] | None:
    """Pairs of a logfmt line, the first of equal keys; None for a broken line in strict mode. Empty values only with keep_empty."""
    keys, vals, broken = logfmt_cells(text or "")
    if broken >= 0 and strict:
        return None
    out: dict[str, str] = {}
    for k, v in zip(keys, vals, strict=True):
        if v or keep_empty:
            out.setdefault(_label_name(k), v)
    return out


def pattern_expression(text: str) -> tuple[str, list[str]]:
    """Java expression of a pattern such as `<ip> - <_>`, anchored at the start, and the names that its groups capture."""
    names, out, at = [], [r"\A"], 0
    for m in re.finditer(r"<([A-Za-z_]\w*)>", text):
        out.append(sx.to_java(sx.parse(sx.quote(text[at : m.start()]))) if m.start() > at else "")
        last = m.end() == len(text)
        body = r"[\x{0}-\x{10ffff}]*" + ("" if last else "?")
        if m[1] == "_":
            out.append(body)
        else:
            names.append(m[1])
            out.append(f"({body})")
        at = m.end()
    if at < len(text):
        out.append(sx.to_java(sx.parse(sx.quote(text[at:]))))
    return "".join(x for x in out if x != "(?:)"), names


def _in_network(text: str):
    import ipaddress

    spec = text.strip()
    if "-" in spec and "/" not in spec:
        lo, hi = (ipaddress.ip_address(x.strip()) for x in spec.split("-", 1))
        return lambda a: a.version == lo.version and lo <= a <= hi
    net = ipaddress.ip_network(spec, strict=False)
    return lambda a: a.version == net.version and a in net


_ADDRESS = re.compile(r"(?<![0-9A-Fa-f:.])(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Fa-f:.]*[0-9A-Fa-f:])")


def holds_address(c: Column, spec: str) -> Column:
    """The text holds an address of a network, a range a-b, or one address."""
    try:
        _in_network(spec)
    except ValueError as e:
        raise QueryFault(f"bad address {spec!r}") from e

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        import ipaddress

        inside = _in_network(spec)

        def one(text: str | None) -> bool:
            for m in _ADDRESS.finditer(text or ""):
                try:
                    if inside(ipaddress.ip_address(m.group())):
                        return True
                except ValueError:
                    continue
            return False

        return s.map(one)

    return run(c)


# --- Templates -------------------------------------------------------------------------------------------------------

_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "ToUpper": F.upper, "upper": F.upper, "ToLower": F.lower, "lower": F.lower, "TrimSpace": F.trim, "trim": F.trim,
    "trimPrefix": lambda c, p: F.when(c.startswith(p), F.substring(c, len(p) + 1, 1 << 30)).otherwise(c),
    "trimSuffix": lambda c, p: F.when(c.endswith(p), F.left(c, F.length(c) - len(p))).otherwise(c),
    "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)),
    "default": lambda c, d: F.when(c == "", F.lit(d)).otherwise(c),
    "trunc": lambda c, n: F.left(c, F.lit(int(n))) if int(n) >= 0 else F.right(c, F.lit(-int(n))),
    "len": lambda c: F.length(c).cast("string"),
    "sha256sum": lambda c: F.sha2(c, 256),
    "urlencode": F.url_encode,
}


def template(text: str, labels: Column, line: Column) -> Column:
    """A Go template of fields and the functions above, joined by pipes; any other construct is a fault."""
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{-?\s*(.*?)\s*-?\}\}", text, re.DOTALL):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        at = m.end()
        value: Column | None = None
        for step in re.split(r"\|(?=(?:[^\"`]|\"[^\"]*\"|`[^`]*`)*$)", m[1]):
            words = re.findall(r'"(?:[^"\\]|\\.)*"|`[^`]*`|[^\s"`]+', step)
            if not words:
                raise QueryFault(f"empty template step in {text!r}")
            if words[0].startswith(".") and len(words) == 1 and value is None:
                value = label(labels, words[0][1:])
                continue
            if words == ["__line__"] and value is None:
                value = line
                continue
            f = _FUNCTIONS.get(words[0])
            if f is None:
                raise QueryFault(f"template function {words[0]!r} is not known")
            args: list = [w[1:-1] if w[0] in '"`' else w for w in words[1:]]
            if value is None:
                if not args or not args[-1].startswith("."):
                    raise QueryFault(f"template {m[1]!r} has no field")
                value = label(labels, args.pop()[1:])
            value = f(value, *args)
        parts.append(value)
    if at < len(text):
        parts.append(F.lit(text[at:]))
    if "{{" in text[at:]:
        raise QueryFault("unterminated template")
    return F.concat(*parts) if parts else F.lit("")


# --- Log queries -----------------------------------------------------------------------------------------------------


def matcher_condition(labels: Column, m: ast.Matcher) -> Column:
    if not m.op or m.label.startswith(("$", "[[")):
        raise QueryFault("template variables have no value here")
    v = label(labels, m.label)
    if m.op in ("=", "!="):
        c = v == m.value
    else:
        c = matches_expression(v, m.value, anchored=True)
    return ~c if m.op in ("!=", "!~") else c


def line_condition(line: Column, f: ast.LineFilter) -> Column:
    def one(kind: str, text: str) -> Column:
        if kind == "contains":
            return line.contains(text)
        if kind == "regex":
            return matches_expression(line, text)
        if kind == "ip":
            return holds_address(line, text)
        return line.rlike(pattern_expression(text)[0] + r"\z")

    any_of = reduce(lambda a, b: a | b, (one(*x) for x in f.alternatives))
    return ~any_of if f.negated else any_of


def _compare(op: str, a: Column, b: object) -> Column:
    return {"=": a == b, "==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


class _Rows:
    """Rows of a log query while its stages are applied."""

    def __init__(self, df: DataFrame):
        self.df = df

    def label(self, name: str) -> Column:
        return F.coalesce(F.col("err"), F.lit("")) if name == ERROR else label(F.col("labels"), name)

    def where(self, c: Column) -> None:
        self.df = self.df.where(c)

    def extract(self, fields: Column, fault: str | None) -> None:
        """Add extracted labels; one that a stream label has already gets the suffix _extracted."""
        known = F.map_keys("stream")
        named = F.transform_keys(F.coalesce(F.col("__f"), no_labels()), lambda k, v: F.when(F.array_contains(known, k), F.concat(k, F.lit("_extracted"))).otherwise(k))
        df = self.df.withColumn("__f", fields)
        if fault:
            df = df.withColumn("err", F.when(F.col("__f").isNull() & F.col("err").isNull(), F.lit(fault)).otherwise(F.col("err")))
        self.df = df.withColumn("__f", named).withColumn("labels", merged(F.col("labels"), F.col("__f"))).drop("__f")

    def condition(self, c) -> Column:
        """Boolean of a condition on labels. A value that can't be read as the kind it is compared with leaves the row in and sets err."""
        if isinstance(c, ast.Both):
            return self.condition(c.left) & self.condition(c.right)
        if isinstance(c, ast.Either):
            return self.condition(c.left) | self.condition(c.right)
        v = self.label(c.label)
        if c.kind == "variable":
            raise QueryFault("template variables have no value here")
        if c.kind == "ip":
            inside = holds_address(v, c.value)
            return ~inside if c.op == "!=" else inside
        if c.kind == "string":
            if c.op in ("=", "==", "!="):
                return (v != c.value) if c.op == "!=" else (v == c.value)
            if c.op in ("=~", "!~"):
                m = matches_expression(v, c.value, anchored=True)
                return ~m if c.op == "!~" else m
            raise QueryFault(f"strings can't be compared by {c.op}")
        read = {"number": lambda: v.try_cast("double"), "duration": lambda: duration_seconds(v), "bytes": lambda: byte_size(v)}[c.kind]()
        return F.when(v == "", F.lit(False)).otherwise(F.coalesce(_compare(c.op, read, float(c.value)), F.lit(True)))

    def faults(self, c) -> Column:
        """Whether a comparison met a value that it can't read."""
        if isinstance(c, ast.Both | ast.Either):
            return self.faults(c.left) | self.faults(c.right)
        if c.kind not in ("number", "duration", "bytes"):
            return F.lit(False)
        v = self.label(c.label)
        read = {"number": lambda: v.try_cast("double"), "duration": lambda: duration_seconds(v), "bytes": lambda: byte_size(v)}[c.kind]()
        return (v != "") & read.isNull()

    def apply(self, s) -> None:
        if isinstance(s, ast.LineFilter):
            self.where(line_condition(F.col("line"), s))
        elif isinstance(s, ast.Keep):
            keep, fault = self.condition(s.condition), self.faults(s.condition)
            self.df = self.df.where(keep).withColumn("err", F.when(F.col("err").isNull() & fault, F.lit("LabelFilterErr")).otherwise(F.col("err")))
        elif isinstance(s, ast.Parse):
            self.parse(s)
        elif isinstance(s, ast.Decolorize):
            self.df = self.df.withColumn("line", F.regexp_replace("line", r"\x{1b}\[[0-9;]*m", ""))
        elif isinstance(s, ast.LineFormat):
            self.df = self.df.withColumn("line", template(s.template, F.col("labels"), F.col("line")))
        elif isinstance(s, ast.LabelFormat):
            for name, source, is_template in s.items:
                if is_template:
                    self.df = self.df.withColumn("labels", merged(F.col("labels"), F.create_map(F.lit(name), template(source, F.col("labels"), F.col("line")))))
                else:  # a rename
                    old = without_label(F.col("labels"), source)
                    self.df = self.df.withColumn("labels", F.when(F.col("labels")[source].isNotNull(), merged(old, F.create_map(F.lit(name), F.col("labels")[source]))).otherwise(F.col("labels")))
        elif isinstance(s, ast.Project):
            self.project(s)
        elif isinstance(s, ast.Unwrap):
            v = self.label(s.label)
            read = byte_size(v) if s.conversion == "bytes" else duration_seconds(v) if s.conversion else v.try_cast("double")
            self.df = self.df.where(v != "").withColumn("sample", read).withColumn("labels", F.map_filter("labels", lambda k, v: k != s.label))
            self.df = self.df.withColumn("err", F.when(F.col("sample").isNull() & F.col("err").isNull(), F.lit("SampleExtractionErr")).otherwise(F.col("err")))
        else:
            raise QueryFault("template variables have no value here")

    def parse(self, s: ast.Parse) -> None:
        line = F.col("line")
        if s.kind == "json" and s.fields:
            v = F.try_parse_json(line)
            items = []
            for name, path in s.fields:
                steps = re.findall(r"""\[["']([^"']+)["']\]|\[(\d+)\]|([^.\[\]]+)""", path)
                p = "$" + "".join(f"[{b}]" if b else f"['{a or c}']" for a, b, c in steps)
                items += [F.lit(name), F.coalesce(F.try_variant_get(v, p, "string"), F.lit(""))]
            self.extract(F.when(v.isNotNull(), F.create_map(*items)), "JSONParserErr")
        elif s.kind == "json":
            self.extract(json_fields(line), "JSONParserErr")
        elif s.kind == "logfmt":
            strict, keep_empty = s.strict, s.keep_empty
            wanted = dict(s.fields)

            @F.pandas_udf(_STRINGS)
            def fields(lines: pd.Series) -> pd.Series:
                def one(text: str | None):
                    found = logfmt_fields(text, strict, keep_empty)
                    if wanted and found is not None:
                        found = {n: found[_label_name(k)] for n, k in wanted.items() if _label_name(k) in found}
                    return found

                return lines.map(one)

            self.extract(fields(line), "LogfmtParserErr")
        elif s.kind in ("regexp", "pattern"):
            if s.kind == "regexp":
                names = sx.group_names(sx.parse(s.text)) if java(s.text) else []
                if not any(names):
                    raise QueryFault("regexp needs a named group")
                expression, groups = java(s.text), [(i + 1, n) for i, n in enumerate(names) if n]
            else:
                expression, names = pattern_expression(s.text)
                if not names:
                    raise QueryFault("pattern needs a named capture")
                groups = [(i + 1, n) for i, n in enumerate(names)]
            items = [x for i, n in groups for x in (F.lit(n), F.regexp_extract(line, expression, i))]
            self.extract(F.when(line.rlike(expression), F.create_map(*items)), None)
        else:  # unpack
            self.extract(json_fields(line), "JSONParserErr")
            entry = F.col("labels")["_entry"]
            self.df = self.df.withColumn("line", F.coalesce(entry, line)).withColumn("labels", F.map_filter("labels", lambda k, v: k != "_entry"))

    def project(self, s: ast.Project) -> None:
        def chosen(k: Column, v: Column) -> Column:
            out = F.lit(False)
            for name, op, value in s.items:
                c = k == name
                if op:
                    e = v.rlike(java(value, True)) if op in ("=~", "!~") else v == value
                    c = c & (~e if op[0] == "!" else e)
                out = out | c
            return out

        self.df = self.df.withColumn("labels", F.map_filter("labels", (lambda k, v: chosen(k, v)) if s.keep else (lambda k, v: ~chosen(k, v))))
        if not s.keep and any(n == ERROR for n, _, _ in s.items):
            self.df = self.df.withColumn("err", F.lit(None).cast("string"))


@dataclass(frozen=True)
class Steps:
    """Times at which a metric query is evaluated: start, start + step, ..., count of them, in nanoseconds."""

    start: int
    step: int
    count: int


class LogStore:
    """Logs in a DataFrame, queried by LogQL.

    df: labels (map of strings; null is no label), ts_ns (bigint), line (string); rows without a time are in no range, a null line is an empty one. A metadata
    map, where there is one, holds labels that are no stream labels. Absent labels equal the empty string. Other columns are ignored.
    """

    def __init__(self, df: DataFrame, labels: str = "labels", ts_ns: str = "ts_ns", line: str = "line", metadata: str | None = None):
        base = F.coalesce(F.col(labels), no_labels())
        every = merged(base, F.coalesce(F.col(metadata), no_labels())) if metadata else base
        self.rows = df.select(F.col(ts_ns).cast("long").alias("ts_ns"), base.alias("stream"), every.alias("labels"), F.col(line).alias("line"), F.lit(None).cast("string").alias("err"))

    # Reads

    def logs(self, text: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
        """Rows of a log query in [start, end): ts_ns, labels, line. Errors of stages stand in the label __error__."""
        root = parse(text).root
        if not isinstance(root, ast.LogQuery):
            raise QueryFault("a metric query gives no lines")
        df = self._log(root, start_ns, end_ns, half_open=True)
        labels = F.when(F.col("err").isNotNull(), merged(F.col("labels"), F.create_map(F.lit(ERROR), F.col("err")))).otherwise(F.col("labels"))
        return df.select("ts_ns", labels.alias("labels"), "line")

    def sample(self, text: str, start_ns: int, end_ns: int, limit: int) -> DataFrame:
        """The `limit` oldest rows of a log query; ties by line."""
        return self.logs(text, start_ns, end_ns).orderBy("ts_ns", "line").limit(limit)

    def instant(self, text: str, at_ns: int) -> DataFrame:
        """labels, value of a metric query at one time."""
        return self._output(text, Steps(at_ns, 1, 1)).select("labels", "value")

    def over(self, text: str, start_ns: int, end_ns: int, step_ns: int) -> DataFrame:
        """at_ns, labels, value of a metric query at start, start + step, ... up to end."""
        if step_ns <= 0 or end_ns < start_ns:
            raise QueryFault("bad range of steps")
        return self._output(text, Steps(start_ns, step_ns, (end_ns - start_ns) // step_ns + 1)).select("at_ns", "labels", "value")

    def label_values(self, name: str, start_ns: int, end_ns: int) -> DataFrame:
        v = F.col("stream")[name].alias("value")
        return self._range(self.rows, start_ns, end_ns, True).select(v).where("value is not null").distinct().orderBy("value")

    def label_names(self, text: str, start_ns: int, end_ns: int) -> DataFrame:
        """Names of the labels of the streams that a selector matches; metadata is none."""
        return self._log(parse(text).root, start_ns, end_ns, True).select(F.explode(F.map_keys("stream")).alias("name")).distinct().orderBy("name")

    # Log queries

    @staticmethod
    def _range(df: DataFrame, start: int | None, end: int | None, half_open: bool) -> DataFrame:
        t = F.col("ts_ns")
        if half_open:
            low, high = (lambda: t >= start), (lambda: t < end)
        else:
            low, high = (lambda: t > start), (lambda: t <= end)
        if start is not None:
            df = df.where(low())
        return df.where(high()) if end is not None else df

    def _log(self, q: ast.LogQuery, start: int | None, end: int | None, half_open: bool) -> DataFrame:
        df = self._range(self.rows, start, end, half_open)
        for m in q.matchers:
            df = df.where(matcher_condition(F.col("stream"), m))
        # Texts that a line must hold are asked of the column as it is stored, so that the scan can skip by them; a null line holds none.
        stages = list(q.stages)
        for s in q.stages:
            if not isinstance(s, ast.LineFilter):
                break
            if not s.negated and all(k == "contains" and t for k, t in s.alternatives):
                df = df.where(line_condition(F.col("line"), s))
                stages.remove(s)
        rows = _Rows(df.withColumn("line", F.coalesce("line", F.lit(""))))
        for s in stages:
            rows.apply(s)
        return rows.df

    # Metric queries

    def _output(self, text: str, steps: Steps) -> DataFrame:
        q = parse(text)
        v = self._vector(q.root, steps)
        if isinstance(v, float):
            v = self._constant(v, steps)
        out = v.select(F.col("at").alias("at_ns"), F.map_from_entries("k").alias("labels"), "value")
        root = q.root
        if isinstance(root, ast.VectorAgg) and root.func in ("sort", "sort_desc"):
            keys = [F.col("value").desc() if root.func == "sort_desc" else F.col("value").asc(), F.sort_array(F.map_entries("labels"))]
            out = out.orderBy("at_ns", *keys)
        return out

    def _constant(self, value: float, steps: Steps) -> DataFrame:
        at = self.rows.sparkSession.range(steps.count).select((F.lit(steps.start) + F.col("id") * steps.step).alias("at"))
        return at.select("at", F.array().cast(_PAIRS).alias("k"), F.lit(value).alias("value"))

    def _vector(self, n, steps: Steps):
        """A DataFrame of at, k, value, or a float for a scalar."""
        if isinstance(n, ast.Number):
            return n.value
        if isinstance(n, ast.Vector):
            return self._constant(n.value, steps)
        if isinstance(n, ast.Negate):
            v = self._vector(n.inner, steps)
            return -v if isinstance(v, float) else v.withColumn("value", -F.col("value"))
        if isinstance(n, ast.RangeAgg):
            return self._range_agg(n, steps, None)
        if isinstance(n, ast.VectorAgg):
            return self._vector_agg(n, steps)
        if isinstance(n, ast.Binary):
            return self._binary(n, steps)
        if isinstance(n, ast.LabelReplace):
            return self._label_replace(n, steps)
        if isinstance(n, ast.Variants):
            return self._variants(n, steps)
        raise QueryFault("a log query has no value")

    def _range_rows(self, n: ast.RangeAgg, steps: Steps, sum_by: ast.Grouping | None) -> tuple[DataFrame, float, bool]:
        """(rows of the range with k, v, bytes, and the first and last of several steps that they fall into; seconds of the range; whether v is unwrapped)."""
        width = duration_ns(n.range_text)
        offset = 0
        if n.offset_text:
            offset = -duration_ns(n.offset_text[1:].strip()) if n.offset_text.startswith("-") else duration_ns(n.offset_text)
        if width <= 0:
            raise QueryFault("empty range")
        last = steps.start + (steps.count - 1) * steps.step
        df = self._log(n.log, steps.start - offset - width, last - offset, half_open=False)
        unwrapped = any(isinstance(s, ast.Unwrap) for s in n.log.stages)
        seconds = width / 1e9
        need = n.func not in ("count_over_time", "rate", "bytes_over_time", "bytes_rate", "absent_over_time")
        if need and not unwrapped:
            raise QueryFault(f"{n.func} needs unwrap")
        if n.func == "quantile_over_time" and n.param is None:
            raise QueryFault("quantile_over_time needs a parameter")
        k = key_pairs(F.col("labels"), [g for g in (n.grouping, sum_by) if g is not None])
        df = df.where(F.col("err").isNull()) if unwrapped or n.func != "absent_over_time" else df
        v = F.col("sample") if unwrapped else F.lit(1.0)
        df = df.select("ts_ns", k.alias("k"), v.alias("v"), F.octet_length("line").cast("double").alias("bytes"))
        if steps.count > 1:
            wide = F.lit(steps.step).cast("decimal(20,0)")
            first = F.greatest(F.lit(0), F.ceil((F.col("ts_ns") + (offset - steps.start)) / wide).cast("long"))
            final = F.least(F.lit(steps.count - 1), F.floor((F.col("ts_ns") + (offset + width - 1 - steps.start)) / wide).cast("long"))
            df = df.withColumn("first", first).withColumn("last", final).where("first <= last")
        return df, seconds, unwrapped

    def _range_agg(self, n: ast.RangeAgg, steps: Steps, sum_by: ast.Grouping | None) -> DataFrame:
        """sum_by: the grouping of a sum around this aggregation, folded into it."""
        df, seconds, unwrapped = self._range_rows(n, steps, sum_by)
        agg = self._fold(df, n.func, seconds, unwrapped, n.param, steps.count > 1)
        out = agg.select((F.lit(steps.start) + F.col("i") * steps.step).alias("at"), "k", "value")
        if n.func == "absent_over_time":
            named = sorted((m.label, m.value) for m in n.log.matchers if m.op == "=" and m.value)
            k = F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("value")) for a, b in named]).cast(_PAIRS) if named else F.array().cast(_PAIRS)
            return self._constant(1.0, steps).withColumn("k", k).join(out.select("at").distinct(), "at", "left_anti")
        return out

    @staticmethod
    def _fold(df: DataFrame, func: str, seconds: float, unwrapped: bool, param: float | None, many: bool) -> DataFrame:
        """i (index of the step), k, value. many: rows have the first and last of several steps; else there is one."""
        each = F.explode(F.sequence("first", "last")).alias("i")
        latest = lambda pick: (pick(F.struct("ts_ns", "v")), pick)
        simple = {
            "count_over_time": (F.count(F.lit(1)), F.sum), "rate": (F.sum("v"), F.sum), "bytes_over_time": (F.sum("bytes"), F.sum), "bytes_rate": (F.sum("bytes"), F.sum), "sum_over_time": (F.sum("v"), F.sum),
            "min_over_time": (F.min("v"), F.min), "max_over_time": (F.max("v"), F.max), "absent_over_time": (F.count(F.lit(1)), F.sum), "first_over_time": latest(F.min), "last_over_time": latest(F.max),
            "avg_over_time": (F.struct(F.sum("v").alias("s"), F.count("v").alias("c")), lambda c: F.struct(F.sum(f"{c}.s").alias("s"), F.sum(f"{c}.c").alias("c"))),
        }
        if func in simple:
            partial, combine = simple[func]
            if many:
                part = df.groupBy("k", "first", "last").agg(partial.alias("part"))
                out = part.select("k", each, "part").groupBy("i", "k").agg(combine("part").alias("total"))
            else:
                out = df.groupBy("k").agg(partial.alias("total")).withColumn("i", F.lit(0))
            if func == "avg_over_time":
                value = F.col("total.s") / F.col("total.c")
            else:
                value = F.col("total.v") if func in ("first_over_time", "last_over_time") else F.col("total").cast("double")
            return out.select("i", "k", (value / seconds if func in ("rate", "bytes_rate") else value).alias("value"))
        if func in ("stddev_over_time", "stdvar_over_time") and many:
            # Rows of the same steps fold to count, mean and squared distances from it; the parts of a step are put together about their common mean.
            part = df.groupBy("k", "first", "last").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"))
            step = Window.partitionBy("i", "k")
            spread = part.select("k", each, "n", "mean", "m2").withColumn("all", F.sum(F.col("n") * F.col("mean")).over(step) / F.nullif(F.sum("n").over(step), F.lit(0)))
            square = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), F.lit(2.0))) / F.nullif(F.sum("n"), F.lit(0))
            return spread.groupBy("i", "k").agg((square if func == "stdvar_over_time" else F.sqrt(square)).alias("value"))
        rows = df.select("k", each if many else F.lit(0).alias("i"), "ts_ns", "v")
        if func == "rate_counter":
            before = F.lag("v").over(Window.partitionBy("i", "k").orderBy("ts_ns", "v"))
            gain = F.when(before.isNull(), 0.0).when(F.col("v") >= before, F.col("v") - before).otherwise(F.col("v"))
            return rows.withColumn("gain", gain).groupBy("i", "k").agg((F.sum("gain") / seconds).alias("value"))
        agg = {"stddev_over_time": F.stddev_pop("v"), "stdvar_over_time": F.var_pop("v"), "quantile_over_time": F.percentile("v", F.lit(min(max(param or 0.0, 0.0), 1.0)))}[func]
        return rows.groupBy("i", "k").agg(agg.alias("value"))

    def _vector_agg(self, n: ast.VectorAgg, steps: Steps) -> DataFrame:
        g = n.grouping or ast.Grouping(False, ())
        foldable = ("count_over_time", "rate", "bytes_over_time", "bytes_rate", "sum_over_time")
        if n.func == "sum" and isinstance(n.inner, ast.RangeAgg) and n.inner.func in foldable:
            return self._range_agg(n.inner, steps, g)
        v = self._vector(n.inner, steps)
        if isinstance(v, float):
            raise QueryFault(f"{n.func} of a number")
        if n.func in ("sort", "sort_desc"):
            return v
        v = v.withColumn("g", grouped(F.col("k"), g.labels, g.without))
        if n.func in ("topk", "bottomk", "approx_topk"):
            value = F.col("value").asc() if n.func == "bottomk" else F.col("value").desc()
            # Only the first rows of a window are wanted: Spark cuts each partition to them before it shuffles.
            rank = F.row_number().over(Window.partitionBy("at", "g").orderBy(value, "k"))
            return v.withColumn("rank", rank).where(F.col("rank") <= int(n.param)).select("at", "k", "value")
        agg = {"sum": F.sum("value"), "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value").cast("double"), "stddev": F.stddev_pop("value"), "stdvar": F.var_pop("value")}[n.func]
        return v.groupBy("at", F.col("g").alias("k")).agg(agg.alias("value"))

    def _label_replace(self, n: ast.LabelReplace, steps: Steps) -> DataFrame:
        v = self._vector(n.inner, steps)
        tree = sx.parse(n.pattern) if java(n.pattern) else None
        whole = rf"\A(?s:{n.pattern})\z"
        expression = sx.java(whole)
        source = pair_value(F.col("k"), n.source)
        names = sx.group_names(tree)
        parts: list[Column] = []
        at = 0
        for m in re.finditer(r"\$(?:(\d+)|(\w+)|\{(\w+)\})", n.replacement):
            parts.append(F.lit(n.replacement[at : m.start()]))
            ref = m[1] or m[2] or m[3]
            index = int(ref) if ref.isdigit() else names.index(ref) + 1 if ref in names else -1
            parts.append(F.regexp_extract(source, expression, index) if 0 <= index <= len(names) else F.lit(""))
            at = m.end()
        parts.append(F.lit(n.replacement[at:]))
        new = F.struct(F.lit(n.target).alias("key"), F.concat(*parts).alias("value"))
        others = F.filter("k", lambda e: e["key"] != n.target)
        k = F.sort_array(F.filter(F.concat(others, F.array(new)), lambda e: e["value"] != ""))
        return v.withColumn("k", F.when(source.rlike(expression), k).otherwise(F.col("k")))

    def _variants(self, n: ast.Variants, steps: Steps) -> DataFrame:
        if not all(isinstance(item, ast.RangeAgg) for item in n.items):
            raise QueryFault("a variant has to be a range aggregation")
        # The variants read the log query after `of`, with its range.
        shared = [
            ast.RangeAgg(x.func, ast.LogQuery(n.of.log.matchers, n.of.log.stages + tuple(s for s in x.log.stages if isinstance(s, ast.Unwrap))), n.of.range_text, n.of.offset_text, x.param, x.grouping) for x in n.items
        ]
        marked = lambda k, i: F.sort_array(F.concat(k, F.array(F.struct(F.lit("__variant__").alias("key"), i.alias("value")))))
        counted = {"count_over_time": ("c", False), "rate": ("c", True), "bytes_over_time": ("b", False), "bytes_rate": ("b", True)}
        if all(x.func in counted and x.log == shared[0].log and x.grouping == shared[0].grouping for x in shared):
            # All are counts of the same rows: one scan and one aggregation.
            df, seconds, _ = self._range_rows(shared[0], steps, None)
            sums = lambda c, b: (c.alias("c"), F.sum(b).alias("b"))
            if steps.count > 1:
                part = df.groupBy("k", "first", "last").agg(*sums(F.count(F.lit(1)), "bytes"))
                total = part.select("k", F.explode(F.sequence("first", "last")).alias("i"), "c", "b").groupBy("i", "k").agg(*sums(F.sum("c"), "b"))
            else:
                total = df.groupBy("k").agg(*sums(F.count(F.lit(1)), "bytes")).withColumn("i", F.lit(0))
            value = lambda x: F.col(counted[x.func][0]).cast("double") / (seconds if counted[x.func][1] else 1.0)
            each = F.inline(F.array(*[F.struct(F.lit(str(i)).alias("variant"), value(x).alias("value")) for i, x in enumerate(shared)]))
            return total.select((F.lit(steps.start) + F.col("i") * steps.step).alias("at"), "k", each).select("at", marked(F.col("k"), F.col("variant")).alias("k"), "value")
        out = None
        for i, x in enumerate(shared):
            v = self._range_agg(x, steps, None).withColumn("k", marked(F.col("k"), F.lit(str(i))))
            out = v if out is None else out.unionByName(v)
        return out

    # Operators

    @staticmethod
    def _outer_sum(n: ast.Binary) -> tuple | None:
        """(a, b) of `(a + b) or a or b`, the sum that keeps the series of either side: one full outer join instead of five evaluations."""
        inner = n.left
        if n.op != "or" or n.matching or not isinstance(inner, ast.Binary) or inner.op != "or" or inner.matching:
            return None
        both = inner.left
        plain = isinstance(both, ast.Binary) and both.op == "+" and not both.matching
        return (both.left, both.right) if plain and both.left == inner.right and both.right == n.right else None

    def _binary(self, n: ast.Binary, steps: Steps):
        if pair := self._outer_sum(n):
            a, b = (self._vector(x, steps) for x in pair)
            if not isinstance(a, float) and not isinstance(b, float):
                joined = a.select("at", "k", F.col("value").alias("va")).join(b.select("at", "k", F.col("value").alias("vb")), ["at", "k"], "full_outer")
                return joined.select("at", "k", (F.coalesce("va", F.lit(0.0)) + F.coalesce("vb", F.lit(0.0))).alias("value"))
        a, b = self._vector(n.left, steps), self._vector(n.right, steps)
        if n.op in ("and", "or", "unless"):
            if isinstance(a, float) or isinstance(b, float):
                raise QueryFault(f"{n.op} needs vectors")
            return self._set(n, a, b)
        if isinstance(a, float) and isinstance(b, float):
            return _scalar(n.op, a, b)
        if isinstance(a, float) or isinstance(b, float):
            v = b if isinstance(a, float) else a
            left, right = (F.lit(a), F.col("value")) if isinstance(a, float) else (F.col("value"), F.lit(b))
            return self._computed(v, n, left, right, F.col("value"))
        m = n.matching or ast.Matching(True, ())
        key = lambda c: grouped(c, m.labels, m.ignoring)
        left = a.select("at", F.col("k").alias("ka"), F.col("value").alias("va"), key(F.col("k")).alias("j"))
        right = b.select("at", F.col("k").alias("kb"), F.col("value").alias("vb"), key(F.col("k")).alias("j"))
        if m.many != "left":
            left = _single(left, "ka", "va")
        if m.many != "right":
            right = _single(right, "kb", "vb")
        joined = left.join(right, ["at", "j"])
        if not m.many:
            k = F.col("j")
        else:
            many, one = ("ka", "kb") if m.many == "left" else ("kb", "ka")
            k = F.col(many)
            if m.include:
                own = F.filter(many, lambda e: ~e["key"].isin(*m.include))
                k = F.sort_array(F.concat(own, F.filter(one, lambda e: e["key"].isin(*m.include))))
        return self._computed(joined.select("at", k.alias("k"), "va", "vb"), n, F.col("va"), F.col("vb"), F.col("va"))

    @staticmethod
    def _computed(v: DataFrame, n: ast.Binary, a: Column, b: Column, kept: Column) -> DataFrame:
        if n.op in ("==", "!=", ">", ">=", "<", "<="):
            # Spark orders NaN above all numbers; here it compares as unequal only.
            nan = F.isnan(a) | F.isnan(b)
            c = _compare(n.op, a, b) | nan if n.op == "!=" else _compare(n.op, a, b) & ~nan
            if n.as_bool:
                return v.select("at", "k", F.when(c, 1.0).otherwise(0.0).alias("value"))
            return v.where(c).select("at", "k", kept.alias("value"))
        return v.select("at", "k", _arithmetic(n.op, a, b).alias("value"))

    @staticmethod
    def _set(n: ast.Binary, a: DataFrame, b: DataFrame) -> DataFrame:
        m = n.matching or ast.Matching(True, ())
        j = grouped(F.col("k"), m.labels, m.ignoring).alias("j")
        left = a.select("at", "k", "value", j)
        right = b.select("at", "k", "value", j)
        how = {"and": "left_semi", "unless": "left_anti"}.get(n.op)
        if how:
            return left.join(right.select("at", "j"), ["at", "j"], how).select("at", "k", "value")
        rest = right.join(left.select("at", "j"), ["at", "j"], "left_anti")
        return left.select("at", "k", "value").unionByName(rest.select("at", "k", "value"))


def _single(v: DataFrame, k: str, value: str) -> DataFrame:
    """One row for each time and matching key; several are an error, as the language has it."""
    g = v.groupBy("at", "j").agg(F.first(k).alias(k), F.first(value).alias(value), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.lit("several series match one: use group_left or group_right")).cast("double")).otherwise(F.col(value))
    return g.select("at", "j", k, checked.alias(value))


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op == "^":
        return F.pow(a, b)
    inf, nan = F.lit(math.inf), F.lit(math.nan)
    if op == "/":
        by_zero = F.when(F.isnan(a) | (a == 0), nan).when(a > 0, inf).otherwise(-inf)
        return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))
    # The sign of the remainder is that of the dividend.
    return F.when(b == 0, nan).otherwise(F.try_mod(a, F.when(b != 0, b)))


def _scalar(op: str, a: float, b: float) -> float:
    if op in ("==", "!=", ">", ">=", "<", "<="):
        return float({"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op])
    try:
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "^": lambda: a**b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[op]()
    except (ZeroDivisionError, ValueError, OverflowError):
        return math.nan if op == "%" or a == 0 or a != a else math.copysign(math.inf, a)
