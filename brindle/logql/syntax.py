"""LogQL text: tokens, parser, canonical form and quantities."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from brindle.logql import ast
from brindle.operators.unparsed import _ESCAPE, _unescape
from brindle.relang import automaton, syntax as sx

MAX_QUERY_BYTES = 256 * 1024
MAX_DEPTH = 400


class QueryFault(ValueError):
    """The text is no LogQL query."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int
    end: int


#: The function names and operators of the language.
RANGE_FUNCTIONS = frozenset(
    "rate rate_counter count_over_time bytes_rate bytes_over_time avg_over_time sum_over_time min_over_time max_over_time stdvar_over_time stddev_over_time quantile_over_time "
    "first_over_time last_over_time absent_over_time".split()
)
VECTOR_FUNCTIONS = frozenset("sum avg max min count stddev stdvar bottomk topk sort sort_desc approx_topk".split())
PRECEDENCE = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, ">": 3, ">=": 3, "<": 3, "<=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}
COMPARISONS = frozenset(["==", "!=", ">", ">=", "<", "<="])
_LINE_FILTERS = {"|=": ("contains", False), "!=": ("contains", True), "|~": ("regex", False), "!~": ("regex", True), "|>": ("pattern", False), "!>": ("pattern", True)}

_NUM = r"(?:\d+\.?\d*|\.\d+)"
_DUR = rf"(?:{_NUM}(?:ms|ns|us|µs|μs|[ywdhms]))+"
_TOKEN = re.compile(
    rf"""(?P<skip>\s+|\#[^\n]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)
    |(?P<range>\[(?!\[)[^\]]*\])
    |(?P<variable>\$\{{[^}}]+\}}|\$\w+|\[\[\w+(?::\w+)?\]\])
    |(?P<flag>--[A-Za-z\-]+)
    |(?P<duration>{_DUR}(?![\w.]))
    |(?P<bytes>{_NUM}(?:[kKmMgGtTpPeE][iI]?[bB]?|[bB])(?![\w.]))
    |(?P<number>{_NUM}(?:[eE][+-]?\d+)?(?![\w.]))
    |(?P<ident>[A-Za-z_][A-Za-z0-9_]*(?::[A-Za-z_][A-Za-z0-9_:]*)?)
    |(?P<op>\|=|\|~|\|>|!=|!~|!>|=~|==|>=|<=|[{{}}()=,|<>+\-*/%^])""",
    re.VERBOSE | re.ASCII,
)
_BYTES_UNIT = re.compile(rf"({_NUM})([kmgtpe]?)(i?)b?", re.IGNORECASE)


def unquote(raw: str) -> str:
    """Value of a string literal: double and single quotes hold the escapes of a double-quoted Go string, backticks are raw."""
    if raw[0] == "`":
        return raw[1:-1]
    body = raw[1:-1]
    if raw[0] == "'":
        body = body.replace("\\'", "'")
    rest = _ESCAPE.sub(b"", body.encode("utf-8", "surrogatepass"))
    if b"\\" in rest:
        raise QueryFault(f"unknown escape in {raw[:40]}")
    try:
        return _ESCAPE.sub(_unescape, body.encode("utf-8", "surrogatepass")).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError, ValueError) as e:
        raise QueryFault("string is not valid UTF-8") from e


def go_quote(text: str) -> str:
    out = []
    for c in text:
        if c in '\\"':
            out.append("\\" + c)
        elif c in "\n\t\r":
            out.append({"\n": "\\n", "\t": "\\t", "\r": "\\r"}[c])
        elif c.isprintable():
            out.append(c)
        else:
            n = ord(c)
            out.append(f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}")
    return '"' + "".join(out) + '"'


def quote(text: str) -> str:
    """A literal of text, raw where it can be."""
    return go_quote(text) if "`" in text or "\r" in text else f"`{text}`"


def tokens(text: str) -> list[Token]:
    if len(text.encode("utf-8", "surrogatepass")) > MAX_QUERY_BYTES:
        raise QueryFault("the query is too long")
    try:
        text.encode("utf-8")
    except UnicodeEncodeError as e:
        raise QueryFault("the query is not valid UTF-8") from e
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise QueryFault(f"unexpected {text[at : at + 20]!r} at {at}")
        kind, raw = m.lastgroup, m.group()
        if kind == "flag" and raw not in ("--strict", "--keep-empty"):
            raise QueryFault(f"unknown flag {raw}")
        if kind == "string":
            out.append(Token(kind, unquote(raw), at, m.end()))
        elif kind == "range":
            out.append(Token(kind, raw[1:-1].strip(), at, m.end()))
        elif kind != "skip":
            out.append(Token(kind, raw, at, m.end()))
        at = m.end()
    return out


#: Nanoseconds of a unit.
_UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86_400 * 10**9, "w": 604_800 * 10**9, "y": 31_536_000 * 10**9}
_PART = re.compile(rf"({_NUM})(ms|ns|us|µs|μs|[ywdhms])", re.ASCII)


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration such as 1h30m or 1.5s."""
    at, total = 0, 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None:
            raise QueryFault(f"bad duration {text!r}")
        whole, _, frac = m[1].partition(".")
        unit = _UNITS[m[2]]
        total += int(whole or 0) * unit + (int(frac) * unit // 10 ** len(frac) if frac else 0)
        at = m.end()
    if not text:
        raise QueryFault("empty duration")
    return total


def bytes_value(text: str) -> float:
    """Bytes of a size such as 10KB (1000 each) or 1.5MiB (1024 each)."""
    m = _BYTES_UNIT.fullmatch(text)
    if m is None:
        raise QueryFault(f"bad size {text!r}")
    power = " kmgtpe".index(m[2].lower() or " ")
    return float(m[1]) * (1024 if m[3] else 1000) ** power


class _Parser:
    def __init__(self, text: str):
        self.text, self.t, self.i = text, tokens(text), 0
        self.query = ast.Query(text, None)
        self.counting = 0
        self.depth = 0

    def peek(self, n: int = 0) -> Token:
        return self.t[self.i + n] if self.i + n < len(self.t) else Token("end", "", len(self.text), len(self.text))

    def next(self) -> Token:
        t = self.peek()
        self.i += 1
        return t

    def fault(self, wanted: str) -> QueryFault:
        return QueryFault(f"expected {wanted} at {self.peek().at}, got {self.peek().text!r}")

    def op(self, *texts: str, n: int = 0) -> bool:
        t = self.peek(n)
        return t.kind == "op" and t.text in texts

    def word(self, *texts: str, n: int = 0) -> bool:
        t = self.peek(n)
        return t.kind == "ident" and t.text.lower() in texts

    def take(self, text: str) -> None:
        if not self.op(text):
            raise self.fault(text)
        self.i += 1

    def take_kind(self, kind: str, what: str | None = None) -> str:
        if self.peek().kind != kind:
            raise self.fault(what or kind)
        return self.next().text

    def end(self) -> int:
        return self.t[self.i - 1].end

    def whole(self) -> ast.Query:
        self.query.root = self.binary(0)
        if self.peek().kind != "end":
            raise self.fault("end of query")
        return self.query

    # Expressions

    def nested(self, parse, *a):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryFault("nested too deep")
        out = parse(*a)
        self.depth -= 1
        return out

    def binary(self, least: int):
        left = self.nested(self.unary)
        while True:
            t = self.peek()
            op = t.text.lower() if t.kind in ("op", "ident") else ""
            level = PRECEDENCE.get(op)
            if level is None or level < least:
                return left
            self.i += 1
            as_bool, matching = self.modifiers()
            right = self.nested(self.binary, level if op == "^" else level + 1)
            left = ast.Binary(op, left, right, as_bool, matching)

    def modifiers(self):
        as_bool = self.word("bool")
        self.i += as_bool
        if not self.word("on", "ignoring"):
            return as_bool, None
        ignoring = self.next().text.lower() == "ignoring"
        labels = self.label_list()
        many, include = "", ()
        if self.word("group_left", "group_right"):
            many = self.next().text.lower()[6:]
            if self.op("("):
                include = self.label_list()
        return as_bool, ast.Matching(ignoring, labels, many, include)

    def label_list(self) -> tuple[str, ...]:
        self.take("(")
        out = []
        while not self.op(")"):
            if self.peek().kind not in ("ident", "variable"):
                raise self.fault("label")
            out.append(self.next().text)
            if self.op(","):
                self.i += 1
        self.i += 1
        return tuple(out)

    def unary(self):
        t = self.peek()
        if self.op("-", "+"):
            self.i += 1
            # The sign holds for a power as a whole, as in arithmetic.
            inner = self.nested(self.binary, PRECEDENCE["^"])
            return ast.Negate(inner) if t.text == "-" else inner
        if t.kind == "number":
            self.i += 1
            return ast.Number(float(t.text))
        if self.op("("):
            # Parentheses around a log query with stages after them belong to the query.
            mark = self.i
            self.i += 1
            inner = self.binary(0)
            self.take(")")
            if isinstance(inner, ast.LogQuery) and (self.op("|") or self.op(*_LINE_FILTERS) and self.peek(1).kind in ("string",)):
                self.query.logs.pop()
                self.i = mark
                return self.log(False)[0]
            return inner
        if self.op("{"):
            return self.log(False)[0]
        if t.kind == "ident":
            name = t.text.lower()
            if name in RANGE_FUNCTIONS and self.op("(", n=1):
                return self.range_agg()
            if name in VECTOR_FUNCTIONS:
                return self.vector_agg()
            if name == "label_replace":
                self.i += 1
                self.take("(")
                inner = self.binary(0)
                strings = []
                for _ in range(4):
                    self.take(",")
                    strings.append(self.take_kind("string"))
                self.take(")")
                return ast.LabelReplace(inner, strings[0], strings[1], strings[2], strings[3])
            if name == "vector":
                self.i += 1
                self.take("(")
                v = float(self.take_kind("number"))
                self.take(")")
                return ast.Vector(v)
            if name == "variants":
                return self.variants()
        raise self.fault("expression")

    def grouping(self) -> ast.Grouping | None:
        if not self.word("by", "without"):
            return None
        at = self.peek().at
        without = self.next().text.lower() == "without"
        labels = self.label_list()
        return ast.Grouping(without, labels, (at, self.end()))

    def vector_agg(self):
        start = self.next()
        name = start.text.lower()
        grouping = self.grouping()
        self.take("(")
        param = None
        if name in ("topk", "bottomk", "approx_topk"):
            if self.peek().kind == "variable":
                raise QueryFault("a template variable stands for a number")
            param = float(self.take_kind("number"))
            self.take(",")
        inner = self.binary(0)
        self.take(")")
        if grouping is None:
            grouping = self.grouping()
        if grouping is not None and name in ("sort", "sort_desc"):
            raise QueryFault(f"{name} takes no grouping")
        out = ast.VectorAgg(name, inner, param, grouping, (start.at, self.end()))
        self.query.vectors.append(out)
        return out

    def range_agg(self):
        start = self.next()
        name = start.text.lower()
        self.take("(")
        param = None
        if self.peek().kind == "number" and self.op(",", n=1):
            param = float(self.next().text)
            self.i += 1
        self.counting += 1
        log, rng, offset = self.log(True)
        self.counting -= 1
        self.take(")")
        grouping = self.grouping()
        out = ast.RangeAgg(name, log, rng, offset, param, grouping, (start.at, self.end()))
        self.query.ranges.append(out)
        return out

    def variants(self):
        start = self.next()
        self.take("(")
        items = [self.binary(0)]
        while self.op(","):
            self.i += 1
            items.append(self.binary(0))
        self.take(")")
        if not self.word("of"):
            raise self.fault("of")
        self.i += 1
        self.take("(")
        self.counting += 1
        log, rng, offset = self.log(True)
        self.counting -= 1
        self.take(")")
        return ast.Variants(tuple(items), ast.RangeAgg("count_over_time", log, rng, offset, span=(start.at, self.end())))

    # Log queries

    def log(self, in_range: bool):
        depth = 0
        while self.op("("):
            self.i += 1
            depth += 1
        wrapped = depth > 0
        at = self.peek().at
        matchers = self.selector()
        selector = (at, self.end())
        stages: list = []
        filters: list[tuple[int, int]] = []
        rng, offset = None, ""
        while True:
            if in_range and rng is None and self.peek().kind == "range":
                rng = self.next().text
                if self.word("offset"):
                    self.i += 1
                    at = self.peek().at
                    if self.op("-"):
                        self.i += 1
                    self.take_kind("duration")
                    offset = self.text[at : self.end()]
            elif depth and self.op(")"):
                self.i += 1
                depth -= 1
            elif self.op(*_LINE_FILTERS):
                at = self.peek().at
                stages.append(self.line_filter())
                filters.append((at, self.end()))
            elif self.op("|"):
                self.i += 1
                stages.append(self.stage(in_range))
            else:
                break
        if depth:
            raise self.fault(")")
        if in_range and not (rng or "").strip():
            raise QueryFault("range aggregation without a range")
        if not in_range and self.peek().kind == "range":
            raise QueryFault("range outside a range aggregation")
        out = ast.LogQuery(matchers, tuple(stages), selector, tuple(filters), wrapped)
        self.query.logs.append((out, self.counting > 0))
        return out, rng, offset

    def selector(self) -> tuple[ast.Matcher, ...]:
        self.take("{")
        out = []
        while not self.op("}"):
            out.append(self.matcher())
            if self.op(","):
                self.i += 1
            elif not self.op("}"):
                raise self.fault(", or }")
        self.i += 1
        if not any(_bounds(m) for m in out):
            raise QueryFault("a selector needs an equality or expression matcher that the empty value doesn't pass")
        return tuple(out)

    def matcher(self) -> ast.Matcher:
        name = self.peek()
        if name.kind not in ("ident", "variable"):
            raise self.fault("label")
        self.i += 1
        if name.kind == "variable" and self.op(",", "}"):
            return ast.Matcher(name.text, "", "")
        if not self.op("=", "!=", "=~", "!~"):
            raise self.fault("matcher operator")
        op = self.next().text
        return ast.Matcher(name.text, op, self.take_kind("string"))

    def line_filter(self) -> ast.LineFilter:
        kind, negated = _LINE_FILTERS[self.next().text]
        found = [self.filter_value(kind)]
        while self.word("or") and (self.peek(1).kind == "string" or self.word("ip", n=1)):
            self.i += 1
            found.append(self.filter_value(kind))
        return ast.LineFilter(negated, tuple(found))

    def filter_value(self, kind: str) -> tuple[str, str]:
        if self.word("ip") and self.op("(", n=1):
            self.i += 2
            v = self.take_kind("string")
            self.take(")")
            return "ip", v
        return kind, self.take_kind("string")

    def stage(self, in_range: bool):
        t = self.peek()
        if t.kind == "variable":
            self.i += 1
            return ast.VariableStage(t.text)
        if t.kind != "ident" and not self.op("("):
            raise self.fault("stage")
        name = t.text.lower()
        if name in ("json", "logfmt") and not self.op("=", "!=", "=~", "!~", ">", ">=", "<", "<=", "==", n=1):
            self.i += 1
            flags = set()
            while name == "logfmt" and self.peek().kind == "flag":
                flags.add(self.next().text)
            return ast.Parse(name, self.fields(), strict="--strict" in flags, keep_empty="--keep-empty" in flags)
        if name in ("regexp", "pattern") and self.peek(1).kind == "string":
            self.i += 1
            return ast.Parse(name, text=self.next().text)
        if name in ("unpack", "decolorize") and not self.op("=", "!=", "=~", "!~", n=1):
            self.i += 1
            return ast.Parse("unpack") if name == "unpack" else ast.Decolorize()
        if name == "line_format":
            self.i += 1
            return ast.LineFormat(self.take_kind("string"))
        if name == "label_format":
            self.i += 1
            return ast.LabelFormat(tuple(self.separated(self.label_format)))
        if name in ("drop", "keep"):
            self.i += 1
            return ast.Project(name == "keep", tuple(self.separated(self.projected)))
        if name == "unwrap":
            if not in_range:
                raise QueryFault("unwrap outside a range aggregation")
            self.i += 1
            label = self.take_kind("ident", "label")
            if label.lower() in ("bytes", "duration", "duration_seconds") and self.op("("):
                self.i += 1
                inner = self.take_kind("ident", "label")
                self.take(")")
                return ast.Unwrap(inner, label.lower())
            return ast.Unwrap(label)
        at = t.at
        condition = self.either()
        return ast.Keep(condition, self.text[at : self.end()])

    def separated(self, parse):
        yield parse()
        while self.op(","):
            self.i += 1
            yield parse()

    def fields(self) -> tuple[tuple[str, str], ...]:
        out = []
        while self.peek().kind == "ident":
            label = self.next().text
            text = label
            if self.op("="):
                self.i += 1
                text = self.take_kind("string")
            out.append((label, text))
            if not self.op(","):
                break
            self.i += 1
        return tuple(out)

    def label_format(self):
        label = self.take_kind("ident", "label")
        self.take("=")
        if self.peek().kind not in ("string", "ident"):
            raise self.fault("value")
        t = self.next()
        return label, t.text, t.kind == "string"

    def projected(self):
        if self.peek().kind == "ident" and self.op("=", "!=", "=~", "!~", n=1):
            m = self.matcher()
            return m.label, m.op, m.value
        return self.take_kind("ident", "label"), "", ""

    # Conditions on labels: `and`, a comma and juxtaposition bind tighter than `or`.

    def either(self):
        left = self.both()
        while self.word("or"):
            self.i += 1
            left = ast.Either(left, self.both())
        return left

    def both(self):
        left = self.nested(self.compare)
        while True:
            if self.word("and") or self.op(","):
                self.i += 1
            elif not (self.op("(") or self.peek().kind == "ident" and self.op("=", "!=", "=~", "!~", ">", ">=", "<", "<=", "==", n=1)):
                return left
            left = ast.Both(left, self.nested(self.compare))

    def compare(self):
        if self.op("("):
            self.i += 1
            inner = self.either()
            self.take(")")
            return inner
        label = self.take_kind("ident", "label filter")
        if not self.op("=", "!=", "=~", "!~", ">", ">=", "<", "<=", "=="):
            raise self.fault("comparison")
        op = self.next().text
        sign = 1
        if self.op("-") and self.peek(1).kind in ("number", "duration"):
            self.i += 1
            sign = -1
        t = self.peek()
        if self.word("ip") and self.op("(", n=1):
            self.i += 2
            v = self.take_kind("string")
            self.take(")")
            return ast.Compare(label, op, "ip", v)
        if t.kind not in ("string", "number", "duration", "bytes", "variable"):
            raise self.fault("value")
        self.i += 1
        value: object = t.text
        if t.kind == "number":
            value = sign * float(t.text)
        elif t.kind == "duration":
            value = sign * duration_ns(t.text) / 1e9
        elif t.kind == "bytes":
            value = bytes_value(t.text)
        return ast.Compare(label, op, t.kind, value)


def _bounds(m: ast.Matcher) -> bool:
    """A matcher that the empty value doesn't pass, so that the selector can't take every stream."""
    if m.op == "=":
        return m.value != ""
    if m.op != "=~":
        return False
    try:
        return not automaton.matches(automaton.compile(rf"\A(?s:{m.value})\z"), "")
    except (sx.SyntaxFault, automaton.Undecided):
        return True


@lru_cache(maxsize=8192)
def _parsed(text: str) -> ast.Query | str:
    try:
        return _Parser(text).whole()
    except QueryFault as e:
        return str(e)
    except RecursionError:
        return "nested too deep"


def parse(text: str) -> ast.Query:
    found = _parsed(text)
    if isinstance(found, str):
        raise QueryFault(found)
    return found


def canonical(text: str) -> str:
    """The query in one writing: tokens one space apart, strings in double quotes, without comments, parentheses around the whole and `offset <duration>`.

    A text that has no tokens of the language is returned as it is.
    """
    try:
        t = tokens(text)
    except QueryFault:
        return text
    kept: list[Token] = []
    i = 0
    while i < len(t):
        if t[i].kind == "ident" and t[i].text.lower() == "offset":
            j = i + 1 + (i + 1 < len(t) and t[i + 1].text == "-" and t[i + 1].kind == "op")
            if j < len(t) and t[j].kind == "duration":
                i = j + 1
                continue
        kept.append(t[i])
        i += 1
    partner: dict[int, int] = {}
    stack: list[int] = []
    for k, x in enumerate(kept):
        if x.kind == "op" and x.text == "(":
            stack.append(k)
        elif x.kind == "op" and x.text == ")" and stack:
            partner[stack.pop()] = k
    lo, hi = 0, len(kept) - 1
    while lo < hi and partner.get(lo) == hi:
        lo, hi = lo + 1, hi - 1
    show = {"string": go_quote, "range": "[{}]".format}
    return " ".join(show.get(x.kind, str)(x.text) for x in kept[lo : hi + 1])
