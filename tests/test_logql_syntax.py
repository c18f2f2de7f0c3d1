"""Parser of LogQL: shapes that parse, texts that don't, canonical forms, bounds."""

import random
import time

import pytest

from brindle.logql import ast, syntax

# --- Queries made by the grammar, with the trees that they must give ---------------------------------------------------


def written(rng, text):
    """A string in one of the ways of writing it."""
    return rng.choice([syntax.go_quote(text), f"`{text}`"])


def gap(rng):
    return rng.choice(["", " ", "  ", "\n", " # a remark\n"])


def selector(rng):
    matchers = [ast.Matcher("app", "=", rng.choice(["kiln", "a b", "x-1"]))]
    matchers += [ast.Matcher(f"l{k}", rng.choice(["=", "!=", "=~", "!~"]), rng.choice(["v", "a|b", "x.*", ""])) for k in range(rng.randint(0, 3))]
    rng.shuffle(matchers)
    inner = ("," + gap(rng)).join(f"{m.label}{gap(rng)}{m.op}{gap(rng)}{written(rng, m.value)}" for m in matchers)
    return "{" + gap(rng) + inner + rng.choice(["", ","]) + "}", tuple(matchers)


FILTERS = {"|=": ("contains", False), "!=": ("contains", True), "|~": ("regex", False), "!~": ("regex", True), "|>": ("pattern", False), "!>": ("pattern", True)}


def line_filter(rng):
    op = rng.choice(list(FILTERS))
    kind, negated = FILTERS[op]
    texts = [rng.choice(["spark", "two words", "a.c", "<_> kept <_>"]) if kind == "pattern" else rng.choice(["spark", "two words", "a.c", "9+"]) for _ in range(rng.randint(1, 3))]
    texts = [t if kind != "pattern" else f"<_> {t} <_>".replace("<_> <_>", "<_>") for t in texts]
    return f"{op} " + " or ".join(written(rng, t) for t in texts), ast.LineFilter(negated, tuple((kind, t) for t in texts))


def stage(rng):
    return rng.choice(
        [
            ("| json", ast.Parse("json")),
            ('| json shade, depth="a.b[0]"', ast.Parse("json", (("shade", "shade"), ("depth", "a.b[0]")))),
            ("| logfmt", ast.Parse("logfmt")),
            ("| logfmt --keep-empty --strict", ast.Parse("logfmt", strict=True, keep_empty=True)),
            ("| unpack", ast.Parse("unpack")),
            ("| decolorize", ast.Decolorize()),
            ('| line_format "{{.shade}}"', ast.LineFormat("{{.shade}}")),
            ('| label_format near=far, tint="{{.shade}}"', ast.LabelFormat((("near", "far", False), ("tint", "{{.shade}}", True)))),
            ('| drop pod, tier="low"', ast.Project(False, (("pod", "", ""), ("tier", "=", "low")))),
            ("| keep pod", ast.Project(True, (("pod", "", ""),))),
        ]
    )


@pytest.mark.parametrize("seed", range(60))
def test_grammar(seed):
    rng = random.Random(seed)
    text, matchers = selector(rng)
    parts = []
    for _ in range(rng.randint(0, 4)):
        part = line_filter(rng) if rng.random() < 0.6 else stage(rng)
        # A word with != or !~ behind it reads as a label filter.
        if not (parts and not isinstance(parts[-1][1], ast.LineFilter) and part[0][:2] in ("!=", "!~")):
            parts.append(part)
    text += "".join(f" {gap(rng)}{t}" for t, _ in parts)
    stages = tuple(t for _, t in parts)
    root = syntax.parse(text).root
    assert (root.matchers, root.stages) == (matchers, stages), text
    window, offset = rng.choice(["5m", "1h30m", "2d"]), rng.choice(["", "10m", "-1h"])
    func = rng.choice(["count_over_time", "rate", "bytes_rate", "absent_over_time"])
    shift = f" offset {offset}" if offset else ""
    counted = syntax.parse(f"{func}({text} [{window}]{shift})")
    r = counted.root
    assert (r.func, r.range_text, r.offset_text, r.log.matchers, r.log.stages) == (func, window, offset, matchers, stages)
    assert [c for _, c in counted.logs] == [True] and r.plain == all(isinstance(s, ast.LineFilter) for s in stages)
    labels = rng.sample(["app", "pod", "tier"], rng.randint(0, 3))
    word = rng.choice(["by", "without"])
    before = rng.random() < 0.5
    summed = f"sum {word} ({', '.join(labels)}) ({func}({text} [{window}]))" if before else f"sum({func}({text} [{window}])) {word} ({', '.join(labels)})"
    v = syntax.parse(summed).root
    assert (v.func, v.grouping.without, v.grouping.labels, v.inner.log.stages) == ("sum", word == "without", tuple(labels), stages)
    assert syntax.canonical(summed) == syntax.canonical(f"(({summed}))")


@pytest.mark.parametrize("seed", range(60))
def test_broken_grammar(seed):
    """A query of the grammar with one thing wrong is refused."""
    rng = random.Random(1000 + seed)
    text, _ = selector(rng)
    text = " ".join(text.split("# a remark\n"))
    wrong = rng.choice(
        [
            text[:-1], text[1:], text + " |= spark", text + ' |= "spark', text + " | json [5m]", f"count_over_time({text})", f"count_over_time({text} [5m]", f"rate({text} [])", text + " | label_format", text + " | logfmt --loose",
            text + " | nosuchstage", text + ' |= "a" or', f"sum by (count_over_time({text} [5m]))", f"topk({text})", text + " | unwrap depth", f"count_over_time({text} [5m]) +", text + " !", text.replace('app', '"app"', 1), text + ' |~ "a" "b"',
            text + " | keep", f"rate({text} | unwrap [5m])", f"vector({text})",
        ]
    )
    with pytest.raises(syntax.QueryFault):
        syntax.parse(wrong)


@pytest.mark.parametrize("q", ['{tint!="blue"}', '{tint=~".*"}', '{tint=""}', '{tint!~"x", depth!="2"}', "", "{}", '{tint="x"} |= "\udcff"', '{tint="x"} |= "\\q"', "(" * 2000 + '{tint="x"}' + ")" * 2000])
def test_selectors_that_ask_for_nothing_and_bad_strings(q):
    with pytest.raises(syntax.QueryFault):
        syntax.parse(q)


def test_variables_stand_for_anything():
    q = syntax.parse('{$filters, app="kiln"} | $parser |= "$search"')
    assert q.root.matchers[0].op == "" and q.root.stages[0] == ast.VariableStage("$parser")


def test_structure():
    q = syntax.parse('{a="b"} | x="1" or y="2" and z="3"').root
    assert isinstance(q.stages[0].condition, ast.Either) and isinstance(q.stages[0].condition.right, ast.Both)
    b = syntax.parse("1 + 2 * 3 ^ 2 ^ 1").root
    assert b.op == "+" and b.right.op == "*" and b.right.right.op == "^" and b.right.right.right.op == "^"
    assert isinstance(syntax.parse("-2 ^ 2").root, ast.Negate)
    two = syntax.parse('sum(rate({app="kiln"} |= "hot" [2m])) - sum(rate({app="kiln"}[2m]))')
    assert [c for _, c in two.logs] == [True, True] and [len(x.log.stages) for x in two.ranges] == [1, 0]
    assert all(x.plain for x in two.ranges) and not syntax.parse('rate(({app="kiln"})[1m])').ranges[0].plain
    r = syntax.parse('sum_over_time({a="b"} | unwrap bytes(size) [1h30m] offset -5m)').ranges[0]
    assert (r.range_text, r.offset_text, r.log.stages[-1]) == ("1h30m", "-5m", ast.Unwrap("size", "bytes"))


@pytest.mark.parametrize("t,ns", [("5m", 300e9), ("1h30m", 5400e9), ("1.5s", 1.5e9), ("2d", 172_800e9), ("1w", 604_800e9), ("7µs", 7000), ("100ms", 1e8)])
def test_durations(t, ns):
    assert syntax.duration_ns(t) == ns
    assert [x.kind for x in syntax.tokens(t)] == ["duration"]


@pytest.mark.parametrize("t,n", [("10KB", 10_000), ("1.5MiB", 1.5 * 1024**2), ("20B", 20), ("2G", 2e9), ("3ki", 3072)])
def test_sizes(t, n):
    assert syntax.bytes_value(t) == n
    assert [x.kind for x in syntax.tokens(t)] == ["bytes"]


SAME = [
    ('sum(count_over_time({a="b"} |= "x" [5m])) > 100', '(sum(count_over_time({a="b"} |= "x"[5m])) > 100)'),
    ('sum(count_over_time({a="b"} |= "x" [1h]))', 'sum(count_over_time({a="b"} |= "x"[1h] offset 2h0m0s))'),
    ("{a=`b`} |~ `x.y`", '{a="b"} |~ "x.y"'),
    ('{a="b"}', '  { a = "b" }  # note'),
]
DIFFERENT = [('sum(count_over_time({a="b"}[5m]))', 'sum(count_over_time({a="b"}[1h]))'), ('{a="b"} |= "x"', '{a="b"} |= "X"'), ('{a="b"} |= "offset"', '{a="b"}')]


@pytest.mark.parametrize("a,b", SAME)
def test_same_canonical(a, b):
    assert syntax.canonical(a) == syntax.canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_canonical(a, b):
    assert syntax.canonical(a) != syntax.canonical(b)


def test_canonical_form():
    assert syntax.canonical('((({a="b"})))') == '{ a = "b" }'
    assert syntax.canonical('({a="b"}) or ({c="d"})') == '( { a = "b" } ) or ( { c = "d" } )'
    assert syntax.canonical("not a query \x00") == "not a query \x00"


def test_bounded():
    half = syntax.MAX_QUERY_BYTES // 2 - 16
    for q in ["(" * half + '{a="b"}' + ")" * half, "sum" + "(" * half, "-" * (2 * half) + "1", '{a="b"} | ' + "(" * half, '{a="b"} |= "x"' + ' or "x"' * (half // 4), 'rate({a="b"}[1m]) + ' * (half // 20) + "1"]:
        t = time.time()
        try:
            syntax.parse(q)
        except syntax.QueryFault:
            pass
        syntax.canonical(q)
        assert time.time() - t < 15
    with pytest.raises(syntax.QueryFault):
        syntax.parse('{a="b"}' + " " * syntax.MAX_QUERY_BYTES)


def test_quote_round_trip():
    for s in ["a", "`", 'say "x"', "\n\t\\", "é\x00", "\r"]:
        assert syntax.tokens(syntax.quote(s))[0].text == s
        assert syntax.tokens(syntax.go_quote(s))[0].text == s
