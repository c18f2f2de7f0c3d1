"""Expressions: our automaton, RE2 (by DuckDB) and java.util.regex (by Spark, through the printer) must agree."""

import random

import duckdb
import pytest

from brindle.relang import automaton as at
from brindle.relang import syntax as sx

#: Code points on which engines are known to differ.
TRAPS = "ab AZ0_\n\r\t\x0b\x85 éÉſKßİ-.[&"


def expressions(n, seed):
    rng = random.Random(seed)
    atoms = ["a", "b", "K", "s", ".", "\\d", "\\w", "\\W", "\\s", "\\S", "[a-c]", "[^a]", "[[:upper:]]", "[^[:space:]]", "[a&&b]", "[a[]", "\\b", "\\B", "^", "$", "\\A", "\\z", "\\x{e9}", "é", "\\.", "\\pL", "\\PL", "-", "ab"]

    def one(depth):
        r = rng.random()
        if depth == 0 or r < 0.35:
            return rng.choice(atoms)
        if r < 0.6:
            return one(depth - 1) + one(depth - 1)
        if r < 0.75:
            return f"(?:{one(depth - 1)}|{one(depth - 1)})"
        if r < 0.9:
            return f"({one(depth - 1)}){rng.choice(['*', '+', '?', '{2}', '{1,2}', '*?', '{0,1}'])}"
        return f"(?{rng.choice(['i', 's', 'm', 'im', 'is'])}:{one(depth - 1)})"

    return [one(3) for _ in range(n)]


def sample(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(TRAPS) for _ in range(rng.randint(0, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def agreed():
    """Expressions, texts and RE2's answers."""
    con = duckdb.connect()
    texts = ["", *sample(150, 2)]
    con.execute("CREATE TABLE t (i INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    out = []
    for e in expressions(400, 1):
        try:
            hits = {r[0] for r in con.execute("SELECT i FROM t WHERE regexp_matches(s, ?)", [e]).fetchall()}
        except duckdb.Error:
            with pytest.raises(sx.SyntaxFault):
                sx.parse(e)
            continue
        out.append((e, hits))
    return texts, out


def test_automaton_agrees_with_re2(agreed):
    texts, cases = agreed
    for e, hits in cases:
        p = at.compile(e)
        assert {i for i, s in enumerate(texts) if at.matches(p, s)} == hits, e
    assert len(cases) > 300 and sum(0 < len(h) < len(texts) for _, h in cases) > 200


def test_java_form_agrees_with_re2(agreed, spark):
    from pyspark.sql import functions as F

    texts, cases = agreed
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(1).cache()
    for k in range(0, len(cases), 40):
        part = cases[k : k + 40]
        rows = df.select("i", *[F.col("s").rlike(sx.java(e)).alias(f"c{j}") for j, (e, _) in enumerate(part)]).collect()
        for j, (e, hits) in enumerate(part):
            assert {r.i for r in rows if r[f"c{j}"]} == hits, (e, sx.java(e))


def test_anchored_form(spark):
    assert sx.java("a|b", anchored=True) == r"\A(?:[a-b])\z"
    assert "\n" not in sx.java("a.b\n", anchored=True)


REJECTED = ["(", ")", "[a", "a**", "*a", "a{1001}", "a{2,1}", "(?P<n>a)(?P<n>b)", "\\8", "\\Z", "[b-a]", "\\p{Nope}", "(?<!a)", "(?=a)", "a\\", "(a{100}){100}", "[[:nope:]]"]


@pytest.mark.parametrize("e", REJECTED)
def test_rejected(e):
    with pytest.raises(sx.SyntaxFault):
        sx.parse(e)


def test_witness_against_brute_force():
    rng = random.Random(6)
    texts = [""] + [a + b + c for a in "ab\n " for b in ["", *"ab\n "] for c in ["", *"ab\n "]]
    pool = [e for e in expressions(600, 9) if all(c not in e for c in "pPKsé&Z0_")]
    decided = found_none = 0
    for _ in range(400):
        terms = []
        for e in rng.sample(pool, rng.randint(1, 3)):
            try:
                terms.append(at.Term(at.compile(e), rng.random() < 0.4))
            except sx.SyntaxFault:
                continue
        if not terms:
            continue
        ok = lambda s: all(at.matches(t.pattern, s) != t.negated for t in terms)  # noqa: B023, E731
        try:
            w = at.witness(terms, 20_000)
        except at.Undecided:
            continue
        decided += 1
        if w is None:
            found_none += 1
            assert not any(map(ok, texts)), [(t.pattern.text, t.negated) for t in terms]
        else:
            assert ok(w), (w, [(t.pattern.text, t.negated) for t in terms])
            shorter = [s for s in texts if len(s) < len(w)]
            assert not any(map(ok, shorter))
    assert decided > 300 and found_none > 30


def test_subset_overlap_and_glob():
    assert at.subset(at.compile(r"\A[0-9]{3}\z"), at.compile(r"\A\d+\z"))
    assert not at.subset(at.compile(r"\A\d+\z"), at.compile(r"\A[0-9]{3}\z"))
    assert at.overlap(at.glob("logs-*"), at.glob("*-2024"))
    assert not at.overlap(at.glob("logs-*"), at.glob("metrics-*"))
    assert at.intersects(at.literal("a.b"), at.compile(r"\Aa.b\z")) == "a.b"


def test_an_unbounded_question_is_undecided():
    with pytest.raises(at.Undecided):
        at.witness([at.Term(at.compile("(?:a|b)*a(?:a|b){18}c")), at.Term(at.compile("(?:a|b)*b(?:a|b){17}d"))], 500)
    assert at.overlap(at.compile(r"\Aa\z"), at.compile(r"\Aa\z"))


def test_a_question_takes_few_states():
    errors = at.compile(r"(?i)(?:\b|_)(?:err|error|fail|failed|timed out)(?:\b|_)")
    text = "value of user <*> " * 100
    assert at.witness([at.Term(at.compile(rf"\A{sx.quote(text)}\z")), at.Term(errors)], 100) is None
    assert at.witness([at.Term(at.compile(rf"\A{sx.quote(text)}failed\z")), at.Term(errors)], 100) == f"{text}failed"
    assert at.witness([at.Term(errors), at.Term(at.compile(rf"\A{sx.quote(text)}\z"), True)], 10_000) is not None
    line = at.compile(r"\AINFO user [0-9]{1,4} did view took [0-9]{1,3}ms\z")
    assert at.witness([at.Term(line), at.Term(errors)], 100) is None
    assert at.witness([at.Term(line), at.Term(at.literal("user 1234 did "))], 200) == "INFO user 1234 did view took 0ms"
    assert at.witness([at.Term(line), at.Term(at.literal("user 12345 did "))], 200) is None


@pytest.mark.parametrize("text", ["", "a", "an_error", "a.b*[c]", "\n", "é ſ", " ERROR<*>"])
def test_pattern_of_one_text(text):
    p = at.exactly(text)
    assert p == at.compile(rf"\A{sx.quote(text)}\z") and at.matches(p, text) and not at.matches(p, f"{text}x")
    assert at.intersects(p, at.compile("(?i)error")) == (text if "error" in text.lower() else None)
    assert at.subset(p, at.literal(text)) and not at.subset(p, at.literal(f"{text}x")) and at.intersects(p, at.exactly(f"{text}x")) is None


def test_long_text_needs_no_stack():
    p = at.compile("(?:ab|a)*c")
    assert sx.backtracks_deeply(p.tree) and not sx.backtracks_deeply(at.compile("(?:a|b)*c").tree)
    assert not at.matches(p, "a" * 100_000)


def test_case_folding():
    p = at.compile("(?i)k")
    assert all(at.matches(p, c) for c in "kKK") and not at.matches(at.compile("(?i)i"), "İ")
    assert sx.group_names(sx.parse("(?P<a>x)(y)(?:z(?<b>w))")) == ["a", None, "b"]


def test_other_dialects():
    assert sx.rust(r"^a b$\b") == r"\Aa\x{20}b\z(?-u:\b)" and sx.onigmo(r"(?m)^a$") == "^a$" and sx.rust(r"(?m)^a$") == "(?m:^)a(?m:$)"
    assert sx.rust("(?i)k") == sx.onigmo("(?i)k") == r"[Kk\x{212a}]"
    assert sx.rust("a{2,3}?(b|c*)") == "a{2,3}?(b|c*)" and sx.onigmo(r"[^\x00-\x{10FFFF}]") == "(?!)"
