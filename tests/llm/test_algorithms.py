"""Copies in other writing, frequent items, runs and like texts, against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import alike, formats, heavy, runs

# --- Copies in other writing -----------------------------------------------------------------------------------------

SAME = [
    ('sum by (a, b) (rate({x="1", y=~"2"} |= "p q" [5m]))', "SUM BY(b,a)(RATE({ y =~ `2` , x=`1`, }|=`PQ`[5m] )) ;"),
    ('{a="x"} | json', "{ A=`X`,}|\tJSON\r\n"),
    ('sum without (b) (x)', "sum WITHOUT\n(b)(x)"),
    ("", " \t;"),
    ('{a="b,c", d="e"}', '{d="e", a="b,c"}'),
    ('{a="b" , c="d"}', '{c="d" a="b"}'),
    ('{a="x}y", b="z"}', '{b="z", a="x}y"}'),
]
DIFFERENT = [
    ('{a="x"}', '{a!="x"}'),
    ('{a="x"} |= "p" |= "q"', '{a="x"} |= "q" |= "p"'),
    ("sum by (a) (x)", "sum without (a) (x)"),
    ("x > 1", "x > 10"),
    ("x > 1", "x >= 1"),
    ('{a="1", b="2"}', '{a="2", b="1"}'),
    ("f(a, b)", "f(b, a)"),
    ('{a="x"} or {b="y"}', '{b="y"} or {a="x"}'),
    ('{a="b", c="d"}', '{a="b"} {c="d"}'),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same_query(a, b):
    assert sorted(formats.query_fields(a)) == sorted(formats.query_fields(b))


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_query(a, b):
    assert sorted(formats.query_fields(a)) != sorted(formats.query_fields(b))


def queries(spark):
    texts = [t for pair in SAME for t in pair] + [t for pair in DIFFERENT for t in pair] + [None, None, "x" * 200_000, "X" * 200_000, "sum(x)", "sum(x)"]
    rows = [(i, t, None if i % 3 else i, "c", i) for i, t in enumerate(texts)] + [(0, texts[0], 5, "c", 9)]
    return spark.createDataFrame(rows, "query_id long, query_text string, exec_count long, code string, ID long")


def test_collapse_formats(spark):
    df = queries(spark)
    groups = defaultdict(list)
    for r in df.collect():
        if r.query_text is not None:
            groups[tuple(sorted(formats.query_fields(r.query_text)))].append(r)
    got = sorted((r.first_id, r.copies, r.total) for r in formats.collapse_formats(df).collect())
    total = lambda rs: sum(x) if (x := [r.exec_count for r in rs if r.exec_count is not None]) else None
    assert got == sorted(((min(r.query_id for r in rs), len(rs), total(rs)) for rs in groups.values()))
    pairs = {(r.first_id, r.id) for r in formats.format_copies(df).collect()}
    assert pairs == {(min(r.query_id for r in rs), r.query_id) for rs in groups.values() for r in rs if r.query_id > min(x.query_id for x in rs)}
    assert formats.collapse_formats(df.limit(0)).count() == formats.format_copies(df.limit(0)).count() == 0


# --- Frequent items --------------------------------------------------------------------------------------------------


def test_code_corrects():
    rng = np.random.default_rng(1)
    words = heavy.encode(rng.integers(0, 16, (300, heavy.DATA)).astype(np.uint8))
    # Different data words differ in more symbols than there are of parity.
    differ = (words[:, None, :] != words[None, :, :]).sum(axis=2)
    same = (words[:, None, : heavy.DATA] == words[None, :, : heavy.DATA]).all(axis=2)
    assert differ[~same].min() > heavy.PARITY


@pytest.mark.parametrize("groups,items", [(64, 30), (1, 8), (2, 40)])
def test_decode_finds_all_or_says_crowded(groups, items):
    rng = np.random.default_rng(groups)
    prints = rng.integers(-(2**63), 2**63 - 1, items)
    at = prints % groups
    lists = defaultdict(lambda: [[] for _ in range(heavy.POSITIONS)])
    for g, word in zip(at, heavy.symbols(prints), strict=True):
        for p, x in enumerate(word):
            if int(x) not in lists[int(g)][p]:
                lists[int(g)][p].append(int(x))
    found, crowded = heavy.decode(dict(lists))
    for f, g in zip(prints, at, strict=True):
        assert int(f) in found or int(g) in crowded


def test_frequent_items_exactly(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["", None, "y" * 100_000]
    rows = [(rng.choice(words) if rng.random() < 0.6 else f"u{rng.random()}", rng.choice([None, {"p": "a"}, {"p": "b"}, {"p": f"c{rng.random()}"}]), "k") for _ in range(6000)]
    df = spark.createDataFrame(rows, "line string, labels map<string,string>, kind string")
    got = {(r.kind, r.item_text, r.n_rows) for r in heavy.frequent_items(df, {"l": F.col("line"), "p": F.col("labels")["p"]}, 0.01).collect()}
    lines, pods = Counter(r[0] for r in rows), Counter((r[1] or {}).get("p") for r in rows)
    want = {("l", t, n) for t, n in lines.items() if t and n >= 60} | {("p", t, n) for t, n in pods.items() if t and n >= 60}
    assert got == want and len(want) > 30


def test_frequent_items_at_the_edge(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)] * 91, "line string")
    assert [(r.item_text, r.n_rows, r.all_rows) for r in heavy.frequent_items(df, {"x": F.col("line")}, 0.05).collect()] == [("a", 5, 100)]
    assert heavy.frequent_items(df.limit(0), {"x": F.col("line")}, 0.05).count() == 0


@pytest.mark.parametrize("share,memory_mb", [(4e-7, 1), (1.5e-3, 1), (0.0015, 64), (0.01, 1)])
def test_small_shares_in_little_memory(spark, share, memory_mb):
    rng = random.Random(7)
    rows = [(f"w{int(rng.paretovariate(0.5)) % 5000}",) for _ in range(4000)]
    df = spark.createDataFrame(rows, "line string").repartition(3)
    got = {(r.item_text, r.n_rows) for r in heavy.frequent_items(df, {"x": F.col("line")}, share, memory_mb).collect()}
    assert got == {(t, n) for t, n in Counter(t for (t,) in rows).items() if n >= share * 4000}


# --- Runs ------------------------------------------------------------------------------------------------------------


def brute_runs(rows, least=4, gap=300):
    streams = defaultdict(list)
    for i, labels, ns, line in rows:
        streams[tuple(sorted((labels or {}).items()))].append((ns, i, line))
    event = lambda line: None if line is None else ["#" if re.search("[0-9]", w) else w for w in line.split()]
    out = set()
    for s in streams.values():
        s.sort(key=lambda r: r[:2])
        run = []
        for ns, i, line in [*s, (None, None, None)]:
            e = event(line)
            if run and (e is None or e != run[-1][2] or ns - run[-1][0] > gap * 10**9):
                if len(run) >= least:
                    out.add((run[0][1], run[-1][1], len(run), run[-1][0] - run[0][0]))
                run = []
            if e is not None:
                run.append((ns, i, e))
    return out


LOG = "entry_id long, labels map<string,string>, ts_ns long, line string, event string, STREAM int"


@pytest.mark.parametrize("seed,pieces", [(1, 4), (2, 1), (3, 40)])
def test_runs_against_brute_force(spark, seed, pieces):
    rng = random.Random(seed)
    lines = ["a 1", "a 22", "a x3", "b", "b  ", "", " ", None, "a b", "a 1 b"]
    labels = [None, {}, {"p": "1", "q": "2"}, {"q": "2", "p": "1"}, {"p": "1"}]
    rows, line, t = [], "b", 0
    for i in range(1500):
        if rng.random() < 0.3:
            line = rng.choice(lines)
        t += rng.choice([0, 0, 1, 10**9, 10**9, 299 * 10**9, 300 * 10**9, 301 * 10**9 if rng.random() < 0.2 else 0])
        rows.append((i, labels[2 + i % 2] if rng.random() < 0.8 else rng.choice(labels), t, line))
    rows += [(5000 + i, {"long": "run"}, t + i, "same 1") for i in range(3000)]  # over many pieces and batches
    rng.shuffle(rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = spark.createDataFrame([(*r, "e", 1) for r in rows], LOG)
        got = {(r.first_id, r.last_id, r.n, r.duration_ns) for r in runs.collapse_runs(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute_runs(rows)
    assert got == want and len(want) > 20


def test_runs_edges(spark):
    df = spark.createDataFrame([(*r, "e", 1) for r in [(1, None, None, "a"), (None, None, 1, "a")]], LOG)
    assert runs.collapse_runs(df).count() == runs.collapse_runs(df.limit(0)).count() == 0
    big = "w " * 100_000
    rows = [(i, {}, i, big + str(i)) for i in range(4)]
    got = runs.collapse_runs(spark.createDataFrame([(*r, "e", 1) for r in rows], LOG)).collect()
    assert [(r.first_id, r.last_id, r.n) for r in got] == [(0, 3, 4)]


# --- Like texts ------------------------------------------------------------------------------------------------------


def brute_pairs(rows, least=1):
    sets = {i: set(re.findall("[a-z0-9]+", t.lower())) for i, t in rows if i is not None and t}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}


def texts(rng, n, words):
    bank = [f"w{i}" for i in range(120)] + ["the", "of", "and"] * 20
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = list(rng.choice(out)[1].split())
            for _ in range(rng.randint(0, max(1, len(w) // 4))):
                w[rng.randrange(len(w))] = rng.choice(bank)
            if rng.random() < 0.3:
                rng.shuffle(w)
        else:
            w = [rng.choice(bank) for _ in range(rng.randint(1, words))]
        out.append((i, " ".join(w)))
    return [(i, t.upper() if i % 7 == 0 else t) for i, t in out]


@pytest.mark.parametrize("seed,words,block", [(1, 12, 40_000), (2, 90, 40_000), (3, 12, 25)])
def test_pairs_against_brute_force(spark, monkeypatch, seed, words, block):
    monkeypatch.setattr(alike, "BLOCK_ROWS", block)
    rows = texts(random.Random(seed), 300, words) + [(900, None), (901, ""), (902, " .,;"), (903, "é"), (None, "w1 w2"), (905, "z" * 100_000), (906, "z" * 100_000 + "!")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(5, rows[5][1], 2, "y")], "doc long, body string, id int, words string")
    got = [tuple(r) for r in alike.like_pairs(df, "doc", "body").select("id_a", "id_b").collect()]
    want = brute_pairs(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_groups_are_the_components(spark):
    rows = texts(random.Random(9), 250, 14)
    df = spark.createDataFrame(rows, "doc long, body string")
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(rows):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r for r in alike.like_groups(df, "doc", "body").collect()}
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in root}
    same = defaultdict(list)
    for i, t in rows:
        same[frozenset(re.findall("[a-z0-9]+", t.lower()))].append(i)
    assert {i: (r.class_id, r.n_copies) for i, r in got.items()} == {i: (min(g), len(g)) for g in same.values() for i in g}


def test_like_texts_of_nothing(spark):
    df = spark.createDataFrame([], "doc long, body string")
    assert alike.like_pairs(df, "doc", "body").count() == alike.like_groups(df, "doc", "body").count() == 0
