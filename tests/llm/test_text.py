"""Encoding, mixing and residue."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.llm import mix, residue, tokens

here = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")

# --- Encoding --------------------------------------------------------------------------------------------------------


@here
def test_encoder_equals_the_library():
    import tiktoken

    ranks = tokens.load_ranks()
    encoder = tokens.Encoder(ranks)
    library = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = "aaeeiou tnrshl  '\n\t.,!?0123456789äßñ日本語🙂​\xa0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    texts += ["<|endoftext|> it's I'LL we've", " " * 700 + "a", "a" * 20_000, "ab" * 3000, "日本語" * 500, "=" * 1000]
    for t in texts:
        assert encoder.encode(t) == library.encode_ordinary(t), t[:80]
    assert encoder.encode("") == encoder.encode(None) == []


@here
def test_short_and_long_merges_agree():
    ranks, rng = tokens.load_ranks(), random.Random(1)
    for n in (1, 2, 3, 10, 80, 97, 500):
        for _ in range(40):
            word = bytes(rng.choice(b"abcdeeeaaat in\xc3\xa4") for _ in range(n))
            assert tokens.merge_short(word, ranks) == tokens.merge_long(word, ranks)


@here
def test_encode_texts(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a" * 50_000, "x")], "doc_id long, text string, IDS string")
    got = [(r.doc_id, r.ids) for r in tokens.encode_texts(df).collect()]
    encoder = tokens.Encoder(tokens.load_ranks())
    assert Counter(map(repr, got)) == Counter(map(repr, [(r.doc_id, encoder.encode(r.text)) for r in df.collect()]))
    assert tokens.encode_texts(df.limit(0)).count() == 0


# --- Mixing ----------------------------------------------------------------------------------------------------------


@here
def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, "word " * rng.randint(1, 30), rng.choice(["a"] * 6 + ["b"] * 2 + ["c", None, "other"]), 1) for i in range(3000)]
    rows += [(9000, None, "b", 1), (9001, "", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    used, shares = mix.mix_sources(docs, targets)
    s = {r.source: r for r in shares.collect()}
    got = used.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("copy").alias("m"), F.first("n_tokens").alias("t")).collect()
    cap = {"a": 1, "b": 2, "c": 4}
    for r in got:
        assert r.n == r.m <= cap[r.source]
        assert r.n in (int(s[r.source].rate), int(s[r.source].rate) + 1)
    assert s["absent"].actual_share == 0 and s["absent"].n_docs == 0
    for name, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(s[name].actual_share - want) < 0.03
        assert s[name].mix_tokens == sum(r.n * r.t for r in got if r.source == name)
    assert max(s[x].rate / cap[x] for x in cap) == pytest.approx(1)  # as large as the caps let it be
    again, _ = mix.mix_sources(docs.repartition(7), targets)
    assert used.exceptAll(again).isEmpty() and again.exceptAll(used).isEmpty()
    smaller, less = mix.mix_sources(docs, targets, total_tokens=1000)
    assert less.agg(F.sum("mix_tokens")).first()[0] < 2000


@here
def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), (None, 0.5, 1), ("z", None, None)], "source string, target_share double, max_repeats int")
    used, shares = mix.mix_sources(docs, targets)
    assert used.count() == 0 and {(r.source, r.actual_share) for r in shares.collect()} == {("a", 0.0), ("z", 0.0)}
    one = spark.createDataFrame([(1, "x", "a"), (2, "y", None)], docs.schema)
    assert mix.mix_sources(one, targets.limit(0))[0].count() == 0


# --- Residue ---------------------------------------------------------------------------------------------------------

CASES = [
    "Dear {{shop}}, thank you for choosing kitchen!", "Hallo {0}, dein 4 ist unterwegs.", "%(item)s rocks.", "Thanks ${first_name}", "<%= brand %>", "@@city@@", "__ITEM__ is great",
    "Hallo &lt;city&gt;, dein &lt;shop&gt; ist da. {{ city }} {{ shop }}", "[insert headline here]", "[hier colour einsetzen]", "<CITY_HERE> rocks",
    "Lorem ipsum dolor sit", "It was fine.\nLOREM IPSUM dolor", "Your review text goes here.", "TODO: write something nice", "asdf jkl asdf jkl", "xxxxx xxxx xxx", "Texte à remplacer", "text text text text text",
    "502 Bad Gateway", "<h1>404 Not Found</h1><hr>edge/1.2", "Error 503: Service Unavailable. Please try again later.", "HTTP/1.1 504 Gateway Time-out\r\nConnection: close", '{"error":{"code":404,"message":"Not Found"}}',
    "Warning: Undefined index in /srv/shop/card.php on line 9", "java.lang.RuntimeException: load failed at com.shopfront.ReviewView.show(ReviewView.java:9)", "Page introuvable (erreur 404)",
    "Zugriff verweigert – Fehler 403", "Das Kabel ist gut. Seite nicht erreichbar (Code 404)", "upstream request timeout", "ページが見つかりません（404）", "Your session has expired.",
    "Please enable JavaScript to view this content.", "Cette page nécessite JavaScript et de cookies.", "Nice. Abilita JavaScript per continuare I like it", "We noticed that scripting is off in this browser.",
    "レビューを表示するにはJavaScriptを有効にしてください。", "<noscript>This widget needs scripts.</noscript>",
]
NO_CASES = [
    None, "", " \n", "Great course book on JavaScript; chapter 9 finally made closures click.", "I had to enable JavaScript on my old tablet to register the drill, then all was fine.",
    "The poster says lorem ipsum in huge letters, which my designer friend finds hilarious.", "This is no placeholder for a real drill, but fine for 2 small jobs.", "Le site affichait une erreur, mais le produit est parfait.",
    "The display went blank and said 'internal error 7', the seller replaced the pan.", "After 'session expired' I had to log in again to write this, but the pan is lovely.", "Smells like roses {just kidding}, but it works.",
    "Paid $9 {tax included} at the market.", "Model [XL-9] fits, model [S] does not.", "[Update after 9 weeks] still going strong.", "The #9 kettle in our house, hands down.", "Name tag on the box read HELLO MY NAME IS ____, cute idea.",
    "Bought it at 40% off, 100% worth it.", "Love it <3 and so does my father :-}", "Die Seite meldete Fehler 9 beim Bezahlen, das Produkt selbst ist super.", "The cookies need ten minutes in this oven.", "A<br/>B &amp; C",
    "Sample size sachets were missing from my box.", "w " * 200_000,
]


@pytest.mark.parametrize("text", CASES)
def test_case(text):
    assert any(s == residue.CERTAIN for s, _, _ in residue.signals(text))


@pytest.mark.parametrize("text", NO_CASES)
def test_no_case(text):
    assert not any(s == residue.CERTAIN for s, _, _ in residue.signals(text))


def test_weak_slots_need_other_records(spark):
    rows = [(1, "I like [COLOUR] so much"), (2, "Take {colour}."), (3, "I like [BRAND] so much"), (4, "Model [S] fits"), (5, "Nothing"), (6, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, KEY string")
    assert residue.find_residue(df).count() == 0
    # Another record shows that `colour` is a variable, and one more that the sentence is a template.
    more = df.union(spark.createDataFrame([(7, "{{ colour }}", "x"), (8, "I like {{x}} so much", "x")], df.schema))
    assert {r.id for r in residue.find_residue(more).collect()} == {1, 2, 3, 7, 8}


def test_recurring_pages(spark):
    rows = [(i, "Untitled 12 - reload") for i in range(3)] + [(10, "Good. Not null at all. Fine."), (11, "not null at all."), (12, "Only once undefined"), (None, "Lorem ipsum dolor"), (None, "fine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id for r in residue.find_residue(df).collect()} == {0, 1, 2, None}
    kept = residue.without_residue(df)
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == sorted(t for i, t in rows if i not in (0, 1, 2))
    assert residue.find_residue(df.limit(0)).count() == residue.without_residue(df.limit(0)).count() == 0


def test_slots_are_induced_from_records_of_a_template(spark):
    filled = [(i, f"Gracias {a}, el {b} llegó a Lima.") for i, (a, b) in enumerate([("Ana", "taladro"), ("Luis", "garden hose"), ("Eva", "horno"), ("Sol", "horno")])]
    left = [(10, "Gracias [cliente], el horno llegó a Lima."), (11, "Gracias Ana, el  llegó a Lima."), (12, "Gracias null, el taladro llegó a Lima."), (13, "Gracias {cliente}, el [articulo] llegó a Lima.")]
    # Brackets that stand in every record are the sentence's own; an odd space is no gap where the sentence is whole.
    own = [(20 + i, f"Model [{x}] fits, model [{y}] does not.") for i, (x, y) in enumerate([("XL", "SM"), ("LL", "MM"), ("XS", "SM"), ("MM", "LL")])]
    odd = [(30, "The old  lamp is fine here."), (31, "The old lamp is fine here."), *((40 + i, f"The old {x} lamp is fine here.") for i, x in enumerate(["red", "blue", "big"]))]
    df = spark.createDataFrame([*filled, *left, *own, *odd], "doc_id long, text string")
    assert {r.id for r in residue.find_residue(df).collect()} == {10, 11, 12, 13}


def test_one_record_is_no_evidence(spark):
    df = spark.createDataFrame([(1, "{{ size }} it is"), (2, "Take [size] of these"), (3, "Model [S] fits, model [M] does not.")], "doc_id long, text string")
    assert {r.id for r in residue.find_residue(df).collect()} == {1}


RUN_IN = [
    "Session expired Der Griff ist gut", "This page is not available Das Kabel ist kurz", '{"error":"timeout"} Great blender for us', "Forbidden Das Kabel ist gut", "Not Found Der Griff ist gut", "Error 404 The lid is fine",
    "Warning: " + "x" * 230 + " on line 93 As a coll", "Error in module: " + "reader " * 40 + "needs JavaScript enabled Das Kabel ist gut und mein Bruder mag es", "404 Not Found I like my lid",
]


@pytest.mark.parametrize("text", RUN_IN)
def test_messages_that_run_into_a_review(text):
    assert any(s == residue.CERTAIN for s, _, _ in residue.signals(text))


@pytest.mark.parametrize("text", ["Forbidden City puzzle with 500 pieces, lovely.", "Error 404 Socks are warm.", "Forbidden by my wife, Das Kabel ist gut.", "My browser needs JavaScript Der Griff ist gut", "I " * 50_000, "W " * 100_000])
def test_names_are_no_messages(text):
    assert not any(s == residue.CERTAIN for s, _, _ in residue.signals(text))


def test_templates_recur_among_other_languages(spark):
    """Found without any word that the seeds know, by where the units stand."""
    page = "Zub kelavo trimas dorvel {}."
    said = {"en": ["The lid fits well.", "Works as it should.", "My father likes it."], "de": ["Der Deckel passt gut.", "Tut was er soll.", "Mein Vater mag ihn."], "fr": ["Le couvercle va bien.", "Fait le travail.", "Mon père l’aime."]}
    rows = []
    for k in range(3):
        rows.append((f"p{k}", page.format(k), None))
    for lang, sentences in said.items():
        for k in range(4):
            rows.append((f"r{lang}{k}", " ".join([*sentences[: k % 3 + 1], page.format(k)]), lang))
            rows.append((f"n{lang}{k}", " ".join(sentences[k % 3 :] + sentences[:1]), lang if k else lang.upper() + "-x"))
        rows += [(f"t{lang}{k}", sentences[0], lang) for k in range(4)]  # a sentence that is a whole review at times
    rows += [(f"h{k}", "A keeper", lang) for k, lang in enumerate(("en", "de", "fr", None))]  # a review that stands alone only
    rows += [("a1", "Zub kelavo " + "x " * 100_000 + "end.", "en"), ("e1", "", "en"), ("e2", None, None)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "doc_id long, name string, text string, lang string")
    names = {r.doc_id: r.name for r in df.collect()}
    found = residue.find_residue(df, language_col="lang").collect()
    assert {names[r.id] for r in found} == {"p0", "p1", "p2", "a1", *(f"r{x}{k}" for x in said for k in range(4))} and all(r.kinds == ["template"] for r in found)
    assert residue.find_residue(df).count() == 0
    assert residue.without_residue(df, language_col="lang").count() == len(rows) - len(found)


def test_whole_pages_recur(spark):
    marked = "<html><h1>Maintenance window {}</h1><hr>edge/3.9</html>"
    lines = "Upstream could not answer, reload later.\nNode {} of the pool\n" + "The pool drains its queue before it takes new work. " * 6
    rows = [(i, marked.format(i)) for i in range(3)] + [(10 + i, lines.format(i)) for i in range(3)]
    # A page stands within reviews more often than alone; a review that was copied is no page.
    rows += [(20 + i, "Untitled 12 - reload") for i in range(3)] + [(30 + i, f"Fine lid {'x' * i}.\nUntitled 7 - reload") for i in range(5)] + [(40 + i, "Fine lid.\nFits well, and looks good.") for i in range(4)]
    rows += [(50 + i, "Blank view - reload") for i in range(3)] + [(60, "Fine lid.\nBlank view - reload")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id for r in residue.find_residue(df).collect()} == {0, 1, 2, 10, 11, 12, 20, 21, 22, 50, 51, 52, 60}
