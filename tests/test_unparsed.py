"""Rows that fail to parse, against a reader that walks the line character by character."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import unparsed

GOOD = 'level=info ts=2026-01-05T00:01:52.813Z caller=metrics.go:162 component=ruler org_id="shared pool" query="{a=\\"b\\"}" query_type=filter duration=1h2.5ms status=200 splits=3'


def walk(line):
    """Cells of a line or None where its form breaks: an own reading of the grammar."""
    cells, i, n = [], 0, len(line)
    while i < n:
        if line[i] == " ":
            i += 1
            continue
        key = ""
        while i < n and line[i] not in ' ="':
            key += line[i]
            i += 1
        if not key or (i < n and line[i] == '"'):
            return None
        value = ""
        if i < n and line[i] == "=":
            i += 1
            if i < n and line[i] == '"':
                i += 1
                while True:
                    if i >= n or line[i] == "\n":
                        return None
                    if line[i] == '"':
                        i += 1
                        break
                    if line[i] == "\\":
                        e = line[i + 1 : i + 2]
                        width = {"x": 2, "u": 4, "U": 8}.get(e)
                        if width:
                            digits = line[i + 2 : i + 2 + width]
                            if len(digits) < width or any(c not in "0123456789abcdefABCDEF" for c in digits):
                                return None
                            if e != "x" and (0xD800 <= int(digits, 16) < 0xE000 or int(digits, 16) > 0x10FFFF):
                                return None
                            i += 2 + width
                            value += "?"
                            continue
                        if e and e in "01234567":
                            digits = line[i + 1 : i + 4]
                            if len(digits) < 3 or any(c not in "01234567" for c in digits) or int(digits, 8) > 255:
                                return None
                            i += 4
                            value += "?"
                            continue
                        if not e or e not in 'abfnrtv\\"':
                            return None
                        value += e
                        i += 2
                        continue
                    value += line[i]
                    i += 1
                if i < n and line[i] != " ":
                    return None
            else:
                while i < n and line[i] != " ":
                    value += line[i]
                    i += 1
        cells.append((key, value))
    return cells


def test_cells_against_walk():
    rng = random.Random(5)
    pieces = ["a", "=", '"', "\\", " ", "b=", 'c="x y"', "\\n", '\\"', "\\x4f", "\\u00e9", "\\ud800", "\\U0010ffff", "\\U00110000", "\\101", "\\400", "\n", "\t", "é", "\\'", "z=1"]
    broken = 0
    for _ in range(20_000):
        line = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        keys, vals, at = unparsed.logfmt_cells(line)
        want = walk(line)
        broken += want is None
        assert (at >= 0) == (want is None), line
        if want is not None:
            assert keys == [k for k, _ in want], line
            assert [len(v) == 0 for v in vals] == [len(v) == 0 for _, v in want], line
    assert 1000 < broken < 19_000  # both kinds occur


CASES = [
    (GOOD, None),
    (None, "blank"),
    ("", "blank"),
    (" \t ", "blank"),
    (GOOD.replace("level=info ", ""), "count"),
    (GOOD + " level=info", "count"),
    (GOOD.replace("level=info", "level="), "count"),
    (GOOD.replace("level=info", "level"), "count"),
    (GOOD.replace("level=info", "level=INFO"), "value"),
    (GOOD.replace("component=ruler ", ""), "count"),
    (GOOD.replace("caller=metrics.go:162", "caller=http.go:1").replace("component=ruler ", "").replace("status=200", "status=ok"), None),
    (GOOD.replace("2026-01-05", "2026-02-29"), "value"),
    (GOOD.replace("2026-01-05", "2024-02-29"), None),
    (GOOD.replace("2026-01-05T", "2026-01-05t"), "value"),
    (GOOD.replace("52.813Z", "52.813+01:30"), None),
    (GOOD.replace("52.813Z", "60Z"), "value"),
    (GOOD.replace("52.813Z", "52"), "value"),
    (GOOD.replace("duration=1h2.5ms", "duration=-1h"), "value"),
    (GOOD.replace("duration=1h2.5ms", "duration=1h 2ms"), None),  # 2ms is a key alone
    (GOOD.replace("duration=1h2.5ms", "duration=7µs"), None),
    (GOOD.replace("duration=1h2.5ms", "duration=7"), "value"),
    (GOOD.replace("status=200", "status=600"), "value"),
    (GOOD.replace("status=200", "status=099"), "value"),
    (GOOD.replace("splits=3", "splits=-3"), "value"),
    (GOOD.replace("splits=3", "cached source= x y=1 y=2"), None),
    (GOOD.replace('org_id="shared pool"', 'org_id="shared\\q pool"'), "form"),
    (GOOD.replace('org_id="shared pool"', 'org_id="shared pool"x'), "form"),
    (GOOD + " =x", "form"),
    (GOOD + ' x="', "form"),
    (GOOD + " msg=" + "y" * 300_000, None),
    (GOOD + ' msg="' + '\\"' * 100_000 + '"', None),
    (GOOD + ' x="\\U0000D800"', "form"),
    (GOOD + ' x="\\U0001234"', "form"),
    (GOOD + ' x="\\U00110000"', "form"),
    (GOOD + ' x="\\U0010FFFF \\U00012345 \\U00001234"', None),
    (GOOD.replace("splits=3", "splits"), "value"),
    (GOOD.replace("splits=3", "splits="), "value"),
    (GOOD + " total_bytes", "value"),
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, line, f"extra{i}", i) for i, (line, _) in enumerate(CASES)]
    rows += [(500, GOOD, "twice", 1), (500, GOOD, "twice", 2), (501, "x", "again", 1), (501, "x", "again", 1), (502, GOOD, "a", 1), (502, "=", "b", 1), (None, "=", "c", 1), (None, GOOD, "d", 1)]
    return spark.createDataFrame(rows, "line_id long, line string, row_id string, LINE_ID long")


def test_cases(lines):
    found = {}
    for r in unparsed.find_errors(lines, "line_id", "line").collect():
        found.setdefault(r.row_id, set()).update(x.reason for x in r.reasons)
    for i, (line, reason) in enumerate(CASES):
        assert found.get(i) == ({reason} if reason else None), (line and line[:200], found.get(i))
    assert 500 not in found
    assert found[501] == {"count"}
    assert found[502] == {"form"}
    assert found[None] == {"form"}
    plain = unparsed.find_errors(lines, "line_id", "line", details=False)
    assert {(r.row_id, tuple((x.reason, x.column) for x in r.reasons)) for r in plain.collect()} == {
        (r.row_id, tuple((x.reason, x.column) for x in r.reasons)) for r in unparsed.find_errors(lines, "line_id", "line").collect()
    }


def test_split_keeps_all_rows(lines):
    loaded, rejected = unparsed.split_unparsed(lines)
    assert loaded.columns == lines.columns
    good = sum(r is None for _, r in CASES) + 2 + 1 + 1
    assert loaded.count() == good
    copies = unparsed.find_errors(lines, "line_id", "line").agg(F.sum("copies")).first()[0]
    assert good + copies == lines.count()
    assert set(rejected.columns) == {"row_id", "reason", "column", "detail"}


def test_empty_table(lines):
    loaded, rejected = unparsed.split_unparsed(lines.limit(0))
    assert loaded.count() == rejected.count() == 0
