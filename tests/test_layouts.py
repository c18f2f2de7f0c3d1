"""Headers of log lines and their assembly into records."""

import calendar
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import layouts


def ms(*a):
    return int(calendar.timegm(datetime(*a).timetuple()) * 1000)


CASES = [
    ("2026-01-05 00:00:03,087 INFO  [pool-2-thread-10] net.harborline.QuotaTask - courier - at stop", ("thread", ms(2026, 1, 5, 0, 0, 3) + 87, "info", "net.harborline.QuotaTask", "courier - at stop")),
    ("2026-01-05 00:02:45,281 - depot.quota - CRITICAL - gone", ("dashed", ms(2026, 1, 5, 0, 2, 45) + 281, "fatal", "depot.quota", "gone")),
    ('{"ts": "2024-12-01T19:53:13.8829Z", "level": "error", "component": "spool", "msg": "x"}', ("json", ms(2024, 12, 1, 19, 53, 13) + 882, "error", "spool", "x")),
    ('{\n "level": 60, "time": 1767571213096, "name": "quota-worker", "msg": "y"}', ("json", 1767571213096, "fatal", "quota-worker", "y")),
    ('{"message": "m", "logger": "svc.batcher", "severity": "NOTICE", "time": 1767571213096}', ("json", 1767571213096, "info", "svc.batcher", "m")),
    ('{"a": 1}', ("json", None, None, None, '{"a": 1}')),
    ('{"a": 1', None),
    ("[1, 2]", None),
    ("ts=2024-12-02T01:15:53.171201Z caller=renewal.go:567 level=fatal msg=\"a b\"", ("logfmt", ms(2024, 12, 2, 1, 15, 53) + 171, "fatal", "renewal.go", "a b")),
    ('msg="say \\"level=error\\" 84" module=bundler lvl=notice time="2026-01-05 02:03:02.286+02:00"\n  + a: 1', ("logfmt", ms(2026, 1, 5, 0, 3, 2) + 286, "info", "bundler", 'say "level=error" 84\n  + a: 1')),
    ("level=info component=sweeper msg=idle", ("logfmt", None, "info", "sweeper", "idle")),
    ('172.16.8.234 - - [01/Dec/2024:09:57:14 +0100] "GET / HTTP/1.1" 200', ("access", ms(2024, 12, 1, 8, 57, 14), None, None, '"GET / HTTP/1.1" 200')),
    ("2024/12/01 02:16:40 [crit] 39#0: *15526 disk", ("slashed", ms(2024, 12, 1, 2, 16, 40), "fatal", None, "*15526 disk")),
    ("E1201 00:19:54.063662      11 stamps.go:266] deadlock", ("lettered", ms(2024, 12, 1, 0, 19, 54) + 63, "error", "stamps.go", "deadlock")),
    ("<62>Dec  1 14:30:39 node-4 stampsd[15307]: flag", ("syslog", ms(2024, 12, 1, 14, 30, 39), "info", "stampsd", "flag")),
    ("<9>Dec 31 14:30:39 node-4 stampsd: flag", ("syslog", ms(2024, 12, 31, 14, 30, 39), "fatal", "stampsd", "flag")),
    ("<107>1 2026-01-04T19:00:42.921-05:00 node-17 bundlerctl 4493 - - dead", ("syslog", ms(2026, 1, 5, 0, 0, 42) + 921, "error", "bundlerctl", "dead")),
    ("<13>1 - host - - - -", ("syslog", None, "info", None, "")),
    ("[2026-01-05T00:08:02Z WARN  parcel::census] refill", ("bracketed", ms(2026, 1, 5, 0, 8, 2), "warn", "parcel::census", "refill")),
    ("WARN slow reader, level=error", ("levelled", None, "warn", None, "slow reader, level=error")),
    ("2026-01-05T00:08:02.5Z error: plain", ("timed", ms(2026, 1, 5, 0, 8, 2) + 500, "error", None, "plain")),
    ("2026-13-05 00:00:03,087 INFO  [p] a.B - x", ("thread", None, "info", "a.B", "x")),
    ("Traceback (most recent call last):", None),
    ('  File "/srv/depot/stamps.py", line 28, in run', None),
    ("\tat net.harborline.Task.run(Task.java:193)", None),
    ("ValueError: bad gantry 27", None),
    ("Caused by: java.io.IOException: pipe 4 closed", None),
    ("main.merge(0xed321b66)", None),
    ("  - tariff: 51", None),
    ("", None),
    (None, None),
    ('{"level": NaN, "msg": "x"}', ("json", None, None, None, "x")),
    ('{"level": -Infinity, "t": Infinity, "msg": "x"}', ("json", None, None, None, "x")),
    ("2026-01-05 00:00:03 [a] - b", ("timed", ms(2026, 1, 5, 0, 0, 3), None, None, "[a] - b")),
]


@pytest.mark.parametrize("line,want", CASES)
def test_header(line, want):
    got = layouts.parse_header(line, 2024)
    assert (got and (got[0], *got[1])) == want


def test_automaton_finds_what_trying_all_layouts_finds():
    for line, _ in CASES:
        if line:
            text = line.strip() if line.lstrip()[:1] == "{" else line
            tried = [x.name for x in layouts.LAYOUTS if x.parse(text, 2024) is not None]
            got = layouts.parse_header(line, 2024)
            assert (got is None) == (not tried) and (not tried or got[0] in tried), line


T0 = 1_767_571_200_000_000_000
SCHEMA = "entry_id long, labels map<string,string>, ts_ns long, line string, stream string, LINE string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_found_headers(spark):
    a = {"service_name": "a"}
    rows = [(1, a, T0 + 999_999, "INFO hi"), (2, a, T0, "  more"), (3, None, None, "WARN x"), (4, {}, T0, None), (5, {}, T0, ""), (6, {}, -1, "INFO before"), (7, a, T0, "INFO " + "z" * 200_000), (7, a, T0, "INFO twice")]
    got = sorted(tuple(r) for r in layouts.found_headers(table(spark, rows)).select("entry_id", "event_ms", "level_name", "component_name").collect())
    t = T0 // 1_000_000
    assert got == sorted([(1, t, "info", "-"), (3, None, "warn", "-"), (6, -1, "info", "-"), (7, t, "info", "-"), (7, t, "info", "-")], key=lambda r: (r[0], r[1] is None, r))
    assert layouts.found_headers(table(spark, rows).limit(0)).count() == 0


def test_records_join_predecessors_across_pieces(spark):
    a, b = {"p": "1", "q": "2"}, {"q": "2", "p": "1"}
    rows = [(1, a, T0, "  headless first"), (2, b, T0 + 1, "ERROR one"), (3, a, T0 + 1, "\tat x"), (4, {"p": "2"}, T0 + 1, "INFO other"), (5, a, T0 + 2, None)]
    n = 4000  # one stream far larger than a piece
    rows += [(10 + i, a, T0 + 10 + i, "INFO start" if i == 0 else f"  line {i}") for i in range(n)]
    got = {r.entry_id: r for r in layouts.assemble_records(table(spark, rows)).collect()}
    assert {k: r.line_count for k, r in got.items()} == {1: 1, 2: 2, 4: 1, 10: n}
    assert got[1].level_name == "-" and got[1].message == "  headless first"
    assert got[2].message == "one\n\tat x" and got[2].level_name == "error"
    assert got[10].message.split("\n")[1:] == [f"  line {i}" for i in range(1, n)]
    assert layouts.assemble_records(table(spark, rows).limit(0)).count() == 0


def test_halves_of_pairs_and_other_numbers_do_no_harm(spark):
    lines = ['{"component": "\\ud83d", "msg": "\\udc00", "level": 30}', '{"level": NaN, "component": "a"}', '{"level": Infinity, "ts": Infinity}', '{"level": 1e400, "ts": -1e400}', '{"level": 30.5}']
    rows = [(i, {}, T0, x) for i, x in enumerate(lines)]
    got = {r.entry_id: (r.level_name, r.component_name) for r in layouts.found_headers(table(spark, rows)).collect()}
    assert got == {0: ("info", "?"), 1: ("-", "a"), 2: ("-", "-"), 3: ("-", "-"), 4: ("-", "-")}
    assert {r.entry_id: r.message for r in layouts.assemble_records(table(spark, rows)).collect()}[0] == "?"


def by_hand(rows, part_lines):
    """Records of the rows, read in order with one pass over each stream."""
    out, streams = {}, {}
    for i, labels, ts, line in sorted((r for r in rows if (r[3] or "").strip(" ")), key=lambda r: (r[2], r[0])):
        key = frozenset((labels or {}).items())
        p = layouts.parse_header(line, 2026)
        if p is not None:
            streams[key] = i
            out[i] = [p[1][3]]
        elif key in streams:
            out[streams[key]].append(line)
        else:
            out[i] = [line]
    parts = {}
    for i, lines in out.items():
        for k in range(0, len(lines), part_lines):
            parts[i, k // part_lines] = ("\n".join(lines[k : k + part_lines]), len(lines[k : k + part_lines]))
    return parts


@pytest.mark.parametrize("part_lines", [3, 7, 10_000])
def test_records_and_their_parts_equal_one_pass(spark, part_lines):
    import random

    rng = random.Random(part_lines)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.5
        labels = {"s": "hot"} if hot else {"s": rng.choice("abcdefgh")}
        line = rng.choice(["INFO go", "level=warn msg=x", "{\"level\": 30}"]) if rng.random() < (0.01 if hot else 0.1) else rng.choice(["\tat x", " more", "a b", "", None, "   "])
        rows.append((i, labels, T0 + rng.randint(0, 1500), line))
    got = {(r.entry_id, r.part): (r.message, r.line_count) for r in layouts.assemble_records(table(spark, rows), part_lines=part_lines).collect()}
    assert got == by_hand(rows, part_lines)


def test_year_is_that_of_the_row(spark):
    when = datetime(2023, 7, 1, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    ns = when // timedelta(microseconds=1) * 1000
    df = table(spark, [(1, {}, ns, "<62>Dec  1 14:30:39 h p: x")])
    assert layouts.parse_entries(df).agg(F.max("event_ms")).first()[0] == ms(2023, 12, 1, 14, 30, 39)
