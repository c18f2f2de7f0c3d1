"""Log lines of differing layouts into timestamp, level, component and message.

Literals that a layout cannot do without (its anchors) stand in one Aho-Corasick automaton. A pass over the line
retrieves the layouts whose anchors all occur; the anchored expression of each verifies it and extracts the fields. Lines
that no layout verifies have no header and continue the record before them in their stream.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.ordering import ordered_pieces, stream_key
from brindle.operators.unparsed import logfmt_cells
from brindle.session import materialize, narrow

#: The six level names and the words, letters and numbers that stand for them.
LEVELS = {
    "trace": "trace", "trc": "trace",
    "debug": "debug", "dbg": "debug",
    "info": "info", "inf": "info", "information": "info", "informational": "info", "notice": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn",
    "error": "error", "err": "error",
    "fatal": "fatal", "crit": "fatal", "critical": "fatal", "panic": "fatal", "alert": "fatal", "emerg": "fatal", "emergency": "fatal",
    "10": "trace", "20": "debug", "30": "info", "40": "warn", "50": "error", "60": "fatal",
}
LETTERS = {"T": "trace", "D": "debug", "I": "info", "W": "warn", "E": "error", "F": "fatal"}
SYSLOG = ("fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug")
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
#: Names of the fields of a structured record, in order of precedence.
TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "t", "datetime")
LEVEL_KEYS = ("level", "lvl", "severity", "loglevel", "log_level")
COMPONENT_KEYS = ("component", "logger", "module", "name", "caller", "program", "source", "file")
MESSAGE_KEYS = ("msg", "message", "text", "event")

Fields = tuple[int | None, str | None, str | None, str]  # epoch ms, level, component, message
_DASH = "-"


@lru_cache(maxsize=4096)
def _midnight(y: int, m: int, d: int) -> int | None:
    """Epoch milliseconds of a day's start, None where the calendar lacks it."""
    import datetime

    try:
        return (datetime.date(y, m, d).toordinal() - 719163) * 86_400_000
    except ValueError:
        return None


def _ms(y: int, mo: int, d: int, hms: str, frac: str | None = None, zone: str | None = None) -> int | None:
    day = _midnight(y, mo, d)
    h, mi, s = int(hms[:2]), int(hms[3:5]), int(hms[6:8])
    if day is None or h > 23 or mi > 59 or s > 60:
        return None
    ms = day + ((h * 60 + mi) * 60 + s) * 1000
    if frac:
        ms += int(frac[:3].ljust(3, "0"))
    if zone and zone not in "Zz":
        z = zone.replace(":", "")
        off = int(z[1:3]) * 60 + int(z[3:5] or 0)
        ms += (off if z[0] == "-" else -off) * 60_000
    return ms


_ISO = r"(\d{4})-([01]\d)-(\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d+))?\s?(Z|[+-]\d\d:?\d\d)?"
_iso = re.compile(_ISO + r"\Z", re.ASCII)
_WORD = "TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|CRIT|CRITICAL|FATAL|PANIC|ALERT|EMERG"


def parse_time(v: object) -> int | None:
    """Epoch milliseconds, cut off below, of an ISO time or of a number of seconds, milli-, micro- or nanoseconds."""
    if isinstance(v, str):
        m = _iso.match(v.strip())
        if m:
            y, mo, d, hms, frac, zone = m.groups()
            return _ms(int(y), int(mo), int(d), hms, frac, zone)
        if not re.fullmatch(r"-?\d{1,20}(\.\d+)?", v.strip(), re.ASCII):
            return None
        v = float(v) if "." in v else int(v)
    if isinstance(v, bool) or not isinstance(v, int | float) or v != v or abs(v) > 1e20:
        return None
    a = abs(v)
    if a >= 10**17:
        return int(v // 1_000_000)
    if a >= 10**14:
        return int(v // 1000)
    if a >= 10**11:
        return int(v // 1)
    return int(v * 1000 // 1)


def level_name(v: object) -> str | None:
    if isinstance(v, str):
        return LEVELS.get(v.strip().lower())
    if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) and v == int(v):
        return LEVELS.get(str(int(v)))
    return None


_LINE_NUMBER = re.compile(r"(?::\d+)+\Z|\[\d+\]\Z", re.ASCII)


def _component(v: object) -> str | None:
    if not isinstance(v, str) or not v.strip() or v == _DASH:
        return None
    return _LINE_NUMBER.sub("", v) or None


def _structured(get: Callable[[str], object], raw: str) -> Fields:
    time = next((t for k in TIME_KEYS if (t := parse_time(get(k))) is not None), None)
    level = next((x for k in LEVEL_KEYS if (x := level_name(get(k)))), None)
    component = next((x for k in COMPONENT_KEYS if (x := _component(get(k)))), None)
    message = next((x for k in MESSAGE_KEYS if isinstance(x := get(k), str)), raw)
    return time, level, component, message


def _json(line: str, _: int) -> Fields | None:
    try:
        record = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return _structured(record.get, line) if isinstance(record, dict) and record else None


_PAIRS = re.compile(r'[A-Za-z_][\w.\-]*=(?:"(?:[^"\\]|\\.)*"|[^ "]*)(?: |\Z)', re.ASCII | re.DOTALL)


def _logfmt(line: str, _: int) -> Fields | None:
    """A line that begins with a key=value pair, and has two pairs or more, or a level or time; lines after the first are part of the message."""
    if not _PAIRS.match(line.partition("\n")[0]):
        return None
    head, nl, rest = line.partition("\n")
    keys, vals, broken = logfmt_cells(head)
    cells = dict(zip(reversed(keys), reversed(vals), strict=True))
    time, level, component, message = _structured(cells.get, head)
    if (broken >= 0 or len(keys) < 2) and time is None and level is None:
        return None
    return time, level, component, message + nl + rest


def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII | re.DOTALL)


_THREAD = _re(_ISO + rf" +({_WORD}) +\[[^\]\n]*\] +(\S+) +[-:] (.*)\Z")


def _thread(line: str, _: int) -> Fields | None:
    m = _THREAD.match(line)
    if m is None:
        return None
    y, mo, d, hms, frac, zone, level, component, message = m.groups()
    return _ms(int(y), int(mo), int(d), hms, frac, zone), LEVELS[level.lower()], _component(component), message


_DASHED = _re(_ISO + rf" - (\S+) - ({_WORD}) - (.*)\Z")


def _dashed(line: str, _: int) -> Fields | None:
    m = _DASHED.match(line)
    if m is None:
        return None
    y, mo, d, hms, frac, zone, component, level, message = m.groups()
    return _ms(int(y), int(mo), int(d), hms, frac, zone), LEVELS[level.lower()], _component(component), message


_BRACKETED = _re(r"\[" + _ISO + rf" +({_WORD}) +([^\]\s]+)\] ?(.*)\Z")


def _bracketed(line: str, _: int) -> Fields | None:
    m = _BRACKETED.match(line)
    if m is None:
        return None
    y, mo, d, hms, frac, zone, level, component, message = m.groups()
    return _ms(int(y), int(mo), int(d), hms, frac, zone), LEVELS[level.lower()], _component(component), message


_ACCESS = _re(r"\S+ \S+ [^\[\n]*\[(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d:\d\d:\d\d) ([+-]\d{4})\] (\".*)\Z")


def _access(line: str, _: int) -> Fields | None:
    m = _ACCESS.match(line)
    if m is None or m.group(2) not in MONTHS:
        return None
    d, mo, y, hms, zone, message = m.groups()
    return _ms(int(y), MONTHS[mo], int(d), hms, None, zone), None, None, message


_SLASHED = _re(r"(\d{4})/([01]\d)/(\d\d) (\d\d:\d\d:\d\d) \[(\w+)\] \d+#\d+: (.*)\Z")


def _slashed(line: str, _: int) -> Fields | None:
    m = _SLASHED.match(line)
    if m is None:
        return None
    y, mo, d, hms, level, message = m.groups()
    return _ms(int(y), int(mo), int(d), hms), LEVELS.get(level.lower()), None, message


_LETTERED = _re(r"([DIWEFT])(\d\d)(\d\d) ([012]\d:\d\d:\d\d)(?:\.(\d+))? +\d+ ([^\]\s]+)\] ?(.*)\Z")


def _lettered(line: str, year: int) -> Fields | None:
    m = _LETTERED.match(line)
    if m is None:
        return None
    letter, mo, d, hms, frac, component, message = m.groups()
    return _ms(year, int(mo), int(d), hms, frac), LETTERS[letter], _component(component), message


_SYSLOG_OLD = _re(r"<(\d{1,3})>([A-Z][a-z]{2}) ([ \d]\d) (\d\d:\d\d:\d\d) (\S+) ([^\s:\[]+)(?:\[[^\]\n]*\])?: ?(.*)\Z")
_SYSLOG_NEW = _re(r"<(\d{1,3})>\d{1,2} (?:-|" + _ISO + r") (\S+) (\S+) (\S+) (\S+) (?:-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?\Z")


def _syslog(line: str, year: int) -> Fields | None:
    m = _SYSLOG_OLD.match(line)
    if m:
        pri, mo, d, hms, _, component, message = m.groups()
        if mo not in MONTHS:
            return None
        return _ms(year, MONTHS[mo], int(d), hms), SYSLOG[int(pri) % 8], _component(component), message
    m = _SYSLOG_NEW.match(line)
    if m is None:
        return None
    pri, y, mo, d, hms, frac, zone, _, component, _, _, message = m.groups()
    time = _ms(int(y), int(mo), int(d), hms, frac, zone) if y else None
    return time, SYSLOG[int(pri) % 8], _component(component), message or ""


_LEVELLED = _re(rf"\[?({_WORD})\]?(?:[: ]\s*(.*))?\Z")


def _levelled(line: str, _: int) -> Fields | None:
    m = _LEVELLED.match(line)
    return m and (None, LEVELS[m.group(1).lower()], None, m.group(2) or "")


_TIMED = _re(r"\[?" + _ISO + rf"\]?[ :]+(?:\[?({_WORD}|{_WORD.lower()})\]?[ :]+)?(.*)\Z")


def _timed(line: str, _: int) -> Fields | None:
    m = _TIMED.match(line)
    if m is None:
        return None
    y, mo, d, hms, frac, zone, level, message = m.groups()
    return _ms(int(y), int(mo), int(d), hms, frac, zone), level and LEVELS[level.lower()], None, message


@dataclass(frozen=True)
class Layout:
    """anchors: groups of literals; a line of this layout holds at least one literal of each group. parse: fields, or None where the line isn't one.

    general: its form includes those of other layouts, so that it is verified after them.
    """

    name: str
    anchors: tuple[tuple[str, ...], ...]
    parse: Callable[[str, int], Fields | None]
    general: bool = False


_WORDS = tuple(_WORD.split("|"))
_SPACED = tuple(f" {w}" for w in _WORDS)
_MONTH = ("-0", "-1")
_KEYS = tuple(f"{k}=" for k in TIME_KEYS + LEVEL_KEYS + COMPONENT_KEYS + MESSAGE_KEYS)
LAYOUTS: tuple[Layout, ...] = (
    Layout("json", (("{",), ('"',), (":",)), _json),
    Layout("logfmt", (_KEYS,), _logfmt),
    Layout("thread", (_SPACED, _MONTH, ("[",), ("]",)), _thread),
    Layout("dashed", (tuple(f"- {w} -" for w in _WORDS), _MONTH), _dashed),
    Layout("bracketed", (("[",), _MONTH, _SPACED, ("]",)), _bracketed),
    Layout("access", (('] "',), tuple(f"/{m}/" for m in MONTHS)), _access),
    Layout("slashed", (("/0", "/1"), ("] ",), ("#",)), _slashed),
    Layout("lettered", (("]",), (" 0", " 1", " 2")), _lettered),
    Layout("syslog", (("<",), (">",)), _syslog),
    Layout("levelled", (_WORDS,), _levelled),
    Layout("timed", (_MONTH, (":",)), _timed, general=True),
)


@lru_cache(maxsize=4)
def _router(layouts: tuple[Layout, ...]):
    """(automaton, needs): the automaton gives each anchor's groups as bits and the layouts that have them; needs are the groups of each layout."""
    import ahocorasick

    groups = list(dict.fromkeys(g for x in layouts for g in x.anchors))
    bit = {g: 1 << k for k, g in enumerate(groups)}
    needs = [sum(bit[g] for g in x.anchors) for x in layouts]
    automaton = ahocorasick.Automaton()
    for a in dict.fromkeys(a for g in groups for a in g):
        bits = sum(bit[g] for g in groups if a in g)
        automaton.add_word(a, (bits, tuple(i for i, need in enumerate(needs) if need & bits)))
    automaton.make_automaton()
    return automaton, needs


def parse_header(line: str | None, year: int, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[str, Fields] | None:
    """(layout, fields) of a line with a header; None for any other. A line wrapped in white space is read without it in front."""
    if line is None:
        return None
    if line[:1] in "{ \t" and line.lstrip()[:1] == "{":
        line = line.strip()
    automaton, needs = _router(layouts)
    held = tried = 0
    later = []
    for _, (bits, having) in automaton.iter(line):
        if bits & ~held:
            held |= bits
            for i in having:
                if not tried >> i & 1 and needs[i] & held == needs[i]:
                    tried |= 1 << i
                    if layouts[i].general:
                        later.append(i)
                    elif (f := layouts[i].parse(line, year)) is not None:
                        return layouts[i].name, f
    for i in later:
        if (f := layouts[i].parse(line, year)) is not None:
            return layouts[i].name, f
    return None


_OUT = [
    ("entry_id", pa.int64()),
    ("layout", pa.string()),
    ("event_ms", pa.int64()),
    ("level_name", pa.string()),
    ("component_name", pa.string()),
    ("message", pa.string()),
]


def _strings(values: Sequence[str | None]) -> pa.Array:
    """A column of strings; halves of surrogate pairs, which JSON can hold and UTF-8 can't, become question marks."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


class _Years:
    """The year of a time in nanoseconds, remembered by day."""

    def __init__(self) -> None:
        self.seen: dict[int, int] = {}

    def __call__(self, ts: int | None) -> int:
        day = 0 if ts is None else ts // 86_400_000_000_000
        year = self.seen.get(day)
        if year is None:
            import datetime

            year = self.seen[day] = (datetime.date(1970, 1, 1) + datetime.timedelta(days=day)).year if -700_000 < day < 2_900_000 else 1970
        return year


def _header(line: str | None, ts: int | None, years: _Years) -> tuple[str, int | None, str, str, str] | None:
    """layout, event_ms, level, component, message of a row that begins a record."""
    p = parse_header(line, years(ts))
    if p is None:
        return None
    layout, (time, level, component, message) = p
    return layout, time if time is not None else None if ts is None else ts // 1_000_000, level or _DASH, component or _DASH, message


def _parser(with_message: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        years = _Years()
        nothing = (None,) * 5
        for b in batches:
            rows = [_header(line, ts, years) or nothing for ts, line in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            layout, event, level, component, message = zip(*rows, strict=True) if rows else ((),) * 5
            cols = [b.column(0), pa.array(layout, pa.string()), pa.array(event, pa.int64()), pa.array(level, pa.string()), _strings(component)]
            if with_message:
                cols.append(_strings(message))
            yield pa.RecordBatch.from_arrays(cols, [x for x, _ in _OUT[: len(cols)]])

    return run


def parse_entries(df: DataFrame, id_col: str = "entry_id", ts_col: str = "ts_ns", line_col: str = "line", with_message: bool = True) -> DataFrame:
    """Fields of each row: entry_id, layout, event_ms, level_name, component_name[, message].

    layout is null for a row without a header (null and empty lines too), and so are its fields. event_ms is the header's own time in epoch
    milliseconds, cut off below: no zone means UTC, no year the year of the row's time, no time the row's time (null where that is null).
    level_name is one of trace, debug, info, warn, error, fatal, or '-'; component_name is '-' where the header names none.
    Whole lines are read, of any length; repeated rows give repeated results. Levels that are no number JSON allows (NaN, Infinity) name none;
    halves of surrogate pairs become question marks.
    """
    src = narrow(df, id=id_col, ts=ts_col, line=line_col).select(F.col("id").cast("long"), F.col("ts").cast("long"), F.col("line").cast("string"))
    fields = [T.StructField(n, T.LongType() if t == pa.int64() else T.StringType()) for n, t in _OUT[: 6 if with_message else 5]]
    return src.mapInArrow(_parser(with_message), T.StructType(fields))


def found_headers(df: DataFrame, **kw) -> DataFrame:
    """The rows that begin a record: entry_id, event_ms, level_name, component_name."""
    return parse_entries(df, with_message=False, **kw).where(F.col("layout").isNotNull()).select("entry_id", "event_ms", "level_name", "component_name")


#: Rows of a folded piece: parts of records that lie whole inside it, rows before the first header of the stream that it begins with
#: (their record may have begun in a piece before), and the part that is open at its end.
INSIDE, LEADING, OPEN = 0, 1, 2
_HEAD = [("record", pa.int64()), ("event_ms", pa.int64()), ("level_name", pa.string()), ("component_name", pa.string())]
_FOLDED = pa.schema(
    [("piece", pa.int32()), ("edge", pa.int32()), ("stream", pa.int64()), *_HEAD, ("first_line", pa.int64()), ("message", pa.string()), ("line_count", pa.int64())]
    + [("ids", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("lines", pa.list_(pa.string()))]
)
_FOLDED_SQL = (
    "piece int, edge int, stream bigint, record bigint, event_ms bigint, level_name string, component_name string, first_line bigint, message string, line_count bigint, "
    "ids array<bigint>, times array<bigint>, lines array<string>"
)


class _Piece:
    """Folds the rows of one ordered piece into parts of records of at most part_lines lines each; holds one part at a time."""

    def __init__(self, piece: int, part_lines: int) -> None:
        self.piece, self.part_lines = piece, part_lines
        self.out: list[tuple] = []
        self.began = False
        self.leading = True  # still before the first header of the first stream
        self.stream: int | None = None
        self.head: tuple | None = None
        self.first_line = 0
        self.ids: list = []
        self.times: list = []
        self.lines: list[str] = []

    def _put(self, edge: int) -> None:
        if edge == LEADING:
            self.out.append((self.piece, edge, self.stream, None, None, None, None, self.first_line, None, len(self.lines), self.ids, self.times, _whole(self.lines)))
        elif edge == OPEN:
            self.out.append((self.piece, edge, self.stream, *self.head, self.first_line, None, len(self.lines), None, None, _whole(self.lines)))
        else:
            self.out.append((self.piece, edge, self.stream, *self.head, self.first_line, "\n".join(self.lines), len(self.lines), None, None, None))
        self.first_line += len(self.lines)
        self.ids, self.times, self.lines = [], [], []

    def _close(self) -> None:
        if self.lines:
            self._put(LEADING if self.head is None else INSIDE)
        self.first_line = 0

    def row(self, stream: int, ts: int | None, i: int | None, line: str, header: tuple | None) -> None:
        if stream != self.stream:
            self._close()
            self.leading, self.began = not self.began, True
            self.stream, self.head = stream, None
        if header is not None:
            self._close()
            self.leading = False
            self.head = (i, *header[1:4])
            self.lines.append(header[4])
        elif self.head is None and not self.leading:  # before the first header of a stream that begins here
            alone = (i, None if ts is None else ts // 1_000_000, _DASH, _DASH)
            self.out.append((self.piece, INSIDE, stream, *alone, 0, line, 1, None, None, None))
        else:
            if self.head is None:
                self.ids.append(i)
                self.times.append(ts)
            self.lines.append(line)
        if len(self.lines) >= self.part_lines:
            self._put(LEADING if self.head is None else INSIDE)

    def end(self) -> None:
        # An open record without lines in its last part is told too, as is that none is open: what follows has to know.
        if self.head is not None:
            self._put(OPEN)
        else:
            self._close()
            if self.began and not self.leading:
                self.out.append((self.piece, OPEN, self.stream, *(None,) * 10))

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(_FOLDED)
        return pa.RecordBatch.from_arrays([_strings(c) if t.type == pa.string() else pa.array(c, t.type) for c, t in zip(cols, _FOLDED, strict=True)], schema=_FOLDED)


def _whole(lines: list[str]) -> list[str]:
    return [x.encode("utf-8", "replace").decode() for x in lines]


def _fold_pieces(part_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, years = _Piece(TaskContext.get().partitionId(), part_lines), _Years()
        for b in batches:
            for stream, ts, i, line in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                piece.row(stream, ts, i, line, _header(line, ts, years))
            yield piece.batch()
        piece.end()
        yield piece.batch()

    return run


def _carried(folded: DataFrame) -> DataFrame:
    """For each piece with leading rows: the record that they continue, its fields, and how many lines it has before them. A row for each piece."""
    leads, opens = F.col("edge") == LEADING, F.col("edge") == OPEN
    pieces = folded.where(F.col("edge") != INSIDE).groupBy("piece").agg(
        F.max(F.when(leads, F.col("stream"))).alias("first"), F.coalesce(F.sum(F.when(leads, F.col("line_count"))), F.lit(0)).alias("leading"),
        F.max(F.when(opens, F.struct("stream", (F.col("first_line") + F.col("line_count")).alias("n"), *[n for n, _ in _HEAD]))).alias("head"),
    )
    order = Window.orderBy("piece")
    # A piece that is all continuation passes on what it was given.
    state = F.when(F.col("head").isNotNull(), F.struct("head", "total"))
    before = pieces.withColumn("total", F.sum("leading").over(order)).withColumn("from", F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    held = before.where((F.col("leading") > 0) & (F.col("from.head.stream") == F.col("first")) & F.col("from.head.n").isNotNull())
    return held.select("piece", *[F.col(f"from.head.{n}").alias(f"c_{n}") for n, _ in _HEAD], (F.col("from.head.n") + F.col("total") - F.col("leading") - F.col("from.total")).alias("c_lines"))


def assemble_records(
    df: DataFrame, id_col: str = "entry_id", ts_col: str = "ts_ns", line_col: str = "line", labels_col: str = "labels", part_lines: int = 10_000
) -> DataFrame:
    """One row for each record: entry_id, part, event_ms, level_name, component_name, message, line_count.

    A row without a header joins the last row with one before it in its stream (by time, then id), and its line is added to that message;
    a row before its stream's first header is a record of its own with its own time and '-' for the rest. Null and blank
    lines are left out. A record of more than part_lines lines comes in parts of that many, numbered from 0, so that no task holds
    a record of any length; all others are part 0. line_count is the number of rows of the part. Rows repeated with their id are rows of their own. An
    empty table gives no rows; other columns are ignored.

    A stream may hold any share of the rows: rows are cut by range of (stream, time, id), each sorted piece is folded by itself, and only
    the rows before a piece's first header and its last record meet those of other pieces.
    """
    filled = narrow(df, id=id_col, ts=ts_col, line=line_col, labels=labels_col).where(F.trim(F.coalesce("line", F.lit(""))) != "")
    rows = filled.select(stream_key("labels").alias("stream"), F.col("ts").cast("long"), F.col("id").cast("long"), F.col("line").cast("string"))
    # Written once: the edges are looked up in it. Lines are parsed after the exchange, so that the sampling of its ranges reads keys only.
    folded = materialize(ordered_pieces(rows, "stream", "ts", "id").mapInArrow(_fold_pieces(part_lines), _FOLDED_SQL))
    carried = _carried(folded)
    fields = [n for n, _ in _HEAD]
    out = [*[F.col(n) for n in fields], F.expr(f"cast(first_line div {part_lines} as int)").alias("part"), "message", "line_count"]
    inside = folded.where(F.col("edge") == INSIDE).select(*out)
    # At most one row for each piece is broadcast.
    leading = folded.where(F.col("edge") == LEADING).join(F.broadcast(carried), "piece", "left")
    leading = leading.select("*", F.posexplode(F.arrays_zip("ids", "times", "lines")).alias("pos", "x"))
    alone = leading.where("c_lines is null").select(
        F.col("x.ids").alias("record"), F.expr("x.times div 1000000").alias("event_ms"), F.lit(_DASH).alias("level_name"), F.lit(_DASH).alias("component_name"),
        F.lit(0).alias("part"), F.col("x.lines").alias("message"), F.lit(1).cast("long").alias("line_count"),
    )
    later = leading.where("c_lines is not null").select(*[F.col(f"c_{n}").alias(n) for n in fields], (F.col("c_lines") + F.col("first_line") + F.col("pos")).alias("at"), F.col("x.lines").alias("line"), "stream")
    opened = folded.where(F.col("edge") == OPEN).select(*fields, "first_line", "stream", F.posexplode("lines").alias("pos", "line")).select(*fields, (F.col("first_line") + F.col("pos")).alias("at"), "line", "stream")
    part = F.expr(f"cast(at div {part_lines} as int)").alias("part")
    # Groups of at most part_lines lines.
    over = opened.unionByName(later).groupBy("stream", *fields, part).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("message"), F.count(F.lit(1)).alias("line_count")
    ).select(*fields, "part", "message", "line_count")
    return inside.unionByName(alone).unionByName(over).select(F.col("record").alias("entry_id"), "part", "event_ms", "level_name", "component_name", "message", "line_count")
