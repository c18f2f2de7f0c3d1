"""Rows that fail to parse: separate them with the reason, load the others.

Lines are parsed into cells (row, column, value); the cells are exploded and joined with a rule table, each rule is
evaluated on its cells, the errors are aggregated per row, and the clean rows are the anti-join of the input with
the rows that have errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import by_place, narrow, place


@dataclass(frozen=True)
class Rule:
    """What a column of a parsed line must hold.

    scope: 'all', or the group of lines that the rule holds for. required: stands exactly once and not empty.
    check: name of a value check in CHECKS, or None.
    """

    column: str
    scope: str = "all"
    required: bool = False
    check: str | None = None


#: The rules of the query log (TESTDATA.md, problem 1).
QUERY_LOG_RULES: tuple[Rule, ...] = (
    Rule("level", "all", True, "level"),
    Rule("ts", "all", True, "rfc3339"),
    Rule("caller", "all", True),
    Rule("component", "metrics", True),
    Rule("org_id", "metrics", True),
    Rule("query", "metrics", True),
    Rule("query_type", "metrics", True),
    Rule("duration", "metrics", True, "duration"),
    Rule("status", "metrics", True, "status"),
    Rule("splits", "metrics", False, "digits"),
    Rule("total_bytes", "metrics", False, "digits"),
)


def _exists(v: Column) -> Column:
    """The date at the head of v is one of the calendar."""
    y, m, d = (F.substring(v, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (m >= 1) & (m <= 12) & (d >= 1) & (d <= days)


_RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])\z"
_DURATION = r"\A(?:[0-9]+(?:\.[0-9]+)?(?:ns|us|µs|ms|s|m|h))+\z"

#: A value check gets the value's column and gives a boolean column.
CHECKS = {
    "level": lambda v: v.isin("debug", "info", "warn", "error"),
    "rfc3339": lambda v: F.when(v.rlike(_RFC3339), _exists(v)).otherwise(False),
    "duration": lambda v: v.rlike(_DURATION),
    "status": lambda v: v.rlike(r"\A[1-5][0-9]{2}\z"),
    "digits": lambda v: v.rlike(r"\A[0-9]+\z"),
}

_KEY = re.compile(r'[^ ="]+')
_BARE = re.compile(r"[^ ]*")
_QUOTED = re.compile(r'"((?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-3][0-7]{2}|x[0-9A-Fa-f]{2}|u(?![dD][89A-Fa-f])[0-9A-Fa-f]{4}|U(?:0000(?![dD][89A-Fa-f])|000[1-9A-Fa-f]|0010)[0-9A-Fa-f]{4}))*)"(?= |\Z)')
_PLAIN_QUOTED = re.compile(r'"([^"\\\n]*)"(?= |\Z)')
_ESCAPE = re.compile(rb'\\([abfnrtv\\"]|[0-3][0-7]{2}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})')
_SINGLE = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v", b"\\": b"\\", b'"': b'"'}


def _unescape(m: re.Match) -> bytes:
    e = m.group(1)
    if e in _SINGLE:
        return _SINGLE[e]
    if e[:1] == b"x":
        return bytes([int(e[1:], 16)])
    if e[:1] in b"uU":
        return chr(int(e[1:], 16)).encode()
    return bytes([int(e, 8)])


def logfmt_cells(line: str) -> tuple[list[str], list[str], int]:
    """Keys and values of a logfmt line, and the offset (in characters) at which its form breaks, -1 where it doesn't.

    Pairs `key=value` are separated by spaces. A key isn't empty and holds no `"`; alone it has an empty value. A value
    that begins with `"` ends at the next unescaped `"`, which a space or the end follows, and holds the escapes of a
    double-quoted Go string and no raw newline; its value here is unescaped. Any other value runs to the next space.
    The cells before a break are returned too.
    """
    keys: list[str] = []
    values: list[str] = []
    at, end = 0, len(line)
    while at < end:
        if line[at] == " ":
            at += 1
            continue
        m = _KEY.match(line, at)
        if m is None:
            return keys, values, at
        p, v = m.end(), ""
        if p < end and line[p] == "=":
            p += 1
            if line.startswith('"', p):
                q = _PLAIN_QUOTED.match(line, p)
                if q is None:
                    q = _QUOTED.match(line, p)
                    if q is None:
                        return keys, values, p
                    v = _ESCAPE.sub(_unescape, q.group(1).encode("utf-8", "surrogatepass")).decode("utf-8", "replace")
                else:
                    v = q.group(1)
                p = q.end()
            else:
                q = _BARE.match(line, p)
                v, p = q.group(), q.end()
        elif p < end and line[p] != " ":
            return keys, values, p
        keys.append(m.group())
        values.append(v)
        at = p
    return keys, values, -1


_PARSED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("row_hash", T.LongType()),
        T.StructField("broken_at", T.IntegerType()),
        T.StructField("keys", T.ArrayType(T.StringType())),
        T.StructField("vals", T.ArrayType(T.StringType())),
    ]
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for b in batches:
        keys, vals, broken = [], [], []
        for line in b.column(2).to_pylist():
            k, v, at = ([], [], -2) if line is None or not line.strip() else logfmt_cells(line)
            keys.append(k)
            vals.append(v)
            broken.append(at)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(broken, pa.int32()), pa.array(keys, strings), pa.array(vals, strings)],
            ["row_id", "row_hash", "broken_at", "keys", "vals"],
        )


def parse_cells(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """Cells of each line: row_id, row_hash, broken_at, keys, vals.

    broken_at: -1 for a line of good form, -2 for a null or blank one, else where the form breaks.
    row_hash tells rows with the same id and different lines apart.
    """
    src = narrow(df, row_id=id_col, line=line_col).select(F.col("row_id").cast("long"), F.xxhash64("line").alias("row_hash"), "line")
    return src.mapInArrow(_parse_batches, _PARSED)


def find_errors(
    df: DataFrame, id_col: str, line_col: str, rules: Sequence[Rule] = QUERY_LOG_RULES, scope_key: str = "caller", scopes: dict[str, str] | None = None, details: bool = True
) -> DataFrame:
    """One row for each failing row: row_id, row_hash, reasons (array of struct<reason, column, detail>), copies.

    reason is 'blank', 'form', 'count' or 'value'. details: with the offending value, which costs an aggregation of strings; otherwise detail is null. scopes: prefix of the last value of scope_key -> scope name of rules.
    Equal rows (same id, same line) fold into one result row whose `copies` says how many they are. An empty input gives no row.
    """
    scopes = {"metrics.go": "metrics"} if scopes is None else scopes
    spark = df.sparkSession
    parsed = parse_cells(df, id_col, line_col)
    table = spark.createDataFrame([(r.column, i) for i, r in enumerate(rules)], "col string, rule int")
    # A cell without a column stands for the row itself, so that rows without any cell stay.
    cells = parsed.select(
        "row_id",
        "row_hash",
        "broken_at",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("").alias("col"), F.lit("").alias("val"), F.lit(-1).alias("pos"))),
                F.transform(F.arrays_zip("keys", "vals"), lambda x, i: F.struct(x["keys"].alias("col"), x["vals"].alias("val"), i.alias("pos"))),
            )
        ).alias("cell"),
    ).select("row_id", "row_hash", "broken_at", "cell.*")
    # The rule table has a row for each rule, a few dozen at most.
    ruled = cells.join(F.broadcast(table), "col", "left").where(F.col("rule").isNotNull() | (F.col("pos") == -1))
    bad = F.lit(False)
    for i, r in enumerate(rules):
        if r.check:
            bad = F.when(F.col("rule") == i, ~F.coalesce(CHECKS[r.check](F.col("val")), F.lit(False))).otherwise(bad)
    # The last cell of the scope's key says what the line is: its position and the number of its scope in one integer.
    names = list(dict.fromkeys(scopes.values()))
    number = F.lit(0)
    for prefix, name in reversed(list(scopes.items())):
        number = F.when(F.col("val").startswith(prefix), names.index(name) + 1).otherwise(number)
    aggs = [F.count(F.when(F.col("pos") == -1, 1)).alias("copies"), F.max("broken_at").alias("broken_at")]
    aggs.append(F.max(F.when(F.col("col") == scope_key, F.col("pos") * (len(names) + 1) + number)).alias("scope"))
    for i, r in enumerate(rules):
        here = F.col("rule") == i
        if r.required:
            aggs.append(F.count(F.when(here, 1)).alias(f"n{i}"))
            aggs.append(F.count(F.when(here & (F.col("val") == ""), 1)).alias(f"e{i}"))
        if r.check:
            # An empty value of a column that has to be filled is an error of count.
            wrong = here & F.col("bad") & ((F.col("val") != "") if r.required else F.lit(True))
            aggs.append(F.count(F.when(wrong, 1)).alias(f"w{i}"))
            if details:
                aggs.append(F.first(F.when(wrong, F.col("val")), ignorenulls=True).alias(f"b{i}"))
    rows = ruled.withColumn("bad", bad).groupBy("row_id", "row_hash").agg(*aggs)
    reasons = [
        F.when(F.col("broken_at") == -2, _reason("blank", "", F.lit(""))),
        F.when(F.col("broken_at") >= 0, _reason("form", "", F.col("broken_at").cast("string"))),
    ]
    good = F.col("broken_at") == -1
    for i, r in enumerate(rules):
        within = good
        if r.scope != "all":
            within = good & F.coalesce(F.pmod("scope", F.lit(len(names) + 1)) == (names.index(r.scope) + 1 if r.scope in names else -1), F.lit(False))
        if r.required:
            n = F.col(f"n{i}") / F.col("copies")
            reasons.append(F.when(within & ((n != 1) | (F.col(f"e{i}") > 0)), _reason("count", r.column, n.cast("int").cast("string"))))
        if r.check:
            reasons.append(F.when(within & (F.col(f"w{i}") > 0), _reason("value", r.column, F.col(f"b{i}") if details else F.lit(None).cast("string"))))
    return rows.select("row_id", "row_hash", F.array_compact(F.array(*reasons)).alias("reasons"), "copies").where(F.size("reasons") > 0)


def _reason(kind: str, column: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("reason"), F.lit(column).alias("column"), detail.alias("detail"))


def split_unparsed(df: DataFrame, id_col: str = "line_id", line_col: str = "line", rules: Sequence[Rule] = QUERY_LOG_RULES) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejected): the rows that parse and hold what they must, and the others with their reasons.

    loaded has df's columns unchanged and reads no values; rejected has row_id, reason, column, detail, one row for each error of each rejected row
    (rows that are equal in id and line give one set of errors). A null or blank line is rejected with reason 'blank'. A null id is kept
    like any other. Extra columns, whatever their names, pass through loaded. An empty input gives two empty results.
    """
    errors = find_errors(df, id_col, line_col, rules)
    failing = find_errors(df, id_col, line_col, rules, details=False)
    i, line = (f"__c{place(df, c)}" for c in (id_col, line_col))
    keys = failing.select(F.col("row_id").alias("__e_id"), F.col("row_hash").alias("__e_hash"))
    same = F.col(i).cast("long").eqNullSafe(F.col("__e_id")) & (F.xxhash64(F.col(line)) == F.col("__e_hash"))
    loaded = by_place(df).join(keys, same, "left_anti").toDF(*df.columns)
    rejected = errors.select("row_id", F.inline("reasons"))
    return loaded, rejected
