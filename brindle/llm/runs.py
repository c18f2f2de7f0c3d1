"""Repeated consecutive events: collapse each run of like neighbours into one event with its count and duration.

Each row's line is turned into a canonical event; the events of a stretch of the ordered stream become Unicode code points of
one string, a backreference expression finds the repetitions, and their spans are mapped back to rows and times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.ordering import ordered_pieces, stream_key
from brindle.session import materialize, narrow, release

#: Characters other than the space that split words.
SPACE = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_DIGIT_WORD = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"

#: One repetition of an event: a code point and as many of its like as follow; the separator is no event.
_SEPARATOR = "\n"
_RUN = re.compile(r"([^\n])\1*")


def canonical_event(line: str | Column) -> Column:
    """The line with its words split at white space and joined by one space; words that hold a digit 0-9 become one symbol. Null stays null."""
    c = F.col(line) if isinstance(line, str) else line
    words = F.regexp_replace(F.translate(c, SPACE, " " * len(SPACE)), _DIGIT_WORD, "\u0001")
    return F.trim(F.regexp_replace(words, "  +", " "))


_ROWS = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("edge", T.IntegerType()),
        T.StructField("stream", T.LongType()),
        T.StructField("event", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("first_ns", T.LongType()),
        T.StructField("last_ns", T.LongType()),
        T.StructField("n", T.LongType()),
    ]
)
_ARROW = pa.schema([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64()) for f in _ROWS.fields])
#: Edges: a run inside a piece, the first run of a piece, the last one, the only one.
INSIDE, FIRST, LAST, ONLY = 0, 1, 2, 3


def _spans(stream: np.ndarray, ns: np.ndarray, event: np.ndarray, null: np.ndarray, gap_ns: int) -> list[tuple[int, int]]:
    """Spans [from, to) of the runs of these neighbours; a null event is in no span."""
    n = len(stream)
    if not n:
        return []
    new_stream = np.empty(n, bool)
    new_stream[0] = False
    new_stream[1:] = stream[1:] != stream[:-1]
    far = np.zeros(n, bool)
    far[1:] = ns[1:] - ns[:-1] > gap_ns
    cut = new_stream | far
    _, code = np.unique(event, return_inverse=True)
    # Code points above the separator and outside the surrogates.
    code = code.astype(np.uint32) + 32
    code[code >= 0xD800] += 0x800
    code[null] = ord(_SEPARATOR)
    at = np.arange(n) + np.cumsum(cut)
    text = np.full(at[-1] + 1, ord(_SEPARATOR), np.uint32)
    text[at] = code
    row_of = np.full(len(text) + 1, n)
    row_of[at] = np.arange(n)
    return [(int(row_of[m.start()]), int(row_of[m.end() - 1]) + 1) for m in _RUN.finditer(text.tobytes().decode("utf-32-le"))]


def _fold(min_rows: int, gap_ns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        # The run that the last batch ended with; whether a run has been closed in this piece.
        open_run: list | None = None
        opened = False
        kept_edge = False
        rows = 0
        pending = False  # a null line or another break stands between open_run and what follows

        def close(edge: int) -> list | None:
            nonlocal open_run, opened, kept_edge
            r, open_run = open_run, None
            if r is None:
                return None
            if not opened:
                opened = True
                edge |= FIRST
            kept_edge |= edge != INSIDE
            return [piece, edge, *r] if edge or r[6] >= min_rows else None

        for b in batches:
            stream, ns, ids, event = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3))
            null = b.column(4).to_numpy(zero_copy_only=False)
            out: list[list] = []
            end, rows = 0, rows + len(stream)
            for lo, hi in _spans(stream, ns, event, null, gap_ns):
                pending |= lo > end
                end = hi
                r = [int(stream[lo]), int(event[lo]), int(ids[lo]), int(ids[hi - 1]), int(ns[lo]), int(ns[hi - 1]), hi - lo]
                o = open_run
                if o is not None and not pending and lo == 0 and o[0] == r[0] and o[1] == r[1] and r[4] - o[5] <= gap_ns:
                    o[3], o[5], o[6] = r[3], r[5], o[6] + r[6]
                    continue
                if (closed := close(INSIDE)) is not None:
                    out.append(closed)
                if pending and not opened:
                    opened = True  # a null line comes first: no run reaches back over this piece's start
                open_run, pending = r, False
            pending |= end < len(stream)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        closed = close(INSIDE if pending else LAST)
        if closed is None and rows and not kept_edge:
            closed = [piece, ONLY, 0, 0, 0, 0, 0, 0, 0]  # no run reaches over this piece
        if closed is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed, _ARROW.types, strict=True)], schema=_ARROW)

    return run


def collapse_runs(
    df: DataFrame, id_col: str = "entry_id", ts_col: str = "ts_ns", line_col: str = "line", labels_col: str = "labels", min_rows: int = 4, gap_s: float = 300
) -> DataFrame:
    """One row for each run of at least min_rows rows: first_id, last_id, first_ns, last_ns, n, duration_ns, stream, event.

    Rows of a stream (one set of label pairs; null labels are the empty set) are ordered by time, then id. Neighbours are like when
    their lines agree word for word, words with a digit counting as equal, and they are at most gap_s apart. A null line belongs
    to no run and ends one; empty and blank lines are like each other. Rows without a time or id are left out. Repeated rows count. Whole
    lines count, of any length. An empty table gives no runs; other columns are ignored.

    Lines are compared by a 64-bit hash of their canonical event: two different neighbours are taken for alike once in 2**64 pairs. Streams may
    hold any share of the rows: pieces of the range-partitioned order are folded independently, and a run that crosses pieces is joined from
    the two edge runs that each piece keeps, a table of at most two rows per piece.
    """
    rows = narrow(df, id=id_col, ns=ts_col, line=line_col, labels=labels_col).where("ns is not null and id is not null").select(
        stream_key("labels").alias("stream"),
        F.col("ns").cast("long"),
        F.col("id").cast("long"),
        F.xxhash64(canonical_event("line")).alias("event"),
        F.col("line").isNull().alias("none"),
    )
    gap_ns = int(gap_s * 1_000_000_000)
    # Narrow rows are written before they are put in order, so that the sampling of the ranges doesn't make all events canonical a second time.
    keyed = materialize(rows)
    # Long runs and edges only, a small table; written, as it is read twice.
    folded = materialize(ordered_pieces(keyed, "stream", "ns", "id", "event").mapInArrow(_fold(min_rows, gap_ns), _ROWS))
    release(keyed)
    inside = F.col("edge") == INSIDE
    # The edges of all pieces in order: at most two rows for each piece, so one task holds them.
    order = Window.orderBy("piece", "edge", "first_ns")
    prev = lambda c: F.lag(c).over(order)
    joins = (
        prev("edge").isin(LAST, ONLY) & F.col("edge").isin(FIRST, ONLY) & (prev("stream") == F.col("stream")) & (prev("event") == F.col("event"))
        & (prev("piece") < F.col("piece")) & (prev("n") > 0) & (F.col("n") > 0) & (F.col("first_ns") - prev("last_ns") <= gap_ns)
    )
    edges = folded.where(~inside).withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order))
    joined = edges.groupBy("chain").agg(
        F.first("stream").alias("stream"), F.first("event").alias("event"),
        F.min_by("first_id", F.struct("piece", "edge")).alias("first_id"), F.max_by("last_id", F.struct("piece", "edge")).alias("last_id"),
        F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.sum("n").alias("n"),
    ).where(F.col("n") >= min_rows)
    cols = ["first_id", "last_id", "first_ns", "last_ns", "n", "stream", "event"]
    return folded.where(inside).select(*cols).unionByName(joined.select(*cols)).withColumn("duration_ns", F.col("last_ns") - F.col("first_ns"))
