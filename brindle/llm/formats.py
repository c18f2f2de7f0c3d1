"""Duplicates hidden by formatting: records equal but for white space, letter case, punctuation or field order.

Columns are dictionary-encoded: rows are folded to their distinct values, each is made canonical once and split into fields, and every field
value gets an integer identifier (128 bits of a hash, so that no table of identifiers has to be joined, hot values or not). A record becomes the
sorted tuple of its field-value integers, and the compact tuples are grouped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import materialize, narrow

#: The marks that writings of one query differ in, besides white space and letter case.
MARKS = "\"`',;"
_IGNORED = re.compile(rf"[\s\x1c-\x1f{MARKS}]+")
_STRING = r'"(?:[^"\\]|\\.)*"|`[^`]*`|' + r"'(?:[^'\\]|\\.)*'"
_BLOCK = re.compile(rf"(?P<string>{_STRING})|(?P<braces>\{{(?P<matchers>(?:{_STRING}|[^}}])*)\}})|(?<![\w:.])(?P<word>by|without)\s*\((?P<labels>[^()]*)\)", re.IGNORECASE | re.DOTALL)
_MATCHER = re.compile(rf"\s*(?P<all>[^\s=!~,{{}}{MARKS}]+\s*(?:=~|!~|!=|=)\s*(?:{_STRING}|[^\s,}}]+))\s*,?\s*", re.DOTALL)
_PART = re.compile(rf"(?:{_STRING}|[^,])+", re.DOTALL)


def plain(text: str) -> str:
    """text without white space and marks, in lower case."""
    return _IGNORED.sub("", text.lower())


def _matchers(inner: str) -> list[str]:
    at, found = 0, []
    while at < len(inner):
        m = _MATCHER.match(inner, at)
        if m is None:
            return [p for x in _PART.findall(inner) if (p := plain(x))]
        found.append(plain(m["all"]))
        at = m.end()
    return found


def query_fields(text: str) -> list[str]:
    """Fields of a query: its text with empty {} and by/without lists, and each matcher and label with the number of its list.

    Two queries have the same fields, in any order, just when they differ only in what is ignored: letter case, white space (also within
    strings), marks, the order of matchers within {} and of labels within by/without ().
    """
    rest: list[str] = []
    fields: list[str] = []
    at = lists = 0
    for m in _BLOCK.finditer(text):
        rest.append(plain(text[at : m.start()]))
        at = m.end()
        if m["string"] is not None:
            rest.append(plain(m["string"]))
            continue
        lists += 1
        if m["braces"] is not None:
            rest.append("{}")
            fields += [f"{lists}\0{x}" for x in _matchers(m["matchers"])]
        else:
            rest.append(m["word"].lower() + "()")
            fields += [f"{lists}\0{p}" for x in re.split(r"[,\s]+", m["labels"]) if (p := plain(x))]
    rest.append(plain(text[at:]))
    return ["\0" + "".join(rest), *fields]


def record_code(fields: list[str]) -> list[int]:
    """The sorted field-value identifiers of a record, 128 bits each, as pairs of 64-bit integers: what is alike is alike in all of its 128 bits."""
    out: list[int] = []
    for v in sorted(xxhash.xxh3_128_intdigest(f.encode("utf-8", "surrogatepass")) for f in fields):
        out += [x - (1 << 64) if x >> 63 else x for x in (v >> 64, v & (1 << 64) - 1)]
    return out


def _coder(fields_of: Callable[[str], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = pa.array([record_code(fields_of(v)) for v in b.column(0).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([code, *b.columns[1:]], ["code", *b.schema.names[1:]])

    return run


def _dictionary(values: DataFrame, fields_of: Callable[[str], list[str]]) -> DataFrame:
    """values (one row for each distinct text, in the first column) with the text rewritten as its code."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema.fields[1:])
    return values.mapInArrow(_coder(fields_of), f"code array<bigint>, {kept}")


def collapse_formats(df: DataFrame, id_col: str = "query_id", text_col: str = "query_text", count_col: str = "exec_count", fields_of: Callable[[str], list[str]] = query_fields) -> DataFrame:
    """One row for each record: first_id (the smallest id of its copies), copies, total (sum of count_col, null where all are null), n_fields.

    Null texts are no records and are left out; empty and blank texts are copies of each other. Rows repeated with the same id count
    as copies each. Whole texts count. Extra columns are ignored. An empty table gives no rows. A hot record costs one row per
    input partition, as copies are pre-aggregated, by text first and by code then.
    """
    src = narrow(df, text=text_col, id=id_col, n=count_col).where("text is not null")
    values = src.groupBy("text").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.sum("n").alias("total"))
    coded = _dictionary(values, fields_of)
    grouped = coded.groupBy("code").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"), F.sum("total").alias("total"))
    return grouped.select("first_id", "copies", "total", F.expr("size(code) div 2").cast("int").alias("n_fields"))


def format_copies(df: DataFrame, id_col: str = "query_id", text_col: str = "query_text", fields_of: Callable[[str], list[str]] = query_fields) -> DataFrame:
    """first_id, id: every copy of a record but the one with the smallest id. Cases as in collapse_formats.

    Each distinct text is made canonical once. Texts of one row, which are most, are settled in the dictionary; the rows of the others
    meet it by 128 bits of their text's hash.
    """
    src = narrow(df, text=text_col, id=id_col).where("text is not null")
    # The text itself is shuffled once; what is written is narrow.
    values = src.groupBy("text").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    coded = materialize(_dictionary(values, fields_of))
    groups = coded.groupBy("code").agg(F.min("own").alias("first_id"), F.count(F.lit(1)).alias("texts"), F.max("n").alias("most")).where("texts > 1 or most > 1").select("code", "first_id")
    found = coded.join(groups, "code").select("h1", "h2", "own", "n", "first_id")
    single = found.where("n = 1").select("first_id", F.col("own").alias("id"))
    # A text with many rows: its side is split by adaptive skew handling, as the dictionary's one row can go to every part.
    rows = src.select("id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    several = rows.join(found.where("n > 1").select("h1", "h2", "first_id"), ["h1", "h2"]).select("first_id", "id")
    return single.unionByName(several).where(F.col("id") > F.col("first_id"))
