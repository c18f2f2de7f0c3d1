"""Encoding of texts with a public byte-level BPE tokenizer.

The vocabulary is a file of ranks, read once on the driver and broadcast (tens of thousands of short byte strings, whatever the corpus). A
text is split by the tokenizer's pattern; each word not met before is merged over a contiguous array of part boundaries and ranks of
adjacent parts: find the smallest rank, delete a boundary, refresh the two ranks beside it.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.session import narrow

#: Where the public vocabularies lie; a parameter of every function that reads one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of at most this many bytes are merged over the array; longer ones over a heap, which takes no quadratic time.
SHORT = 96
#: Words that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 200_000
_NONE = 1 << 40


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Byte string -> rank, of a file with a base64 string and a rank on each line."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a word by repeated scans of its array of ranks."""
    get = ranks.get
    bound = list(range(len(word) + 1))
    # rank[i]: of the two parts that begin at bound[i] and bound[i + 1], joined.
    rank = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while rank:
        low = min(rank)
        if low == _NONE:
            break
        i = rank.index(low)
        del bound[i + 1], rank[i]
        if i < len(rank):
            rank[i] = get(word[bound[i] : bound[i + 2]], _NONE)
        if i:
            rank[i - 1] = get(word[bound[i - 1] : bound[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:], strict=False)]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of ranks and linked parts: n log n for a word of n bytes."""
    get = ranks.get
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """encode(text) -> ids. A null or empty text gives no ids; strings of special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple((merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks))
        if len(raw) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known, word = self.known.get, self.word
            for w in self.split(text):
                out += known(w) or word(w)
        return out


def _encoding(ranks, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in batches:
            ids = map(encoder.encode, b.column(0).to_pylist())
            if count_only:
                first = pa.array([len(x) for x in ids], pa.int64())
            else:
                parts = [np.array(x, np.int32) for x in ids]
                offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                first = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([first, *b.columns[1:]], ["out", *b.schema.names[1:]])

    return run


def _with_encoding(df: DataFrame, text_col: str, keep: dict[str, str], name: str, kind: T.DataType, path: str) -> DataFrame:
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    src = narrow(df, __text=text_col, **{f"__{k}": c for k, c in enumerate(keep.values())}).withColumn("__text", F.col("__text").cast("string"))
    schema = T.StructType([T.StructField("__out", kind), *src.schema.fields[1:]])
    coded = src.mapInArrow(_encoding(ranks, isinstance(kind, T.LongType)), schema)
    return coded.select(*[F.col(f"__{k}").alias(n) for k, n in enumerate(keep)], F.col("__out").alias(name))


def encode_texts(df: DataFrame, text_col: str = "text", keep: dict[str, str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """The columns of keep (new name -> name in df; doc_id by default) and ids, the token ids of each row's text.

    One row for each row, repeated ones too. A null or empty text gives an empty list. Whole texts are encoded, of any length, without special tokens.
    No shuffle: every row is encoded where it is read.
    """
    return _with_encoding(df, text_col, keep or {"doc_id": "doc_id"}, "ids", T.ArrayType(T.IntegerType()), path)


def count_tokens(df: DataFrame, text_col: str, keep: dict[str, str], path: str = VOCABULARY) -> DataFrame:
    """The columns of keep and n_tokens of each row's text, 0 for a null or empty one."""
    return _with_encoding(df, text_col, keep, "n_tokens", T.LongType(), path)
