"""Most frequent items of a column in memory that doesn't grow with the number of distinct values.

Code-based identification. Each value has a 64-bit fingerprint. Values are hashed to groups; a fingerprint is written as two
Reed-Solomon code words over GF(16), 12 symbols each (8 of data, 4 of parity), and every task counts symbols per group
and position: a fixed number of counters, whatever the data hold. A value on a share of at least `share` of the rows lifts its symbol
over the threshold at all 24 positions of its group, so the symbols over the threshold, a bounded number, are all that is
needed to decode every such value; the parity symbols reject mixtures of several values. A second pass counts the decoded candidates exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.session import materialize, reaches, release

DATA, PARITY = 8, 4
WORD = DATA + PARITY
POSITIONS = 2 * WORD
SYMBOLS = 16
CELLS = POSITIONS * SYMBOLS
#: A group whose lists of heavy symbols allow more data words than this is hashed again into finer groups.
MAX_WORDS = 200_000
#: Candidates that stand in the plan of the exact pass; more come as a table.
FEW = 2_000


@lru_cache(maxsize=1)
def _field() -> tuple[np.ndarray, np.ndarray]:
    """Multiplication table of GF(16) by x^4 + x + 1, and the PARITY x DATA matrix of a systematic Reed-Solomon code."""
    exp = [1]
    for _ in range(14):
        v = exp[-1] << 1
        exp.append(v ^ 0x13 if v & 0x10 else v)
    log = {v: i for i, v in enumerate(exp)}
    mul = np.zeros((16, 16), np.uint8)
    for a in range(1, 16):
        for b in range(1, 16):
            mul[a, b] = exp[(log[a] + log[b]) % 15]
    inv = [0, *(exp[-log[a] % 15] for a in range(1, 16))]
    # Cauchy matrix: every square part of it can be inverted, so any DATA symbols of a word fix the word.
    matrix = np.array([[inv[j ^ (PARITY + i)] for i in range(DATA)] for j in range(PARITY)], np.uint8)
    return mul, matrix


def encode(data: np.ndarray) -> np.ndarray:
    """Code words (n x WORD) of data words (n x DATA) of 4-bit symbols."""
    mul, matrix = _field()
    parity = [np.bitwise_xor.reduce(mul[matrix[j], data], axis=1) for j in range(PARITY)]
    return np.concatenate([data, np.stack(parity, axis=1)], axis=1)


def symbols(fingerprints: np.ndarray) -> np.ndarray:
    """The POSITIONS symbols of each 64-bit fingerprint."""
    u = fingerprints.view(np.uint64)
    nibbles = np.stack([(u >> np.uint64(4 * k)).astype(np.uint8) & 15 for k in range(16)], axis=1)
    return np.concatenate([encode(nibbles[:, :DATA]), encode(nibbles[:, DATA:])], axis=1)


def decode(heavy: dict[int, list[list[int]]]) -> tuple[list[int], list[int]]:
    """(fingerprints, crowded groups) of the heavy symbols of each group: POSITIONS lists per group."""
    found: list[int] = []
    crowded: list[int] = []
    for g, lists in heavy.items():
        if any(not x for x in lists):
            continue
        words = []
        for k in (0, WORD):
            part = lists[k : k + DATA]
            if np.prod([len(x) for x in part], dtype=float) > MAX_WORDS:
                crowded.append(g)
                break
            coded = encode(np.array(list(product(*part)), np.uint8))
            ok = np.ones(len(coded), bool)
            for j in range(DATA, WORD):
                ok &= np.isin(coded[:, j], lists[k + j])
            words.append([sum(int(x) << 4 * i for i, x in enumerate(w[:DATA])) for w in coded[ok]])
        else:
            if len(words[0]) * len(words[1]) > MAX_WORDS:
                crowded.append(g)
            else:
                found += [lo | hi << 32 for lo in words[0] for hi in words[1]]
    return [f - 2**64 if f >= 2**63 else f for f in found], crowded


def _sketch(kinds: int, groups: int):
    """Counters of a task: rows of kind, cell, n; the cell -1 counts all rows. Columns: a fingerprint for each kind, then the group of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((kinds, groups * CELLS), np.int64)
        rows = 0
        place = np.arange(POSITIONS) * SYMBOLS
        for b in batches:
            rows += b.num_rows
            for k in range(kinds):
                # A null group: the item is null, or has been decided in a pass before.
                here = b.column(kinds + k).is_valid()
                f = b.column(k).filter(here).to_numpy(zero_copy_only=False)
                if len(f):
                    group = b.column(kinds + k).filter(here).to_numpy(zero_copy_only=False).astype(np.int64)
                    f, first, n = np.unique(f, return_index=True, return_counts=True)
                    cell = group[first][:, None] * CELLS + place + symbols(f)
                    counts[k] += np.bincount(cell.ravel(), np.repeat(n, POSITIONS), groups * CELLS).astype(np.int64)
        for k in range(kinds):
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1)), pa.array(np.append(counts[k][at], rows))], ["kind", "cell", "n"])

    return run


def _group(print_col: str, groups: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(print_col), F.lit(seed)), F.lit(groups)).cast("int")


@dataclass
class Candidates:
    """found: fingerprints that may reach the share, by kind. crowded: kind -> (groups, seed, numbers) of the groups that were not decoded; total: all rows."""

    found: list[set[int]]
    crowded: dict[int, tuple[int, int, list[int]]]
    total: int


def candidates(prints: DataFrame, kinds: int, share: float, memory_mb: int = 64, passes: int = 3) -> Candidates:
    """What may be on a share of the rows. prints: one bigint column f0, f1, ... for each kind.

    Every value that reaches the share is among found or in a crowded group. A pass has as many groups as the share calls for, at most
    those whose counters fill memory_mb; groups that stay crowded are hashed again into other groups, passes times in all.
    """
    room = max(1, memory_mb * 2**20 // (8 * CELLS * kinds))
    groups = min(room, max(256, math.ceil(1.25 / share)))
    out = Candidates([set() for _ in range(kinds)], {}, 0)
    for seed in range(passes):
        only = out.crowded
        cols = [F.col(f"f{k}") for k in range(kinds)]
        for k in range(kinds):
            g = F.when(F.col(f"f{k}").isNotNull(), _group(f"f{k}", groups, seed))
            if seed:
                g = F.when(_group(f"f{k}", *only[k][:2]).isin(only[k][2]), g) if k in only else F.lit(None).cast("int")
            cols.append(g.alias(f"g{k}"))
        # A bounded table, of kinds x groups x CELLS counters at most; written, as it is read twice.
        cells = materialize(prints.select(*cols).mapInArrow(_sketch(kinds, groups), "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")))
        out.total = cells.where("cell = -1").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        # At most POSITIONS / share rows for each kind and group: symbols of a group sum to at most the rows.
        heavy = cells.where((F.col("cell") >= 0) & reaches(F.col("n"), out.total, share)).collect()
        release(cells)
        by_group: dict[int, dict[int, list[list[int]]]] = {}
        for kind, cell, _ in heavy:
            g, at = divmod(cell, CELLS)
            by_group.setdefault(kind, {}).setdefault(g, [[] for _ in range(POSITIONS)])[at // SYMBOLS].append(at % SYMBOLS)
        out.crowded = {}
        for k, lists in by_group.items():
            good, crowded = decode(lists)
            out.found[k] |= set(good)
            if crowded:
                out.crowded[k] = (groups, seed, crowded)
        if not out.crowded:
            break
        # What is left is a part of the items, so that as many groups as memory holds are the finest there can be.
        groups = min(room, 2 * groups)
    return out


def frequent_items(df: DataFrame, items: Mapping[str, Column], share: float = 0.005, memory_mb: int = 64) -> DataFrame:
    """Values on at least `share` of all rows, of several columns at once: kind, item_text, n_rows, all_rows; counts are exact.

    items: kind -> string column over df. Null and empty values are no items, but their rows count in all_rows; so do repeated rows. Ties
    at the threshold are all in. An empty table gives no rows. share: any decimal number of at most 15 places. memory_mb: counters of a task, 384 for each
    kind and group; groups are 1.25 for each value that the share has room for, at least 256, and no more than fit.
    Every value that reaches the share is found: its counters are sums that include all its rows, so they reach the threshold too. Items of groups that
    are too crowded to decode after several passes (very small shares in little memory) are counted one by one in the exact pass instead.
    """
    values = [F.when(c != "", c) for c in items.values()]
    prints = df.select(*[F.when(v.isNotNull(), F.xxhash64(v)).alias(f"f{k}") for k, v in enumerate(values)])
    c = candidates(prints, len(items), share, memory_mb)
    # One pass counts the candidates of all kinds.
    base = df.select(*[v.alias(f"v{k}") for k, v in enumerate(values)]).select("*", *[F.xxhash64(f"v{k}").alias(f"f{k}") for k in range(len(values))])
    few = sum(map(len, c.found)) <= FEW
    if not few:
        # At most 1 / share values for each kind, by a join instead of in the plan.
        for k, found in enumerate(c.found):
            listed = df.sparkSession.createDataFrame(pa.table({f"f{k}": pa.array(sorted(found), pa.int64()), f"is{k}": pa.array([True] * len(found))}))
            base = base.join(F.broadcast(listed), f"f{k}", "left")
    wanted = []
    for k, kind in enumerate(items):
        asked = F.coalesce(f"is{k}", F.lit(False)) if not few else F.col(f"f{k}").isin(sorted(c.found[k])) if c.found[k] else F.lit(False)
        if k in c.crowded:
            groups, seed, members = c.crowded[k]
            asked = asked | _group(f"f{k}", groups, seed).isin(members)
        wanted.append(F.struct(F.lit(kind).alias("kind"), F.when(asked, F.col(f"v{k}")).alias("item_text")))
    counted = base.select(F.inline(F.array(*wanted))).where(F.col("item_text").isNotNull()).groupBy("kind", "item_text").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(reaches(F.col("n_rows"), c.total, share)).select("kind", "item_text", "n_rows", F.lit(c.total).cast("long").alias("all_rows"))
