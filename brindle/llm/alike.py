"""Near-duplicates with small edits: all pairs of word sets that share enough, without comparing all pairs.

T-occurrence search over inverted lists by DivideSkip. Two sets with a similarity of at least t share at least T = ceil(t * size) words of either.
A set's L longest lists are set aside; every partner stands at least k = T - L times in the short lists that remain, those of its rarest
words. Short lists are spread over tasks by word and merged there with the number of occurrences; lengths, the words' places in the order and a
bit signature of fixed size bound the overlap from above before a pair leaves its task. The occurrences of a pair are summed
over the tasks, and pairs with fewer than k fall out. What is left is probed by binary search in the other set's words. Equal sets
are folded to one representative before anything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import materialize, narrow, release

#: Counters of the word-frequency sketch that orders words; the order may be any, the sketch makes it nearly rarest first.
ORDER_CELLS = 1 << 16
#: Occurrences in short lists for each route: routes grow with the data, so that their size doesn't.
ROUTE_ROWS = 200_000
#: Rows of a route beyond which it is cut into blocks; every pair of blocks is a task of its own. Only lists of one hot word are as long.
BLOCK_ROWS = 100_000
#: Pairs of places that a task looks at together.
CHUNK = 1 << 20
#: Weight of the number of long lists: L = T / (MU * log2(longest list) + 1), as published for DivideSkip.
MU = 0.0085


def word_sets(df: DataFrame, id_col: str, text_col: str, min_words: int = 1) -> DataFrame:
    """id, words (sorted array of 64-bit word hashes), n, and same (a digest of the set) of each text with at least min_words words.

    Words are runs of a-z and 0-9 after lower-casing, each counted once. Texts without a word are left out, null and empty ones too, and so are rows without an id.
    """
    # A text of k different words has at least 2k - 1 characters: short ones need no splitting.
    src = narrow(df, id=id_col, t=text_col).where((F.length("t") >= 2 * min_words - 1) & F.col("id").isNotNull()).select(F.col("id").cast("long"), F.lower("t").alias("t"))
    words = F.array_distinct(F.filter(F.split("t", "[^a-z0-9]+"), lambda x: x != ""))
    sets = src.select("id", F.sort_array(F.transform(words, lambda w: F.xxhash64(w))).alias("words")).where(F.size("words") >= min_words)
    return sets.select("id", "words", F.size("words").alias("n"), F.md5(F.concat_ws(",", F.transform("words", lambda w: w.cast("string")))).alias("same"))


def representatives(sets: DataFrame) -> DataFrame:
    """One row for each different set: id (the smallest of its copies), words, n, same, copies."""
    return sets.groupBy("same").agg(F.min("id").alias("id"), F.min_by("words", "id").alias("words"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))


def _order(sets: DataFrame) -> np.ndarray:
    """Counts of words by hash cell: ORDER_CELLS numbers, whatever the number of words."""
    cells = sets.select(F.explode("words").alias("w")).groupBy(F.expr(f"cast(w & {ORDER_CELLS - 1} as int)").alias("cell")).count()
    out = np.zeros(ORDER_CELLS, np.int64)
    for cell, n in cells.collect():
        out[cell] = n
    return out


def _mix(words: np.ndarray) -> np.ndarray:
    u = words.view(np.uint64)
    with np.errstate(over="ignore"):
        u = (u ^ (u >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return u ^ (u >> np.uint64(27))


def needed(n: int, num: int, den: int, log_longest: float) -> int:
    """k = T - L: how often a partner of a set of n words stands in its short lists at least."""
    t = -(-num * n // den)
    return t - min(t - 1, int(t / (MU * log_longest + 1)))


def _router(order, routes: int, bits: int, num: int, den: int):
    """Rows of each set for the tasks of its short lists: route, id, n, k, sig, and the words of the lists with their places in the set's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        log_longest = math.log2(max(2, int(counts.max())))
        for b in batches:
            out: list[tuple] = []
            words, starts = b.column(1).flatten().to_numpy(), b.column(1).offsets.to_numpy()
            mixed = _mix(words)
            rank = counts[words & (ORDER_CELLS - 1)]
            bit = (mixed & np.uint64(bits - 1)).astype(np.int64)
            route = ((mixed >> np.uint64(20)) % np.uint64(routes)).astype(np.int64)
            for m, i in enumerate(b.column(0).to_pylist()):
                lo, hi = starts[m] - starts[0], starts[m + 1] - starts[0]
                n = int(hi - lo)
                sig = np.zeros(bits // 8, np.uint8)
                np.bitwise_or.at(sig, bit[lo:hi] >> 3, (1 << (bit[lo:hi] & 7)).astype(np.uint8))
                k = needed(n, num, den, log_longest)
                by_rank = np.lexsort((words[lo:hi], rank[lo:hi]))[: n - -(-num * n // den) + k] + lo
                raw = sig.tobytes()
                at = route[by_rank]
                by_route = np.argsort(at, kind="stable")
                cuts = np.flatnonzero(np.diff(at[by_route])) + 1
                for places in np.split(by_route, cuts):
                    out.append((int(at[places[0]]), i, n, k, raw, words[by_rank[places]], places))
            if out:
                r, i, n, k, s, w, p = zip(*out, strict=True)
                sizes = pa.array(np.cumsum([0, *map(len, w)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(w)))
                places = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(p).astype(np.int32)))
                cols = [pa.array(r, pa.int32()), pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(s, pa.binary()), lists, places]
                yield pa.RecordBatch.from_arrays(cols, ["route", "id", "n", "k", "sig", "lists", "places"])

    return run


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a column of lists."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _merge(num: int, den: int):
    """Merge of the short lists of one route (or pair of its blocks): pairs of sets with the number of lists that hold both, and the number they need."""

    def run(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy().astype(np.int64)
        order = np.argsort(n, kind="stable")
        t, n = t.take(pa.array(order)), n[order]
        ids, k, block = t["id"].to_numpy(), t["k"].to_numpy(), t["block"].to_numpy()
        across = len(np.unique(block)) > 1
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(len(n), -1)
        flat, sizes = _flat(t["lists"])
        place = _flat(t["places"])[0].astype(np.int64)
        _, word = np.unique(flat, return_inverse=True)
        doc = np.repeat(np.arange(len(n)), sizes)
        # Lists one after another, each in the order of its documents, which is that of their sizes.
        by_list = np.lexsort((doc, word))
        doc, place = doc[by_list], place[by_list]
        key = word[by_list] * (len(n) + 1) + doc
        # Partners of a document stand before it in the list; the smallest that can share enough has ceil(t * n) words.
        least = np.searchsorted(n, -(-num * n // den))
        low = np.searchsorted(key, key - doc + np.minimum(least[doc], doc))
        many = np.arange(len(doc)) - low
        ends = np.cumsum(many)
        pairs, times = [], []
        a = 0
        while a < len(doc):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
            of = np.repeat(np.arange(a, b), many[a:b])
            with_ = np.arange(len(of)) - np.repeat(ends[a:b] - many[a:b] - done, many[a:b]) + low[of]
            q, p, x, y = doc[of], doc[with_], place[of], place[with_]
            # What both can have in common before, at and after these places has to be enough.
            most = np.minimum(x, y) + 1 + np.minimum(n[q] - x, n[p] - y) - 1
            keep = most * (num + den) >= num * (n[q] + n[p])
            if across:
                keep &= block[q] != block[p]
            pair, c = np.unique(q[keep] * len(n) + p[keep], return_counts=True)
            q, p = np.divmod(pair, len(n))
            differ = np.concatenate([np.bitwise_count(sig[q[z : z + CHUNK // 16]] ^ sig[p[z : z + CHUNK // 16]]).sum(axis=1, dtype=np.int64) for z in range(0, max(len(q), 1), CHUNK // 16)])
            near = differ * (num + den) <= (den - num) * (n[q] + n[p])
            pairs.append(pair[near])
            times.append(c[near])
            a = b
        pair, at = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
        c = np.bincount(at, np.concatenate(times), len(pair)).astype(np.int32) if pairs else np.empty(0, np.int32)
        q, p = np.divmod(pair, len(n)) if len(n) else (pair, pair)
        return pa.table({"id_a": np.minimum(ids[q], ids[p]), "id_b": np.maximum(ids[q], ids[p]), "times": c, "need": np.minimum(k[q], k[p])})

    return run


def _probe(num: int, den: int):
    """Exact overlap by binary search of one sorted set's words in the other; keeps the pairs that share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            shared = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                o = int((y[at] == x).sum()) if len(y) else 0
                keep.append(o * den >= num * (len(x) + len(y) - o))
                shared.append(o)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.int32())], ["id_a", "id_b", "shared"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def similar_sets(reps: DataFrame, percent: int) -> DataFrame:
    """id_a < id_b, shared: all pairs of different sets whose words in both are at least percent% of the words in either.

    reps: id (unique), words, n, as representatives() gives, materialized (it is read several times).
    """
    spark = reps.sparkSession
    num, den = percent, 100
    order = _order(reps)
    total, words = reps.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 128
    while bits < 1024 and bits < 3 * words / max(total, 1):
        bits *= 2
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    routes = max(tasks, (words * (den - num) // den + total) // ROUTE_ROWS)
    columns = "route int, id bigint, n int, k int, sig binary, lists array<bigint>, places array<int>"
    rows = materialize(reps.select("id", "words").mapInArrow(_router(spark.sparkContext.broadcast(order), routes, bits, num, den), columns))
    # A row for each route that is cut: there are at most as many as BLOCK_ROWS goes into the rows.
    cuts = rows.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("cut")).where("cut > 1")
    block = F.pmod(F.xxhash64("id"), F.coalesce("cut", F.lit(1)))
    placed = (
        rows.join(F.broadcast(cuts), "route", "left")
        .withColumn("block", block.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("cut", F.lit(1)) - 1)))
        .withColumn("x", F.least("block", "other"))
        .withColumn("y", F.greatest("block", "other"))
    )
    # As many tasks as there are now, however few bytes they read: the work grows faster than the bytes.
    merged = placed.repartition(tasks, "route", "x", "y").groupBy("route", "x", "y").applyInArrow(_merge(num, den), "id_a bigint, id_b bigint, times int, need int")
    found = merged.groupBy("id_a", "id_b").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need").select("id_a", "id_b")
    side = lambda s: reps.select(F.col("id").alias(f"id_{s}"), F.col("words").alias(f"words_{s}"))
    pairs = found.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", "words_a", "words_b")
    return pairs.mapInArrow(_probe(num, den), "id_a bigint, id_b bigint, shared int")


def _sets_and_links(df: DataFrame, id_col: str, text_col: str, percent: int, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    sets = materialize(word_sets(df, id_col, text_col, min_words))
    reps = materialize(representatives(sets).select("same", "id", "words", "n", "copies"))
    return sets.select("same", "id"), reps, similar_sets(reps, percent)


def like_pairs(df: DataFrame, id_col: str, text_col: str, percent: int = 70, min_words: int = 1) -> DataFrame:
    """id_a, id_b, smaller first: all pairs of rows whose word sets share at least percent%, rows with equal sets too.

    Texts with fewer than min_words different words are left out, as are null and empty texts. A row that is repeated with its id is one row.
    Ties at the threshold are in. Whole texts count. Other columns are ignored; an empty table gives no pairs. The pairs of equal
    sets are many where one text has many copies: like_groups states the same links in one row per document.
    """
    members, reps, links = _sets_and_links(df, id_col, text_col, percent, min_words)
    members = members.distinct()
    many = reps.where("copies > 1").select("same")
    side = lambda s: members.select("same", F.col("id").alias(f"id_{s}"))
    equal = side("a").join(many, "same", "left_semi").join(side("b"), "same").where("id_a < id_b").select("id_a", "id_b")
    rep_of = reps.select(F.col("id").alias("rep"), "same")
    a = members.withColumnRenamed("id", "doc_a").join(rep_of.withColumnRenamed("rep", "id_a"), "same").drop("same")
    b = members.withColumnRenamed("id", "doc_b").join(rep_of.withColumnRenamed("rep", "id_b"), "same").drop("same")
    across = links.join(a, "id_a").join(b, "id_b").select(F.least("doc_a", "doc_b").alias("id_a"), F.greatest("doc_a", "doc_b").alias("id_b"))
    return across.unionByName(equal)


def components(links: DataFrame) -> DataFrame:
    """id, root of each linked id: root is the smallest id it is connected with. links: id_a, id_b.

    Labels of neighbours and of a label's own label are taken in turn until nothing changes; each round is written to the checkpoint folder.
    """
    both = materialize(links.select("id_a", "id_b").unionByName(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).where("id_a <> id_b").distinct())
    label = materialize(both.groupBy(F.col("id_a").alias("id")).agg(F.least(F.min("id_b"), F.first("id_a")).alias("root")))
    while True:
        near = both.join(label.select(F.col("id").alias("id_b"), "root"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(near, "id").select("id", "root", F.least("root", "near").alias("next"))
        jump = step.join(label.select(F.col("id").alias("next"), F.col("root").alias("far")), "next", "left")
        new = materialize(jump.select("id", F.col("root").alias("old"), F.least("next", F.coalesce("far", "next")).alias("root")))
        release(label)
        if new.where("old <> root").isEmpty():
            release(both)
            return new.select("id", "root")
        label = new


def like_groups(df: DataFrame, id_col: str, text_col: str, percent: int = 70, min_words: int = 1) -> DataFrame:
    """One row for each document: id, class_id (smallest id with an equal set), group_id (smallest id linked to it), n_links, n_copies.

    n_links counts the different sets that the document's set is like; documents are those that like_pairs considers, single ones included.
    """
    members, reps, links = _sets_and_links(df, id_col, text_col, percent, min_words)
    links = materialize(links)
    ends = links.select(F.col("id_a").alias("class_id")).unionByName(links.select(F.col("id_b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(links).select(F.col("id").alias("class_id"), F.col("root"))
    classes = reps.select("same", F.col("id").alias("class_id"), F.col("copies").alias("n_copies")).join(ends, "class_id", "left").join(roots, "class_id", "left")
    classes = classes.select("same", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "class_id").alias("group_id"))
    return members.join(classes, "same").select("id", "class_id", "group_id", "n_links", "n_copies")
