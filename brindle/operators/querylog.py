"""What a log store's own query log says was read: requests classified, executions folded, writings and legs of one query merged."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.logql import ast
from brindle.logql.syntax import QueryFault, canonical, parse
from brindle.operators.unparsed import logfmt_cells
from brindle.session import materialize, narrow

#: Texts by which the three kinds of request are told in the log, and requests that read the index only.
TAIL_MESSAGE = "starting to tail logs"
PATTERNS_PATH = "/loki/api/v1/patterns"
INDEX_ONLY = ("labels", "series", "stats")
#: How far from its frontend query a leg may be logged.
LEG_WINDOW_NS = 120 * 10**9
PRELIMINARY = rf"caller=metrics\.go|{TAIL_MESSAGE}|path={PATTERNS_PATH} "


def selection_key(q: ast.LogQuery, counting: bool) -> str:
    """Text that is equal for selections that read the same lines in the same way."""
    rewritten = any(isinstance(s, ast.LineFormat | ast.Decolorize | ast.VariableStage) or isinstance(s, ast.Parse) and s.kind == "unpack" for s in q.stages)
    filters, open_line = [], True
    for s in q.stages:
        open_line = open_line and not (isinstance(s, ast.LineFormat | ast.Decolorize | ast.VariableStage) or isinstance(s, ast.Parse) and s.kind == "unpack")
        if isinstance(s, ast.LineFilter) and open_line:
            filters.append([s.negated, s.alternatives])
    return json.dumps([counting, rewritten, [[m.label, m.op, m.value] for m in q.matchers], filters])


def selections(text: str) -> list[str] | None:
    """Keys of a query's selections in order, None for a text that doesn't parse."""
    try:
        return [selection_key(q, c) for q, c in parse(text).logs]
    except QueryFault:
        return None


def is_probe(text: str, label: str, prefix: str) -> bool:
    """A liveness marker: every selection names the probe label with a marker value, so it reads no stream."""
    try:
        logs = parse(text).logs
    except QueryFault:
        return False
    return bool(logs) and all(any(m.label == label and m.op == "=" and m.value.startswith(prefix) for m in q.matchers) for q, _ in logs)


def _classify(own_source: str, probe_label: str, probe_prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("kind", "component", "query", "query_type", "source")}
            for line in b.column(1).to_pylist():
                keys, vals, broken = logfmt_cells(line or "")
                m = dict(zip(keys, vals, strict=True))
                row = ["other", None, None, None, None]
                if broken >= 0:
                    row[0] = "unparsed"
                elif m.get("msg") == TAIL_MESSAGE and m.get("selectors"):
                    row = ["tail", "tail", m["selectors"], "tail", None]
                elif m.get("path") == PATTERNS_PATH and m.get("param_query"):
                    row = ["patterns", "patterns", m["param_query"], "patterns", None]
                elif m.get("caller", "").startswith("metrics.go") and m.get("query"):
                    row = ["query", m.get("component", ""), m["query"], m.get("query_type", ""), m.get("source") or None]
                    if (m.get("source") or "").lower() == own_source:
                        row[0] = "own"
                    elif m.get("query_type") in INDEX_ONLY:
                        row[0] = "metadata"
                if row[0] in ("tail", "patterns", "query", "metadata") and probe_prefix in row[2] and is_probe(row[2], probe_label, probe_prefix):
                    row[0] = "own"
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.string()) for v in out.values())], ["ts_ns", *out])

    return run


def classify_requests(df: DataFrame, ts_col: str = "ts_ns", line_col: str = "line", own_source: str = "brindle", probe_label: str = "brindle_probe", probe_prefix: str = "brindle_probe_") -> DataFrame:
    """ts_ns, kind, component, query, query_type, source of each line that may be a request.

    kind: query, tail, patterns; metadata for requests that read the index only; own for the reader's requests and its markers; other; unparsed. Lines that hold
    none of the three texts are left out by a filter before any parsing; null lines too.
    """
    src = narrow(df, ts=ts_col, line=line_col).select(F.col("ts").cast("long").alias("ts_ns"), "line").where(F.col("line").rlike(PRELIMINARY))
    return src.mapInArrow(_classify(own_source, probe_label, probe_prefix), "ts_ns long, kind string, component string, query string, query_type string, source string")


def request_summary(requests: DataFrame) -> DataFrame:
    """One row: lines, unparsed, queries, tails, patterns, metadata, oldest (the first time of a request that was understood)."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    seen = F.col("kind").isin("query", "tail", "patterns", "metadata", "own")
    return requests.agg(
        F.count(F.lit(1)).alias("lines"), n("unparsed").alias("unparsed"), n("query").alias("queries"), n("tail").alias("tails"), n("patterns").alias("patterns"), n("metadata").alias("metadata"), F.min(F.when(seen, F.col("ts_ns"))).alias("oldest")
    )


def fold_executions(requests: DataFrame) -> DataFrame:
    """component, query, query_type, n, first_ns, last_ns, sources: the executions of each query text by the component that logged them."""
    used = requests.where(F.col("kind").isin("query", "tail", "patterns"))
    return used.groupBy("component", "query").agg(
        F.min_by("query_type", F.struct("ts_ns", "query_type")).alias("query_type"), F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.array_sort(F.collect_set("source")).alias("sources")
    )


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        queries = b.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([canonical(q) for q in queries], pa.string()), pa.array([selections(q) for q in queries], pa.list_(pa.string()))],
            ["query", "canonical", "selections"],
        )


def with_forms(executions: DataFrame) -> DataFrame:
    """executions with the canonical form of each query and the keys of its selections; each text is parsed once."""
    forms = executions.select("query").distinct().mapInArrow(_forms, "query string, canonical string, selections array<string>")
    return executions.join(forms, "query")


def merge_executions(executions: DataFrame) -> DataFrame:
    """query, canonical, query_type, component, n, first_ns, last_ns, sources: one row for each query.

    The frontend logs a query once, as it was sent; queriers log it again, split by time, and the ruler in its own writing. Equal canonical forms are one query, in the
    writing of the frontend if it has one, else of the first component by name, and of its first text. A leg of a frontend query adds to that query: its text stands in the
    query's, it ran within LEG_WINDOW_NS of it, and every selection of it is one of the query's. Anything else is a query of its own.
    """
    known = materialize(with_forms(executions))
    fronts = known.where((F.col("component") == "frontend") & F.col("selections").isNotNull()).select(
        F.col("query").alias("f_query"), F.col("canonical").alias("f_canonical"), F.col("selections").alias("f_selections"), F.col("first_ns").alias("f_first"), F.col("last_ns").alias("f_last")
    )
    others = known.where(~F.col("component").isin("frontend", "tail", "patterns"))
    may = others.where(F.size("selections") > 0).withColumn("sel", F.col("selections")[0])
    # Legs meet their hosts by a selection that both have, not by comparing every pair of texts.
    hosts = fronts.withColumn("sel", F.explode(F.array_distinct("f_selections")))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    legs = (
        may.join(hosts, "sel")
        .where(
            pad("f_canonical").contains(pad("canonical"))
            & (F.col("first_ns") >= F.col("f_first") - LEG_WINDOW_NS)
            & (F.col("last_ns") <= F.col("f_last") + LEG_WINDOW_NS)
            & (F.size(F.array_except("selections", "f_selections")) == 0)
        )
        .groupBy("component", "query")
        .agg(F.min_by("f_canonical", "f_query").alias("host"), F.first("n").alias("n"))
    )
    own = known.join(legs.select("component", "query"), ["component", "query"], "left_anti")
    rank = F.when(F.col("component") == "frontend", 0).when(F.col("component").isin("tail", "patterns"), 2).otherwise(1)
    first = F.struct(rank.alias("r"), F.when(rank == 1, F.col("component")).otherwise("").alias("c"), "query")
    merged = own.groupBy("canonical").agg(
        *[F.min_by(c, first).alias(c) for c in ("query", "query_type", "component", "sources")], F.sum("n").alias("n"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns")
    )
    added = legs.groupBy(F.col("host").alias("canonical")).agg(F.sum("n").alias("leg_n"))
    out = merged.join(added, "canonical", "left")
    return out.select("query", "canonical", "query_type", "component", (F.col("n") + F.coalesce("leg_n", F.lit(0))).alias("n"), "first_ns", "last_ns", "sources")
