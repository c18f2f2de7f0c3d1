"""Queries over the log and text tables for the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import alike, formats, heavy, mix, residue, runs, tokens
from brindle.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of queries in another writing, with the first of each."""
    return formats.format_copies(table(spark, d, "executed_queries")).select("first_id", F.col("id").alias("query_id"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each query: its first id, its copies and the sum of their executions."""
    return formats.collapse_formats(table(spark, d, "executed_queries")).select("first_id", "copies", "total")


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "log_entries").select("line", "labels")
    return heavy.frequent_items(entries, {"line": F.col("line"), "pod": F.col("labels")["k8s_pod_name"]}, 0.005)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines and pods on at least 0.5% of all rows."""
    return _frequent(spark, d).select("kind", "item_text")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same with their counts."""
    return _frequent(spark, d).select("kind", "item_text", "n_rows")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last row of each run of at least four like neighbours in a stream, smaller id first."""
    found = runs.collapse_runs(table(spark, d, "log_entries"))
    return found.select(F.least("first_id", "last_id").alias("id_a"), F.greatest("first_id", "last_id").alias("id_b"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs as events: first row, count and duration."""
    return runs.collapse_runs(table(spark, d, "log_entries")).select("first_id", "n", "duration_ns")


def _texts(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str, int]]:
    return [("line", table(spark, d, "log_entries"), "entry_id", "line", 80), ("template", table(spark, d, "skipped_templates"), "skip_id", "template_text", 1)]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of long lines and of templates that share at least 70% of their words."""
    lines, templates = (alike.like_pairs(df, i, t, 70, least).select(F.lit(kind).alias("kind"), "id_a", "id_b") for kind, df, i, t, least in _texts(spark, d))
    return lines.unionByName(templates)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of like ones: one row for each long line and each template."""
    lines, templates = (alike.like_groups(df, i, t, 70, least).withColumn("kind", F.lit(kind)) for kind, df, i, t, least in _texts(spark, d))
    return lines.unionByName(templates)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_texts(table(spark, d, "documents").select("doc_id", "text"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix.mix_sources(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: a row for each use of a document."""
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source reaches of its target."""
    return _mixed(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold template residue, filler, error pages or notices about scripts."""
    return residue.find_residue(table(spark, d, "documents"), language_col="lang").select(F.col("id").alias("doc_id"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The other documents, whole."""
    return residue.without_residue(table(spark, d, "documents"), language_col="lang").select("doc_id", "text")


QUERIES = {f.__name__: f for f in (p4_found, p4_records, p5_found, p5_counts, p6_found, p6_runs, p7_found, p7_groups, p8_ids, p9_mix, p9_shares, p10_found, p10_clean)}

_P4 = r"""
    WITH t AS (SELECT query_id, exec_count, lower(regexp_replace(query_text, '[\s\x0b\x{a0}"`'';]+', '', 'g')) AS q FROM executed_queries WHERE query_text IS NOT NULL),
    s AS (SELECT *, regexp_extract(q, '\{([^}]*)\}', 1) AS sel, regexp_extract(q, '(?:by|without)\(([^)]*)\)', 1) AS grp FROM t),
    k AS (SELECT query_id, exec_count,
                 replace(regexp_replace(regexp_replace(q, '\{[^}]*\}', '{}'), '(by|without)\([^)]*\)', '\1()'), ',', '')
                 || ' ' || list_aggregate(list_sort(list_filter(string_split(sel, ','), lambda x: x <> '')), 'string_agg', ' ')
                 || ' ' || coalesce(list_aggregate(list_sort(list_filter(string_split(grp, ','), lambda x: x <> '')), 'string_agg', ' '), '') AS key
          FROM s),
    g AS (SELECT key, min(query_id) AS first_id, count(*) AS copies, sum(exec_count)::BIGINT AS total FROM k GROUP BY key)
"""
_P7 = r"""
    WITH d AS (
        SELECT 'line' AS kind, entry_id AS id, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w FROM log_entries
        UNION ALL SELECT 'template', skip_id, list_distinct(regexp_extract_all(lower(template_text), '[a-z0-9]+')) FROM skipped_templates),
    f AS (SELECT kind, id, w, len(w) AS n FROM d WHERE len(w) >= CASE kind WHEN 'line' THEN 80 ELSE 1 END),
    u AS (SELECT kind, id, n, unnest(w) AS word FROM f)
    SELECT a.kind AS kind, a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.kind = b.kind AND a.word = b.word AND a.id < b.id
    GROUP BY a.kind, a.id, b.id, a.n, b.n HAVING count(*) * 10 >= 7 * (a.n + b.n - count(*))
"""
_P7_GROUPS = r"""
    WITH RECURSIVE d AS (
        SELECT 'line' AS kind, entry_id AS id, list_sort(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+'))) AS w FROM log_entries
        UNION ALL SELECT 'template', skip_id, list_sort(list_distinct(regexp_extract_all(lower(template_text), '[a-z0-9]+'))) FROM skipped_templates),
    f AS (SELECT * FROM d WHERE len(w) >= CASE kind WHEN 'line' THEN 80 ELSE 1 END),
    c AS (SELECT kind, w, len(w) AS n, min(id) AS class_id, count(*) AS n_copies FROM f GROUP BY kind, w),
    u AS (SELECT kind, class_id, n, unnest(w) AS word FROM c),
    l AS (SELECT a.kind AS kind, a.class_id AS a, b.class_id AS b FROM u a JOIN u b ON a.kind = b.kind AND a.word = b.word AND a.class_id <> b.class_id
          GROUP BY a.kind, a.class_id, b.class_id, a.n, b.n HAVING count(*) * 10 >= 7 * (a.n + b.n - count(*))),
    reach AS (SELECT kind, class_id AS start, class_id AS node FROM c UNION SELECT reach.kind, start, b FROM reach JOIN l ON reach.kind = l.kind AND node = a),
    g AS (SELECT kind, start AS class_id, min(node) AS group_id FROM reach GROUP BY 1, 2),
    k AS (SELECT kind, a AS class_id, count(*) AS n_links FROM l GROUP BY 1, 2)
    SELECT f.kind AS kind, id, c.class_id AS class_id, group_id, coalesce(n_links, 0) AS n_links, n_copies
    FROM f JOIN c ON f.kind = c.kind AND f.w = c.w JOIN g ON g.kind = c.kind AND g.class_id = c.class_id LEFT JOIN k ON k.kind = c.kind AND k.class_id = c.class_id
"""
_P5 = """
    SELECT kind, item_text, count(*) AS n_rows FROM (
        SELECT 'line' AS kind, line AS item_text FROM log_entries UNION ALL SELECT 'pod', labels['k8s_pod_name'] FROM log_entries)
    WHERE item_text <> '' GROUP BY ALL HAVING count(*) * 200 >= (SELECT count(*) FROM log_entries)
"""
_P6 = r"""
    WITH rows AS (
        SELECT entry_id, ts_ns, line, list_sort(map_entries(coalesce(labels, MAP {}))) AS stream,
               trim(regexp_replace(regexp_replace(' ' || regexp_replace(line, '[\s\x0b\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '  ', 'g') || ' ', ' [^ ]*[0-9][^ ]* ', ' # ', 'g'), ' +', ' ', 'g')) AS event
        FROM log_entries),
    marked AS (
        SELECT *, CASE WHEN event IS NOT NULL AND event = lag(event) OVER w AND ts_ns - lag(ts_ns) OVER w <= 300000000000 THEN 0 ELSE 1 END AS new
        FROM rows WINDOW w AS (PARTITION BY stream ORDER BY ts_ns, entry_id)),
    chained AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY ts_ns, entry_id) AS chain FROM marked),
    found AS (
        SELECT arg_min(entry_id, (ts_ns, entry_id)) AS a, arg_max(entry_id, (ts_ns, entry_id)) AS b, count(*) AS n, max(ts_ns) - min(ts_ns) AS duration_ns
        FROM chained WHERE event IS NOT NULL GROUP BY stream, chain HAVING count(*) >= 4)
"""

SQL = {
    "p4_found": _P4 + "SELECT first_id, query_id FROM k JOIN g USING (key) WHERE query_id > first_id",
    "p4_records": _P4 + "SELECT first_id, copies, total FROM g",
    "p7_found": _P7,
    "p7_groups": _P7_GROUPS,
    "p5_found": f"SELECT kind, item_text FROM ({_P5})",
    "p5_counts": _P5,
    "p6_found": _P6 + "SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM found",
    "p6_runs": _P6 + "SELECT a AS first_id, n, duration_ns FROM found",
}
