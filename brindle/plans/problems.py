"""Queries over the log tables for the operators of the core: rejected rows, headers and records, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import layouts, skew, unparsed
from brindle.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """line_id of each query_log row that fails a rule."""
    return unparsed.find_errors(table(spark, d, "query_log"), "line_id", "line", details=False).select(F.col("row_id").alias("line_id"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Failing rows by reason and column, the count of lines for each."""
    errors = unparsed.find_errors(table(spark, d, "query_log"), "line_id", "line", details=False).select("row_id", F.inline("reasons"))
    return errors.groupBy("reason", "column").agg(F.count_distinct("row_id").alias("n_lines"))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The rows that load, with the fields asked of every line."""
    loaded, _ = unparsed.split_unparsed(table(spark, d, "query_log"))
    return loaded.select("line_id", "ts_ns", "line")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of log_entries that begin a record, with time, level and component."""
    return layouts.found_headers(table(spark, d, "log_entries"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """Whole records: headers with the lines that continue them."""
    return layouts.assemble_records(table(spark, d, "log_entries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Services on at least 5% of the rows of either table."""
    entries = table(spark, d, "log_entries").select("labels")
    candidates = table(spark, d, "candidates").select("service")
    found = skew.frequent_keys(entries, candidates, F.col("labels")["service_name"], F.col("service"), ("entry", "candidate"), 0.05)
    return found.select("kind", F.col("key_value").alias("service_name"))


def p3_services(spark: SparkSession, d: str) -> DataFrame:
    """Per service, what the join of its entries with its candidates would hold, and each side's own totals."""
    entries = table(spark, d, "log_entries").select("labels", "line")
    candidates = table(spark, d, "candidates").select("service", "samples")
    out = skew.eager_join_aggregate(
        entries, candidates, F.col("labels")["service_name"], F.col("service"),
        {"line_bytes": F.octet_length("line").cast("long")}, {"samples": F.col("samples").cast("long")},
    )
    return out.select(
        F.col("join_key").alias("service_name"), F.col("left_rows").alias("entry_rows"), F.col("right_rows").alias("candidate_rows"),
        "pair_rows", "pair_line_bytes_sum", "pair_samples_sum",
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_loaded, p2_found, p2_records, p3_found, p3_services)}

# The rules of the query log in SQL: the form as one expression, cells as lists of keys and values.
_ESC = r'''\\([abfnrtv\\"]|[0-3][0-7]{2}|x[0-9A-Fa-f]{2}|u([0-9A-Ca-cE-Fe-f][0-9A-Fa-f]{3}|[dD][0-7][0-9A-Fa-f]{2})|U(0000([0-9A-Ca-cE-Fe-f][0-9A-Fa-f]{3}|[dD][0-7][0-9A-Fa-f]{2})|000[1-9A-Fa-f][0-9A-Fa-f]{4}|0010[0-9A-Fa-f]{4}))'''
_PAIR = rf'''[^ ="]+(=("([^"\\\n]|{_ESC})*"|[^ "][^ ]*)?)?'''
_CELL = r'''(?:^| )([^ ="]+)(?:=("(?:[^"\\]|\\.)*"|[^ ]*))?'''
_UNQUOTED = r"""replace(replace(replace(replace(replace(replace(x[2][2:-2], '\\', chr(1)), '\"', '"'), '\n', chr(10)), '\r', chr(13)), '\t', chr(9)), chr(1), '\')"""
_METRICS = ("component", "org_id", "query", "query_type", "duration", "status")


def _sql_value(key: str, wrong: str) -> str:
    return f"len(list_filter(cells, lambda x: x.k = '{key}' AND x.v <> '' AND ({wrong}))) > 0"


#: Lines with their form and cells: of all lines, or of those for which the condition holds.
_CELLS = lambda condition="true": rf"""q AS (SELECT line_id, ts_ns, line, CASE WHEN line IS NULL OR NOT regexp_matches(line, '\S') THEN 'blank' WHEN NOT regexp_full_match(line, '(?s) *({_PAIR}( +{_PAIR})*)? *') THEN 'form' ELSE 'good' END AS form FROM query_log WHERE {condition}),
    c AS (SELECT *, CASE WHEN form = 'good' THEN list_transform(list_zip(regexp_extract_all(line, '(?s){_CELL}', 1), regexp_extract_all(line, '(?s){_CELL}', 2)),
        lambda x: {{'k': x[1], 'v': CASE WHEN x[2] LIKE '"%' THEN {_UNQUOTED} ELSE coalesce(x[2], '') END}}) END AS cells FROM q)"""  # noqa: E731
_P1 = rf"""
    WITH {_CELLS()},
    m AS (SELECT *, coalesce(starts_with(list_filter(cells, lambda x: x.k = 'caller')[-1].v, 'metrics.go'), false) AS metrics FROM c),
    e AS (SELECT *, CASE WHEN form <> 'good' THEN [(form, '')] ELSE list_concat(
        list_transform(list_filter(list_concat(['level', 'ts', 'caller'], CASE WHEN metrics THEN {list(_METRICS)} ELSE [] END),
            lambda k: len(list_filter(cells, lambda x: x.k = k)) <> 1 OR len(list_filter(cells, lambda x: x.k = k AND x.v = '')) > 0), lambda k: ('count', k)),
        CASE WHEN {_sql_value('level', "x.v NOT IN ('debug', 'info', 'warn', 'error')")} THEN [('value', 'level')] ELSE [] END,
        CASE WHEN {_sql_value('ts', "NOT regexp_full_match(x.v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([.][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') OR TRY_CAST(x.v[1:10] AS DATE) IS NULL")} THEN [('value', 'ts')] ELSE [] END,
        CASE WHEN metrics AND {_sql_value('duration', "NOT regexp_full_match(x.v, '([0-9]+([.][0-9]+)?(ns|us|µs|ms|s|m|h))+')")} THEN [('value', 'duration')] ELSE [] END,
        CASE WHEN metrics AND {_sql_value('status', "NOT regexp_full_match(x.v, '[1-5][0-9]{2}')")} THEN [('value', 'status')] ELSE [] END,
        CASE WHEN metrics AND len(list_filter(cells, lambda x: x.k = 'splits' AND NOT regexp_full_match(x.v, '[0-9]+'))) > 0 THEN [('value', 'splits')] ELSE [] END,
        CASE WHEN metrics AND len(list_filter(cells, lambda x: x.k = 'total_bytes' AND NOT regexp_full_match(x.v, '[0-9]+'))) > 0 THEN [('value', 'total_bytes')] ELSE [] END) END AS errors FROM m)
"""

# The layouts of log lines in SQL: each an expression with named groups, tried in this order.
_ISO = r"(\d{4})-([01]\d)-(\d\d)[T ](\d\d:\d\d:\d\d)(?:[.,](\d+))?\s?(Z|[+-]\d\d:?\d\d)?"
_ISO_GROUPS = ("y", "mo", "d", "hms", "fr", "z")
_WORD = "TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|ERR|CRIT|CRITICAL|FATAL|PANIC|ALERT|EMERG"
_LAYOUT_SQL = {
    "thread": (rf"^{_ISO} +({_WORD}) +\[[^\]\n]*\] +(\S+) +[-:] (.*)$", (*_ISO_GROUPS, "level", "component", "message")),
    "dashed": (rf"^{_ISO} - (\S+) - ({_WORD}) - (.*)$", (*_ISO_GROUPS, "component", "level", "message")),
    "bracketed": (rf"^\[{_ISO} +({_WORD}) +([^\]\s]+)\] ?(.*)$", (*_ISO_GROUPS, "level", "component", "message")),
    "access": (r'^\S+ \S+ [^\[\n]*\[(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d:\d\d:\d\d) ([+-]\d{4})\] (".*)$', ("d", "mon", "y", "hms", "z", "message")),
    "slashed": (r"^(\d{4})/([01]\d)/(\d\d) (\d\d:\d\d:\d\d) \[(\w+)\] \d+#\d+: (.*)$", ("y", "mo", "d", "hms", "level", "message")),
    "lettered": (r"^([DIWEFT])(\d\d)(\d\d) ([012]\d:\d\d:\d\d)(?:\.(\d+))? +\d+ ([^\]\s]+)\] ?(.*)$", ("level", "mo", "d", "hms", "fr", "component", "message")),
    "syslog_old": (r"^<(\d{1,3})>([A-Z][a-z]{2}) ([ \d]\d) (\d\d:\d\d:\d\d) \S+ ([^\s:\[]+)(?:\[[^\]\n]*\])?: ?(.*)$", ("pri", "mon", "d", "hms", "component", "message")),
    "syslog_new": (rf"^<(\d{{1,3}})>\d{{1,2}} (?:-|{_ISO}) \S+ (\S+) \S+ \S+ (?:-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (.*))?$", ("pri", *_ISO_GROUPS, "component", "message")),
    "levelled": (rf"^\[?({_WORD})\]?(?:[: ]\s*(.*))?$", ("level", "message")),
    "timed": (rf"^\[?{_ISO}\]?[ :]+(?:\[?({_WORD}|{_WORD.lower()})\]?[ :]+)?(.*)$", (*_ISO_GROUPS, "level", "message")),
}


def _level_sql(x: str) -> str:
    names: dict[str, list[str]] = {}
    for word, name in layouts.LEVELS.items():
        names.setdefault(name, []).append(word)
    return f"CASE {' '.join(f'WHEN lower(trim({x})) IN ({", ".join(f"{chr(39)}{w}{chr(39)}" for w in words)}) THEN {chr(39)}{name}{chr(39)}' for name, words in names.items())} END"


def _ms_sql(y: str, mo: str, d: str, hms: str, fr: str = "''", z: str = "''") -> str:
    zone = f"CASE WHEN coalesce({z}, '') IN ('', 'Z') THEN 0 ELSE (CASE WHEN {z}[1] = '-' THEN -1 ELSE 1 END) * (({z}[2:3])::INTEGER * 60 + (replace({z}, ':', '')[4:5])::INTEGER) * 60000 END"
    return f"(epoch_ms(TRY_CAST({y} || '-' || {mo} || '-' || lpad(trim({d}), 2, '0') || ' ' || {hms} AS TIMESTAMP)) + CASE WHEN coalesce({fr}, '') = '' THEN 0 ELSE rpad({fr}[1:3], 3, '0')::INTEGER END - {zone})"


def _value_ms_sql(v: str) -> str:
    g = f"regexp_extract({v}, '^{_ISO}$', {list(_ISO_GROUPS)})"
    n = f"TRY_CAST({v} AS DECIMAL(38, 6))"
    return f"""CASE WHEN regexp_full_match({v}, '{_ISO}') THEN {_ms_sql(*(f"({g}).{k}" for k in _ISO_GROUPS))} WHEN regexp_full_match({v}, '-?[0-9]{{1,20}}([.][0-9]+)?') THEN
        CASE WHEN abs({n}) >= 1e17 THEN floor({n} / 1000000) WHEN abs({n}) >= 1e14 THEN floor({n} / 1000) WHEN abs({n}) >= 1e11 THEN floor({n}) ELSE floor({n} * 1000) END::BIGINT END"""


def _first_sql(keys: tuple[str, ...], of) -> str:
    return f"coalesce({', '.join(map(of, keys))}, NULL)"


_NUMBERLESS = lambda v: f"nullif(regexp_replace(nullif(nullif(trim({v}), ''), '-'), '(:[0-9]+)+$|\\[[0-9]+\\]$', ''), '')"
_MONTH_SQL = lambda m: f"lpad((list_position({list(layouts.MONTHS)}, {m}))::VARCHAR, 2, '0')"
_YEAR_SQL = "coalesce(year(make_timestamp(ts_ns // 1000)), 1970)::VARCHAR"


def _layout_rows(name: str) -> str:
    """Rows of one layout: entry_id, time, level_word, component, message."""
    pattern, groups = _LAYOUT_SQL[name]
    has = lambda k: f"g.{k}" if k in groups else "NULL"
    year = has("y") if "y" in groups else _YEAR_SQL
    month = _MONTH_SQL("g.mon") if "mon" in groups else has("mo")
    time = _ms_sql(year, month, has("d"), has("hms"), has("fr"), has("z")) if "hms" in groups else "NULL::BIGINT"
    level = f"['fatal', 'fatal', 'fatal', 'error', 'warn', 'info', 'info', 'debug'][g.pri::INTEGER % 8 + 1]" if "pri" in groups else _level_sql("g.level") if "level" in groups else "NULL"
    if name == "lettered":
        level = "CASE g.level WHEN 'T' THEN 'trace' WHEN 'D' THEN 'debug' WHEN 'I' THEN 'info' WHEN 'W' THEN 'warn' WHEN 'E' THEN 'error' ELSE 'fatal' END"
    if name == "access":
        level = "NULL"
    known = "AND list_contains(" + str(list(layouts.MONTHS)) + ", g.mon)" if "mon" in groups else ""
    return f"SELECT entry_id, '{name}' AS layout, {time} AS time, {level} AS level, {_NUMBERLESS(has('component')) if 'component' in groups else 'NULL'} AS component, coalesce(g.message, '') AS message FROM (SELECT entry_id, ts_ns, regexp_extract(text, '(?s){pattern}', {list(groups)}) AS g FROM t WHERE regexp_matches(text, '(?s){pattern}')) WHERE true {known}"


_JSON_KEY = lambda k: f"'$.\"{k}\"'"
_CELL_OF = lambda k: f"list_filter(cells, lambda x: x.k = '{k}')[1].v"
_HEADERS = f"""
    t AS (SELECT entry_id, ts_ns, labels, line, CASE WHEN regexp_matches(line, '^\\s*\\{{') THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') ELSE line END AS text FROM log_entries WHERE line IS NOT NULL),
    j AS (SELECT entry_id, text FROM t WHERE text[1] = '{{' AND json_valid(text) AND len(json_keys(text)) > 0),
    l AS (SELECT entry_id, text, split_part(text, chr(10), 1) AS head FROM t WHERE text[1] <> '{{'),
    lc AS (SELECT entry_id, text, head, list_transform(list_zip(regexp_extract_all(head, '{_CELL}', 1), regexp_extract_all(head, '{_CELL}', 2)),
        lambda x: {{'k': x[1], 'v': CASE WHEN x[2] LIKE '"%' THEN {_UNQUOTED} ELSE coalesce(x[2], '') END}}) AS cells
        FROM l WHERE regexp_matches(head, '^[A-Za-z_][A-Za-z0-9_.-]*=(?:"(?:[^"\\\\]|\\\\.)*"|[^ "]*)(?: |$)') AND regexp_matches(text, '(?:{"|".join(layouts.TIME_KEYS + layouts.LEVEL_KEYS + layouts.COMPONENT_KEYS + layouts.MESSAGE_KEYS)})=')),
    every AS (
        SELECT 0 AS rank, entry_id, 'json' AS layout, {_first_sql(layouts.TIME_KEYS, lambda k: _value_ms_sql(f"json_extract_string(text, {_JSON_KEY(k)})"))} AS time,
            {_first_sql(layouts.LEVEL_KEYS, lambda k: _level_sql(f"json_extract_string(text, {_JSON_KEY(k)})"))} AS level,
            {_first_sql(layouts.COMPONENT_KEYS, lambda k: _NUMBERLESS(f"CASE WHEN json_type(text, {_JSON_KEY(k)}) = 'VARCHAR' THEN json_extract_string(text, {_JSON_KEY(k)}) END"))} AS component,
            coalesce({_first_sql(layouts.MESSAGE_KEYS, lambda k: f"CASE WHEN json_type(text, {_JSON_KEY(k)}) = 'VARCHAR' THEN json_extract_string(text, {_JSON_KEY(k)}) END")}, text) AS message FROM j
        UNION ALL SELECT * FROM (SELECT 1, entry_id, 'logfmt', {_first_sql(layouts.TIME_KEYS, lambda k: _value_ms_sql(_CELL_OF(k)))} AS time, {_first_sql(layouts.LEVEL_KEYS, lambda k: _level_sql(_CELL_OF(k)))} AS level,
            {_first_sql(layouts.COMPONENT_KEYS, lambda k: _NUMBERLESS(_CELL_OF(k)))} AS component, coalesce({_first_sql(layouts.MESSAGE_KEYS, _CELL_OF)}, head) || text[length(head) + 1:] AS message FROM lc WHERE len(cells) >= 2)
        UNION ALL {" UNION ALL ".join(f"SELECT {i + 2}, * FROM ({_layout_rows(name)})" for i, name in enumerate(_LAYOUT_SQL))}),
    first_of AS (SELECT entry_id, arg_min({{'time': time, 'level': level, 'component': component, 'message': message}}, rank) AS f FROM every GROUP BY entry_id),
    headers AS (SELECT t.entry_id AS entry_id, coalesce(f.time, ts_ns // 1000000) AS event_ms, coalesce(f.level, '-') AS level_name, coalesce(f.component, '-') AS component_name, f.message AS message FROM first_of JOIN t USING (entry_id))"""

SQL = {
    "p2_found": f"WITH {_HEADERS} SELECT entry_id, event_ms, level_name, component_name FROM headers",
    "p2_records": f"""WITH {_HEADERS},
        n AS (SELECT t.entry_id AS entry_id, ts_ns, list_sort(map_entries(coalesce(labels, MAP {{}}))) AS stream, line, h.entry_id AS head, h.message AS message FROM t LEFT JOIN headers h ON t.entry_id = h.entry_id WHERE trim(line) <> ''),
        m AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY stream ORDER BY ts_ns, entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), entry_id) AS record FROM n),
        r AS (SELECT record, min(ts_ns) AS ts_ns, string_agg(coalesce(message, line), chr(10) ORDER BY ts_ns, entry_id) AS message, count(*) AS line_count FROM m GROUP BY stream, record)
        SELECT record AS entry_id, 0 AS part, coalesce(event_ms, ts_ns // 1000000) AS event_ms, coalesce(level_name, '-') AS level_name, coalesce(component_name, '-') AS component_name, r.message AS message, line_count
        FROM r LEFT JOIN headers ON entry_id = record""",
    "p1_found": f"{_P1} SELECT line_id FROM e WHERE len(errors) > 0",
    "p1_loaded": f"{_P1} SELECT line_id, ts_ns, line FROM e WHERE len(errors) = 0",
    "p1_reasons": f'{_P1}, r AS (SELECT line_id, unnest(errors) AS x FROM e) SELECT x[1] AS reason, x[2] AS "column", count(DISTINCT line_id) AS n_lines FROM r GROUP BY ALL',
    "p3_found": """
        SELECT 'entry' AS kind, labels['service_name'] AS service_name FROM log_entries
        GROUP BY 2 HAVING labels['service_name'] IS NOT NULL AND count(*) >= 0.05 * (SELECT count(*) FROM log_entries)
        UNION ALL
        SELECT 'candidate', service FROM candidates
        GROUP BY 2 HAVING service IS NOT NULL AND count(*) >= 0.05 * (SELECT count(*) FROM candidates)""",
    "p3_services": """
        WITH e AS (SELECT labels['service_name'] AS s, count(*) AS n, sum(octet_length(encode(line)))::HUGEINT AS b FROM log_entries WHERE labels['service_name'] IS NOT NULL GROUP BY 1),
             c AS (SELECT service AS s, count(*) AS n, sum(samples)::HUGEINT AS b FROM candidates WHERE service IS NOT NULL GROUP BY 1)
        SELECT coalesce(e.s, c.s) AS service_name, coalesce(e.n, 0) AS entry_rows, coalesce(c.n, 0) AS candidate_rows,
               (coalesce(e.n, 0)::HUGEINT * coalesce(c.n, 0))::DECIMAL(38, 0) AS pair_rows, (e.b * coalesce(c.n, 0))::DECIMAL(38, 0) AS pair_line_bytes_sum,
               (c.b * coalesce(e.n, 0))::DECIMAL(38, 0) AS pair_samples_sum
        FROM e FULL JOIN c ON e.s = c.s""",
}
