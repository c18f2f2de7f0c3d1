"""LogQL over the events table, with the same in SQL: one query for each construct of the language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.logql.compile import LogStore
from brindle.sources.logs import NS, events_as_logs
from brindle.session import table

#: 2024-01-31 UTC, the end of the events.
AT = 1_706_659_200
DAY = 86_400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BASE = f"""logs AS (
    SELECT event_type AS service_name, 'pod-' || (user_id % 4)::VARCHAR AS pod, epoch_us(ts) * 1000 AS ts_ns, props, floor(value)::BIGINT AS took, user_id,
           CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' user ' || user_id::VARCHAR || ' did ' || event_type || ' took ' || floor(value)::BIGINT::VARCHAR || 'ms' AS line
    FROM events),
    within AS (SELECT * FROM logs WHERE ts_ns > {(AT - 30 * DAY) * NS} AND ts_ns <= {AT * NS})"""


def _store(spark: SparkSession, d: str, structured: bool) -> LogStore:
    return LogStore(events_as_logs(spark, d), line="props" if structured else "line")


def _lines(name: str, query: str, sql_condition: str, structured: bool = False, labels: tuple[str, ...] = ("service_name", "pod"), select: str | None = None) -> None:
    """Lines of a log query: the labels asked for, ts_ns and line."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _store(spark, d, structured).logs(query)
        return df.select(*[F.col("labels")[x].alias(x) for x in labels], "ts_ns", "line")

    run.__doc__ = query
    QUERIES[name] = run
    SQL[name] = f"WITH {BASE} SELECT {select or ', '.join([*labels, 'ts_ns', ('props' if structured else 'line') + ' AS line'])} FROM logs WHERE {sql_condition}"


def _values(name: str, query: str, sql: str, labels: tuple[str, ...] = (), structured: bool = False, digits: int | None = None, over: tuple[int, int, int] | None = None) -> None:
    """A metric query at AT, or over (start, end, step) in seconds. sql: a SELECT over `within`, `logs` of the labels and value."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        s = _store(spark, d, structured)
        df = s.over(query, *(x * NS for x in over)) if over else s.instant(query, AT * NS)
        v = F.round("value", digits) if digits is not None else F.col("value")
        return df.select(*(["at_ns"] if over else []), *[F.col("labels")[x].alias(x) for x in labels], v.alias("value"))

    run.__doc__ = query
    QUERIES[name] = run
    SQL[name] = f"WITH {BASE} {sql}"


# Selectors and line filters
_lines("line_contains", '{service_name=~".+"} |= "took 1"', "contains(line, 'took 1')")
_lines("line_not_contains", '{service_name="view"} != "took 1"', "service_name = 'view' AND NOT contains(line, 'took 1')")
_lines("line_regex", r'{service_name=~".+"} |~ `user \d+5 did .* took [0-9]{3,}ms$`', r"regexp_matches(line, 'user \d+5 did .* took [0-9]{3,}ms$')")
_lines("line_not_regex", r'{service_name="error"} !~ `took \d{1,2}ms`', r"service_name = 'error' AND NOT regexp_matches(line, 'took \d{1,2}ms')")
_lines("line_or", '{service_name=~".+"} |= "took 100ms" or "took 101ms" != "user 7 " or "user 8 "', "(contains(line, 'took 100ms') OR contains(line, 'took 101ms')) AND NOT (contains(line, 'user 7 ') OR contains(line, 'user 8 '))")
_lines("line_pattern", '{service_name=~".+"} |> "<_> user 1 did <_>" !> "INFO <_> took 1<_>"', "line LIKE '% user 1 did %' AND NOT line LIKE 'INFO % took 1%'")
_lines("line_regex_fold", r'{service_name=~".+"} |~ `(?i)ERROR USER \d{1,2} DID`', r"regexp_matches(line, '(?i)ERROR USER \d{1,2} DID')")
_lines("selector_eq", '{service_name="signup", pod="pod-1"}', "service_name = 'signup' AND pod = 'pod-1'")
_lines("selector_neq", '{service_name!="signup", pod=~"pod-.*"}', "service_name <> 'signup'")
_lines("selector_regex", '{service_name=~"v.*|click", pod!~".*[13]"}', "regexp_full_match(service_name, 'v.*|click') AND NOT regexp_full_match(pod, '.*[13]')")
_lines("selector_absent_label", '{service_name="view", zone=""}', "service_name = 'view'")

# Parsers, label filters and rewrites
_lines("json_field_filter", '{service_name="error"} | json | k > 90', "service_name = 'error' AND (props->>'k')::INTEGER > 90", True)
_lines("json_expression", '{service_name="error"} | json n="k" | n = "7"', "service_name = 'error' AND props->>'k' = '7'", True, ("service_name", "n"), "service_name, props->>'k' AS n, ts_ns, props AS line")
_lines("logfmt_stage", '{service_name="view"} | line_format "svc={{.service_name}} pod={{.pod}}" | logfmt | svc="view"', "service_name = 'view'", False, ("svc", "pod_extracted"), "service_name AS svc, pod AS pod_extracted, ts_ns, 'svc=view pod=' || pod AS line")
_lines("regexp_extract_stage", r'{service_name=~".+"} | regexp `user (?P<who>\d+) did` | who = "3"', "user_id = 3", False, ("service_name", "who"), "service_name, user_id::VARCHAR AS who, ts_ns, line")
_lines("pattern_stage", '{service_name=~".+"} | pattern "<level> user <who> did <_> took <took>" | level="ERROR", took=~"1.ms"', "service_name = 'error' AND took BETWEEN 10 AND 19", False, ("level", "who", "took"), "'ERROR' AS level, user_id::VARCHAR AS who, took::VARCHAR || 'ms' AS took, ts_ns, line")
_lines("duration_filter", '{service_name="click"} | pattern "<_> took <took>" | took >= 150ms and took < 0.2s', "service_name = 'click' AND took >= 150 AND took < 200", False, ("took",), "took::VARCHAR || 'ms' AS took, ts_ns, line")
_lines("label_filter_precedence", '{service_name=~".+"} | pod="pod-1" or pod="pod-2" and service_name="view"', "pod = 'pod-1' OR (pod = 'pod-2' AND service_name = 'view')")
_lines("label_format", '{service_name="purchase"} | label_format what=service_name, where="{{.pod | ToUpper}}/{{.pod}}"', "service_name = 'purchase'", False, ("service_name", "what", "where"), "NULL::VARCHAR AS service_name, service_name AS what, upper(pod) || '/' || pod AS \"where\", ts_ns, line")
_lines("line_format_filter", '{service_name="purchase"} | line_format "{{.pod}}: {{__line__}}" |= "pod-2: INFO"', "service_name = 'purchase' AND pod = 'pod-2'", False, ("pod",), "pod, ts_ns, pod || ': ' || line AS line")
_lines("drop_keep", '{service_name=~".+"} |= "took 7ms" | drop pod="pod-1" | keep pod', "contains(line, 'took 7ms')", False, ("service_name", "pod"), "NULL::VARCHAR AS service_name, CASE WHEN pod <> 'pod-1' THEN pod END AS pod, ts_ns, line")

_ALL = "service_name"
_COUNT = "SELECT service_name, count(*)::DOUBLE AS value FROM within GROUP BY 1"
_TOOK = 'pattern "<_> took <t>ms" | unwrap t'


def _unwrap(name: str, func: str, sql: str, digits: int | None = None, extra: str = "") -> None:
    _values(name, f'{func}({extra}{{service_name=~".+"}} | {_TOOK} [30d]) by (service_name)', f"SELECT service_name, {sql} AS value FROM within GROUP BY 1", (_ALL,), digits=digits)


# Range aggregations
_values("count_over_time", 'sum by (service_name) (count_over_time({service_name=~".+"} [30d]))', _COUNT, (_ALL,))
_values("count_over_time_streams", 'count_over_time({service_name=~".+"} |= "ERROR" [30d])', "SELECT service_name, pod, count(*)::DOUBLE AS value FROM within WHERE contains(line, 'ERROR') GROUP BY 1, 2", (_ALL, "pod"))
_values("bytes_over_time", 'sum by (service_name) (bytes_over_time({service_name=~".+"} [30d]))', "SELECT service_name, sum(octet_length(encode(line)))::DOUBLE AS value FROM within GROUP BY 1", (_ALL,))
_values("rate", 'sum by (service_name) (rate({service_name=~".+"} [30d]))', f"SELECT service_name, round(count(*) / {30 * DAY}.0::DOUBLE, 12) AS value FROM within GROUP BY 1", (_ALL,), digits=12)
_values("bytes_rate", 'sum by (pod) (bytes_rate({service_name="view"} [30d]))', f"SELECT pod, round(sum(octet_length(encode(line))) / {30 * DAY}.0::DOUBLE, 12) AS value FROM within WHERE service_name = 'view' GROUP BY 1", ("pod",), digits=12)
_unwrap("sum_over_time_unwrap", "sum_over_time", "sum(took)::DOUBLE")
_unwrap("avg_over_time", "avg_over_time", "avg(took)", 9)
_unwrap("min_over_time", "min_over_time", "min(took)::DOUBLE")
_unwrap("max_over_time", "max_over_time", "max(took)::DOUBLE")
_unwrap("stddev_over_time", "stddev_over_time", "round(stddev_pop(took), 6)", 6)
_unwrap("stdvar_over_time", "stdvar_over_time", "round(var_pop(took), 6)", 6)
_unwrap("quantile_over_time", "quantile_over_time", "quantile_cont(took, 0.9)::DOUBLE", 9, "0.9, ")
_unwrap("first_over_time", "first_over_time", "arg_min(took, (ts_ns, took))::DOUBLE")
_unwrap("last_over_time", "last_over_time", "arg_max(took, (ts_ns, took))::DOUBLE")
_unwrap("rate_unwrap", "rate", f"round(sum(took) / {30 * DAY}.0, 9)", 9)
_values("rate_counter", f'rate_counter({{service_name=~".+"}} | {_TOOK} [30d]) by (service_name)', f"""
    , s AS (SELECT service_name, took, lag(took) OVER (PARTITION BY service_name ORDER BY ts_ns, took) AS p FROM within)
    SELECT service_name, round(sum(CASE WHEN p IS NULL THEN 0 WHEN took >= p THEN took - p ELSE took END) / {30 * DAY}.0, 9) AS value FROM s GROUP BY 1""", (_ALL,), digits=9)  # fmt: skip
SQL["rate_counter"] = SQL["rate_counter"].replace(") \n    , s AS", "), s AS")
_values("unwrap_json", 'sum by (service_name) (sum_over_time({service_name=~".+"} | json | unwrap k | __error__="" [30d]))', "SELECT service_name, sum((props->>'k')::INTEGER)::DOUBLE AS value FROM within GROUP BY 1", (_ALL,), True)
_values("absent_over_time", 'absent_over_time({service_name="nobody", pod="pod-9"} [30d])', "SELECT 'nobody' AS service_name, 'pod-9' AS pod, 1.0::DOUBLE AS value", (_ALL, "pod"))
_values("present_is_not_absent", 'absent_over_time({service_name="view"} [30d])', "SELECT 'view' AS service_name, 1.0::DOUBLE AS value WHERE false", (_ALL,))
_values("offset", 'sum by (service_name) (count_over_time({service_name=~".+"} [7d] offset 10d))', f"SELECT service_name, count(*)::DOUBLE AS value FROM logs WHERE ts_ns > {(AT - 17 * DAY) * NS} AND ts_ns <= {(AT - 10 * DAY) * NS} GROUP BY 1", (_ALL,))
_STEPS = f"steps AS (SELECT unnest(range({AT - 20 * DAY}, {AT} + 1, {DAY // 2})) * {NS} AS at_ns)"
for _name, _width in (("range_steps", 2 * DAY), ("range_steps_uneven", 3 * DAY // 4), ("range_steps_gaps", DAY // 4)):
    _values(_name, f'sum by (service_name) (count_over_time({{service_name=~".+"}} [{_width}s]))', f", {_STEPS} SELECT at_ns, service_name, count(*)::DOUBLE AS value FROM steps JOIN logs ON ts_ns > at_ns - {_width * NS} AND ts_ns <= at_ns GROUP BY 1, 2", (_ALL,), over=(AT - 20 * DAY, AT, DAY // 2))
_values("range_steps_max", f'max_over_time({{service_name="view"}} | {_TOOK} [2d]) by (service_name)', f", {_STEPS} SELECT at_ns, service_name, max(took)::DOUBLE AS value FROM steps JOIN logs ON ts_ns > at_ns - {2 * DAY * NS} AND ts_ns <= at_ns WHERE service_name = 'view' GROUP BY 1, 2", (_ALL,), over=(AT - 20 * DAY, AT, DAY // 2))

for _f, _s in (("stddev", "stddev_pop"), ("stdvar", "var_pop")):
    _values(
        f"range_steps_{_f}", f'{_f}_over_time({{service_name=~"view|error"}} | {_TOOK} [2d]) by (service_name)',
        f", {_STEPS} SELECT at_ns, service_name, round({_s}(took), 4) AS value FROM steps JOIN logs ON ts_ns > at_ns - {2 * DAY * NS} AND ts_ns <= at_ns WHERE service_name IN ('view', 'error') GROUP BY 1, 2", (_ALL,), over=(AT - 20 * DAY, AT, DAY // 2), digits=4,
    )
_values("range_steps_or", f'sum by (service_name) (count_over_time({{service_name="view"}} [{2 * DAY}s])) * 0 or sum by (service_name) (count_over_time({{service_name=~"view|click"}} [{2 * DAY}s]))', f", {_STEPS} SELECT at_ns, service_name, (CASE service_name WHEN 'view' THEN 0 ELSE count(*) END)::DOUBLE AS value FROM steps JOIN logs ON ts_ns > at_ns - {2 * DAY * NS} AND ts_ns <= at_ns WHERE service_name IN ('view', 'click') GROUP BY 1, 2", (_ALL,), over=(AT - 20 * DAY, AT, DAY // 2))

# Vector aggregations
_PODS = "p AS (SELECT service_name, pod, count(*)::DOUBLE AS value FROM within GROUP BY 1, 2)"
_P = 'count_over_time({service_name=~".+"} [30d])'
_values("sum_global", f"sum({_P})", "SELECT count(*)::DOUBLE AS value FROM within")
_values("sum_without", f"sum without (pod) ({_P})", _COUNT, (_ALL,))
for _f, _s in (("avg", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "count(*)::DOUBLE"), ("stddev", "round(stddev_pop(value), 6)"), ("stdvar", "round(var_pop(value), 6)")):
    _values(f"{_f}_by", f"{_f} by (service_name) ({_P})", f", {_PODS} SELECT service_name, {_s} AS value FROM p GROUP BY 1", (_ALL,), digits=6 if _f.startswith("std") else None)
_values("topk", f"topk(3, {_P})", f", {_PODS} SELECT service_name, pod, value FROM p ORDER BY value DESC, pod, service_name LIMIT 3", (_ALL, "pod"))
_values("bottomk_by", f"bottomk by (service_name) (2, {_P})", f", {_PODS} SELECT service_name, pod, value FROM p QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY value, pod) <= 2", (_ALL, "pod"))
_values("approx_topk", f"approx_topk(3, {_P})", f", {_PODS} SELECT service_name, pod, value FROM p ORDER BY value DESC, pod, service_name LIMIT 3", (_ALL, "pod"))
_values("sort_desc", f"sort_desc(sum by (service_name) ({_P}))", _COUNT, (_ALL,))
_values("live_streams", f'count(sum by (service_name, pod) ({_P}))', "SELECT count(DISTINCT service_name || pod)::DOUBLE AS value FROM within")

# Operators
_E = 'sum by (service_name) (count_over_time({service_name=~".+"} |= "took 1" [30d]))'
_T = 'sum by (service_name) (count_over_time({service_name=~".+"} [30d]))'
_ET = "et AS (SELECT service_name, count(*) FILTER (contains(line, 'took 1'))::DOUBLE AS e, count(*)::DOUBLE AS t FROM within GROUP BY 1)"
_values("binary_div", f"{_E} / {_T}", f", {_ET} SELECT service_name, e / t AS value FROM et WHERE e > 0", (_ALL,))
_values("binary_div_on", f"{_E} / on(service_name) {_P.replace('count_over_time', 'sum without (pod) (count_over_time')}) * 100", f", {_ET} SELECT service_name, e / t * 100 AS value FROM et WHERE e > 0", (_ALL,))
_values("binary_precedence", f"{_T} + {_E} * 2 ^ 3 - 10 % 4", f", {_ET} SELECT service_name, t + e * 8 - 2 AS value FROM et WHERE e > 0", (_ALL,))
_values("binary_zero", f"({_T} - {_T}) / ({_T} - {_T}) >= 0 or {_T} * 0 / 1", f", {_ET} SELECT service_name, 0.0::DOUBLE AS value FROM et", (_ALL,))
_values("compare_filter", f"{_T} > 2000", "SELECT * FROM (" + _COUNT + ") WHERE value > 2000", (_ALL,))
_values("compare_bool", f"{_T} > bool 2000", "SELECT service_name, (value > 2000)::INTEGER::DOUBLE AS value FROM (" + _COUNT + ")", (_ALL,))
_VIEW = 'sum by (service_name) (count_over_time({service_name=~"view|click"} [30d]))'
_values("vector_or", f'sum by (service_name) (rate({{service_name="view"}} | drop pod [30d])) * 0 or {_VIEW}', "SELECT service_name, CASE service_name WHEN 'view' THEN 0.0::DOUBLE ELSE count(*)::DOUBLE END AS value FROM within WHERE service_name IN ('view', 'click') GROUP BY 1", (_ALL,))
_values("vector_and", f"{_T} and {_VIEW}", _COUNT.replace("within", "within WHERE service_name IN ('view', 'click')"), (_ALL,))
_values("vector_unless", f"{_T} unless {_VIEW}", _COUNT.replace("within", "within WHERE service_name NOT IN ('view', 'click')"), (_ALL,))
_values("group_left", f"{_P} / on(service_name) group_left() {_T}", f", {_PODS}, t AS (SELECT service_name, sum(value) AS total FROM p GROUP BY 1) SELECT service_name, pod, value / total AS value FROM p JOIN t USING (service_name)", (_ALL, "pod"))
_values("ignoring_group_right", f"{_T} - ignoring(pod) group_right() {_P}", f", {_PODS}, t AS (SELECT service_name, sum(value) AS total FROM p GROUP BY 1) SELECT service_name, pod, total - value AS value FROM p JOIN t USING (service_name)", (_ALL, "pod"))
_values("label_replace", f'label_replace({_P}, "shard", "s${{1}}", "pod", "pod-(.*)")', f", {_PODS} SELECT service_name, pod, 's' || pod[5:] AS shard, value FROM p", (_ALL, "pod", "shard"))
_values("variants", 'variants(count_over_time({service_name="view"} [30d]), bytes_over_time({service_name="view"} [30d])) of ({service_name="view"} |= "took 1" [30d])', """, v AS (SELECT * FROM within WHERE service_name = 'view' AND contains(line, 'took 1'))
    SELECT pod, '0' AS "__variant__", count(*)::DOUBLE AS value FROM v GROUP BY 1 UNION ALL SELECT pod, '1', sum(octet_length(encode(line)))::DOUBLE FROM v GROUP BY 1""", ("pod", "__variant__"))  # fmt: skip
_values("scalar_vector", "vector(1) + 2 * 3", "SELECT 7.0::DOUBLE AS value")
_values("missing_side_sum", f"((({_VIEW}) + ({_T})) or ({_VIEW}) or ({_T}))", "SELECT service_name, count(*) * CASE WHEN service_name IN ('view', 'click') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS value FROM within GROUP BY 1", (_ALL,))


# Reads
# Constructs that read or make values, and streams of log_entries with their nulls, missing labels and hot services
_lines("bytes_filter", '{service_name="view"} | pattern "<_> took <took>ms" | label_format size="{{.took}}KB" | size > 0.1MB', "service_name = 'view' AND took > 100")
_lines("decolorize_stage", '{service_name="click"} | line_format "\x1b[31m{{.pod}}\x1b[0m up" | decolorize |= "pod-2 up"', "service_name = 'click' AND pod = 'pod-2'", False, ("service_name", "pod"), "service_name, pod, ts_ns, pod || ' up' AS line")
_lines("unpack_stage", '{service_name="error"} | line_format `{"_entry": "e {{.pod}}", "zone": "z1"}` | unpack | zone="z1" |= "pod-1"', "service_name = 'error' AND pod = 'pod-1'", False, ("service_name", "zone"), "service_name, 'z1' AS zone, ts_ns, 'e ' || pod AS line")
_lines("ip_filter_label", '{service_name="view"} | pattern "<_> took <took>ms" | label_format addr="10.0.{{.took}}.9" | addr = ip("10.0.64.0/18")', "service_name = 'view' AND took BETWEEN 64 AND 127")
_values("unwrap_bytes", 'sum by (service_name) (sum_over_time({service_name=~".+"} | pattern "<_> took <took>ms" | label_format size="{{.took}}KB" | unwrap bytes(size) [30d]))', "SELECT service_name, sum(took)::DOUBLE * 1000 AS value FROM within GROUP BY 1", ("service_name",))
_values("unwrap_duration", 'sum by (service_name) (sum_over_time({service_name=~".+"} | pattern "<_> took <took>" | unwrap duration(took) [30d]))', "SELECT service_name, round(sum(took)::DOUBLE / 1000, 6) AS value FROM within GROUP BY 1", ("service_name",), digits=6)
_values(
    "offset_negative", 'sum by (pod) (count_over_time({service_name="view"} [5d] offset -2d))',
    f"SELECT pod, count(*)::DOUBLE AS value FROM logs WHERE service_name = 'view' AND ts_ns > {(AT - 3 * DAY) * NS} AND ts_ns <= {(AT + 2 * DAY) * NS} GROUP BY 1", ("pod",),
)


def _entries(name: str, query: str, sql_condition: str) -> None:
    """Lines of a log query over log_entries; a null line is an empty one."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = LogStore(table(spark, d, "log_entries")).logs(query)
        return df.select(F.col("labels")["service_name"].alias("service_name"), F.col("labels")["k8s_pod_name"].alias("pod"), "ts_ns", "line")

    run.__doc__ = query
    QUERIES[name] = run
    SQL[name] = f"SELECT labels['service_name'] AS service_name, labels['k8s_pod_name'] AS pod, ts_ns, coalesce(line, '') AS line FROM log_entries WHERE {sql_condition}"


_entries("entries_without_service", '{k8s_pod_name=~".+", service_name=""}', "labels['k8s_pod_name'] <> '' AND coalesce(labels['service_name'], '') = ''")
_entries("entries_ip_filter", '{k8s_namespace_name=~"ns-.*"} |= ip("10.112.0.0/12")', r"""starts_with(labels['k8s_namespace_name'], 'ns-')
    AND len(list_filter(regexp_extract_all(line, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: regexp_full_match(x, '10\.(11[2-9]|12[0-7])\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})'))) > 0""")
_entries("entries_regex_filters", r'{service_name=~"courier|basket|ledger"} |~ `(?i)\berror\b` !~ `[0-9]{5,}`', r"labels['service_name'] IN ('courier', 'basket', 'ledger') AND regexp_matches(line, '(?i)\berror\b') AND NOT regexp_matches(line, '[0-9]{5,}')")


def label_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of a label in a range."""
    return _store(spark, d, False).label_values("pod", (AT - 3 * DAY) * NS, AT * NS)


def label_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the labels of the streams that a selector matches."""
    return _store(spark, d, False).label_names('{service_name="view"}', (AT - 3 * DAY) * NS, AT * NS)


def oldest_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first lines of a selection: a bounded sample is the feature."""
    return _store(spark, d, False).sample('{service_name="view"} |= "took"', (AT - 30 * DAY) * NS, AT * NS, 50).select("ts_ns", "line")


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    """All lines in [start, end)."""
    s = _store(spark, d, False)
    return s.logs('{service_name=~".+"}', (AT - 5 * DAY) * NS, (AT - 4 * DAY) * NS).select("ts_ns", "line")


def entries_by_service(spark: SparkSession, d: str) -> DataFrame:
    """A metric query over log_entries: matching lines of each service and zone."""
    s = LogStore(table(spark, d, "log_entries"))
    df = s.instant('sum by (service_name, cluster_zone) (count_over_time({service_name=~".+"} |= "deadlock" !~ `victim tx [0-9]*[13579]` [400d]))', 1_767_744_000 * NS)
    return df.select(F.col("labels")["service_name"].alias("service_name"), F.col("labels")["cluster_zone"].alias("cluster_zone"), "value")


QUERIES |= {f.__name__: f for f in (label_values, label_names, oldest_sample, range_scan, entries_by_service)}
SQL |= {
    "label_values": f"WITH {BASE} SELECT DISTINCT pod AS value FROM logs WHERE ts_ns >= {(AT - 3 * DAY) * NS} AND ts_ns < {AT * NS}",
    "label_names": "SELECT unnest(['pod', 'service_name']) AS name",
    "oldest_sample": f"WITH {BASE} SELECT ts_ns, line FROM logs WHERE service_name = 'view' AND ts_ns >= {(AT - 30 * DAY) * NS} AND ts_ns < {AT * NS} ORDER BY ts_ns, line LIMIT 50",
    "range_scan": f"WITH {BASE} SELECT ts_ns, line FROM logs WHERE ts_ns >= {(AT - 5 * DAY) * NS} AND ts_ns < {(AT - 4 * DAY) * NS}",
    "entries_by_service": f"""SELECT labels['service_name'] AS service_name, labels['cluster_zone'] AS cluster_zone, count(*)::DOUBLE AS value FROM log_entries
        WHERE labels['service_name'] <> '' AND contains(line, 'deadlock') AND NOT regexp_matches(line, 'victim tx [0-9]*[13579]')
          AND ts_ns > {(1_767_744_000 - 400 * DAY) * NS} AND ts_ns <= {1_767_744_000 * NS} GROUP BY 1, 2""",
}
