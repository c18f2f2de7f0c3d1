"""Evidence, automata, verdicts and topologies over whole tables, with SQL.

Documents that other systems hold (dashboards, rules, audited requests) are made of the tables' rows and read back; sets of names stand for languages whose
answers SQL can give.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle import functions, topology
from brindle.logql import syntax
from brindle.logql.syntax import parse
from brindle.operators import decide, enforce, mining
from brindle.operators import usage as us
from brindle.operators.ordering import piece_count
from brindle.plans.logql_queries import AT, BASE, DAY
from brindle.plans.problems import _CELLS, _PAIR
from brindle.plans import rule_queries
from brindle.plans.rule_queries import SQL as SQL_OF_RULES
from brindle.plans.rule_queries import _TAGGED, RULES, _records
from brindle.relang import automaton as at
from brindle.relang.syntax import java, quote
from brindle.session import table
from brindle.sources import dashboards as db
from brindle.sources import logs
from brindle.sources import search_audit as sa
from brindle.sources.logs import NS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _map_rows(df: DataFrame, schema: str, of):
    """df's rows through a function of one row (as a tuple) that gives rows."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([out for row in b.itertuples(index=False, name=None) for out in of(*row)], columns=names)

    return df.mapInPandas(run, schema)


# --- Answers and files of a log store ----------------------------------------------------------------------------------


@_query("SELECT labels['service_name'] AS service_name, count(*) AS n, min(ts_ns) AS first_ns, count(line) AS n_lines, coalesce(sum(length(line)), 0)::BIGINT AS chars FROM log_entries GROUP BY 1")
def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to range queries, written as a log store does and decoded."""
    e = table(spark, d, "log_entries")
    value = F.array(F.col("ts_ns").cast("string"), F.col("line"))
    body = F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("streams").alias("resultType"), F.array(F.struct(F.col("labels").alias("stream"), F.array(value).alias("values"))).alias("result")).alias("data")))
    got = logs.decode_streams(e.select(body.alias("body")))
    return got.groupBy(F.col("labels")["service_name"].alias("service_name")).agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.count("line").alias("n_lines"), F.coalesce(F.sum(F.length("line").cast("long")), F.lit(0)).alias("chars"))


@_query("SELECT scope_labels['service_name'] AS service_name, count(*) AS n, sum(samples)::DOUBLE AS value FROM candidates GROUP BY 1")
def vector_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to instant queries, decoded."""
    c = table(spark, d, "candidates")
    one = F.struct(F.col("scope_labels").alias("metric"), F.array(F.lit("1706659200"), F.col("samples").cast("string")).alias("value"))
    got = logs.decode_vector(c.select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct(F.lit("vector").alias("resultType"), F.array(one).alias("result")).alias("data"))).alias("body")))
    return got.groupBy(F.col("labels")["service_name"].alias("service_name")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


_DAY0 = 1_767_571_200


@_query(f"SELECT labels['k8s_namespace_name'] AS namespace, count(*) AS n FROM log_entries WHERE ts_ns >= {_DAY0 * NS} AND ts_ns < {(_DAY0 + DAY) * NS} GROUP BY 1")
def one_day(spark: SparkSession, d: str) -> DataFrame:
    """A scan of one day whose rows are checked to lie in it."""
    a, b = _DAY0 * NS, (_DAY0 + DAY) * NS
    e = table(spark, d, "log_entries").where((F.col("ts_ns") >= a) & (F.col("ts_ns") < b))
    return logs.in_range(e, a, b).groupBy(F.col("labels")["k8s_namespace_name"].alias("namespace")).agg(F.count("ts_ns").alias("n"))


# --- Dashboards, rules, links ------------------------------------------------------------------------------------------

_SOURCES = (db.Datasource("main", "Logs", "loki", True), db.Datasource("cold", "Old logs", "loki"), db.Datasource("num", "Metrics", "prometheus"))
_KEPT = "query_text IS NOT NULL AND regexp_matches(query_text, '[^ \\t\\r\\n\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}]')"


def _documents(spark: SparkSession, d: str, kind, uid, body) -> DataFrame:
    q = table(spark, d, "executed_queries").where("query_text is not null")
    return q.select(F.lit(1).cast("long").alias("org"), kind.alias("type"), uid.alias("uid"), body.alias("body"))



def _id():
    return F.col("query_id").cast("string")


@_query(f"""SELECT 'dashboard:' || query_id::VARCHAR || '/panel:' || p::VARCHAR || '/A' AS origin, query_text AS expr, p = 3 AS hidden, CASE p WHEN 1 THEN 'main' ELSE 'cold' END AS datasource
        FROM executed_queries, unnest([1, 3]) AS u(p) WHERE {_KEPT}""")
def dashboard_panels(spark: SparkSession, d: str) -> DataFrame:
    """Classic dashboards: a panel, a panel within a row that is hidden, and one of another kind of store."""
    target = lambda hide: F.array(F.struct(F.lit("A").alias("refId"), F.col("query_text").alias("expr"), F.lit(hide).alias("hide")))
    panel = lambda i, ds, hide=False: F.struct(F.lit(i).alias("id"), F.lit(ds).alias("datasource"), target(hide).alias("targets"))
    row = F.to_json(F.struct(F.array(panel(1, "main"), panel(2, "num")).alias("panels")))
    inner = F.to_json(F.struct(F.lit(9).alias("id"), F.array(panel(3, "Old logs", True)).alias("panels")))
    body = F.concat(F.expr("substring(a, 1, length(a) - 2)"), F.lit(","), F.col("b"), F.lit("]}"))
    q = table(spark, d, "executed_queries").where("query_text is not null").select("query_id", row.alias("a"), inner.alias("b"))
    docs = q.select(F.lit(1).cast("long").alias("org"), F.lit("dashboard").alias("type"), _id().alias("uid"), body.alias("body"))
    return db.read_documents(docs, _SOURCES).select("origin", "expr", "hidden", F.col("datasources")[0].alias("datasource"))


@_query(f"SELECT 'dashboard:' || query_id::VARCHAR || '/p1/0' AS origin, query_text AS expr FROM executed_queries WHERE {_KEPT}")
def dashboard_elements(spark: SparkSession, d: str) -> DataFrame:
    """Dashboards of the second layout."""
    nest = lambda c, *names: nest(F.struct(c.alias(names[-1])), *names[:-1]) if names else c
    inner = F.struct(F.lit("loki").alias("group"), F.struct(F.lit("cold").alias("name")).alias("datasource"), F.struct(F.col("query_text").alias("expr")).alias("spec"))
    queries = F.array(F.struct(F.struct(inner.alias("query")).alias("spec")))
    panel = F.struct(F.lit("Panel").alias("kind"), nest(queries, "data", "spec", "queries").alias("spec"))
    docs = _documents(spark, d, F.lit("dashboard"), _id(), F.to_json(F.struct(F.struct(panel.alias("p1")).alias("elements"))))
    return db.read_documents(docs, _SOURCES).select("origin", "expr")


@_query(f"""SELECT CASE query_id % 4 WHEN 0 THEN 'library:' || query_id::VARCHAR || '/panel:5/A' WHEN 1 THEN 'alertrule:' || query_id::VARCHAR || '/0' WHEN 2 THEN 'shorturl:' || query_id::VARCHAR || '/x/0'
        ELSE 'history:' || query_id::VARCHAR || '/0' END AS origin, query_text AS expr FROM executed_queries WHERE {_KEPT}""")
def stored_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries of library panels, alert rules, explore links and histories."""
    expr = F.col("query_text").alias("expr")
    library = F.struct(F.struct(F.lit(5).alias("id"), F.lit("main").alias("datasource"), F.array(F.struct(F.lit("A").alias("refId"), expr)).alias("targets")).alias("model"))
    rule = F.struct(F.array(F.struct(F.lit("main").alias("datasourceUid"), F.struct(expr).alias("model"))).alias("data"))
    link = F.concat(F.lit("explore?panes="), F.url_encode(F.to_json(F.struct(F.struct(F.lit("cold").alias("datasource"), F.array(F.struct(expr)).alias("queries")).alias("x")))))
    history = F.struct(F.lit("main").alias("datasourceUid"), F.array(F.struct(expr)).alias("queries"))
    n = F.col("query_id") % 4
    pick = lambda *four: F.when(n == 0, four[0]).when(n == 1, four[1]).when(n == 2, four[2]).otherwise(four[3])
    docs = _documents(spark, d, pick(*map(F.lit, ("library", "rule", "link", "history"))), _id(), pick(F.to_json(library), F.to_json(rule), link, F.to_json(history)))
    return db.read_documents(docs, _SOURCES).where("gap is null").select("origin", "expr")


@_query("""SELECT coalesce(component, 'none') AS namespace, CASE query_id % 3 WHEN 0 THEN 'alert' WHEN 1 THEN 'record' END AS kind, count(*) AS n, count(*) FILTER (query_id % 3 = 2 OR query_text IS NULL) AS gaps
        FROM executed_queries GROUP BY 1, 2""")
def ruler_files(spark: SparkSession, d: str) -> DataFrame:
    """Rules of a ruler, one group for each query; a rule is an alert or a record, any other is a gap."""
    n = F.col("query_id") % 3
    rule = F.struct(F.when(n == 0, "a").alias("alert"), F.when(n == 1, "r").alias("record"), F.col("query_text").alias("expr"))
    group = F.struct(F.lit("g").alias("name"), F.array(rule).alias("rules"))
    docs = table(spark, d, "executed_queries").select(F.to_json(F.create_map(F.coalesce("component", F.lit("none")), F.array(group))).alias("body"))
    return db.ruler_rules(docs).groupBy("namespace", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("gap").alias("gaps"))


@_query(f"SELECT query_id, query_text = (SELECT min(query_text) FROM executed_queries WHERE {_KEPT}) AS changed FROM executed_queries WHERE query_text IS NOT NULL")
def replaced_expressions(spark: SparkSession, d: str) -> DataFrame:
    """Stored documents with one query written anew wherever it stands."""
    q = table(spark, d, "executed_queries").where("query_text is not null")
    old = q.where(F.trim(F.translate("query_text", " \t\r\n\u000b\u000c\u001c\u001d\u001e\u001f\u0085", "           ")) != "").agg(F.min("query_text")).first()[0]
    docs = q.select("query_id", F.to_json(F.struct(F.array(F.struct(F.col("query_text").alias("expr"))).alias("panels"))).alias("body"))
    return db.replace_expressions(docs, {old: "1"} if old is not None else {}).select("query_id", (F.col("replaced") > 0).alias("changed"))


@_query("""SELECT query_id, CASE WHEN list_has_any(s, ['grafana']) THEN 'read' WHEN len(list_filter(s, lambda x: x NOT IN ('grafana', 'cli'))) > 0 THEN 'unknown' ELSE 'other' END AS relevance
        FROM (SELECT query_id, coalesce(sources, []) AS s FROM executed_queries)""")
def datasource_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Which queries' sources are analysed, known, or unknown."""
    q = table(spark, d, "executed_queries").select("query_id", F.coalesce(F.filter("sources", lambda x: x.isNotNull()), F.array().cast("array<string>")).alias("datasources"))
    return db.classify_sources(q, ("grafana",), ("grafana", "cli")).select("query_id", "relevance")


@_query("SELECT service AS name, min(least(a, coalesce(b, a))) AS v FROM (SELECT service, min(samples) AS a, max(samples) AS b FROM candidates WHERE service IS NOT NULL GROUP BY 1) GROUP BY 1")
def stable_lists(spark: SparkSession, d: str) -> DataFrame:
    """A list read twice while it changed: every object once."""
    c = table(spark, d, "candidates").where("service is not null").groupBy(F.col("service").alias("name"))
    return db.stable_union(c.agg(F.max("samples").alias("v")), c.agg(F.min("samples").alias("v")))


@_query("SELECT DISTINCT labels['service_name'] AS service FROM log_entries WHERE labels['service_name'] IS NOT NULL AND labels['service_name'] NOT IN (SELECT service FROM candidates WHERE service IS NOT NULL)")
def unlisted_services(spark: SparkSession, d: str) -> DataFrame:
    """What a search finds and no list holds."""
    found = table(spark, d, "log_entries").select(F.col("labels")["service_name"].alias("service")).where("service is not null").distinct()
    return db.unlisted(found, table(spark, d, "candidates").where("service is not null").select("service").distinct(), "service")


# --- A search store ----------------------------------------------------------------------------------------------------

#: Requests of the audit: by user, one path and method in seven, over indices of the kind of event.
_REQUEST = """CASE user_id % 7 WHEN 0 THEN 'POST /log-' || event_type || '/_search' WHEN 1 THEN 'POST /_msearch' WHEN 2 THEN 'GET /log-*,_all/_count' WHEN 3 THEN 'PUT /log-' || event_type || '/_doc/1'
    WHEN 4 THEN 'POST /log-view,log-click/_search' WHEN 5 THEN 'POST /_bulk' ELSE 'GET /log-' || event_type || '/_doc/4' END"""
_AUDIT = f"""audit AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS ts_ms, {_REQUEST} AS request, CASE WHEN user_id % 2 = 0 THEN NULL ELSE event_type END AS asked FROM events),
    used AS (SELECT 'u' || (user_id % 5)::VARCHAR AS origin, ts_ms, user_id % 7 AS r, event_type, asked FROM audit WHERE user_id % 7 NOT IN (3, 5)),
    folded AS (SELECT origin, CASE r WHEN 0 THEN 'log-' || event_type WHEN 4 THEN 'log-click,log-view' WHEN 6 THEN 'log-' || event_type ELSE '' END AS indices,
        CASE WHEN r IN (0, 2, 4) AND asked IS NOT NULL THEN asked END AS asked, r IN (1, 6) AS opaque, count(*) AS n, max(ts_ms) AS last_ms FROM used GROUP BY 1, 2, 3, 4)"""


def _audited(spark: SparkSession, d: str) -> DataFrame:
    request = F.split(F.expr(_REQUEST.replace("::VARCHAR", "")), " ", 2)
    stamp = F.expr("unix_millis(cast(ts as timestamp))")
    clause = lambda since, app: F.struct(since.alias("range"), app.alias("term"))
    since, app = F.struct(F.struct(stamp.alias("gte")).alias("ts")), F.struct(F.col("event_type").alias("app"))
    clauses = F.array(clause(since, F.lit(None)), clause(F.lit(None), app))
    asks = F.when(F.col("user_id") % 2 != 0, F.struct(F.struct(clauses.alias("filter")).alias("bool")))
    body = F.to_json(F.struct(F.lit(5).alias("size"), asks.alias("query")))
    return table(spark, d, "events").select(
        stamp.alias("ts_ms"), F.lit("REST").alias("layer"), F.lit("AUTHENTICATED").alias("category"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"), request[0].alias("method"), request[1].alias("path"), body.alias("body")
    )


@_query(f"WITH {_AUDIT} SELECT * FROM folded")
def audit_uses(spark: SparkSession, d: str) -> DataFrame:
    """Audited requests that may read, folded by user, indices and query; ranges make no difference."""
    uses = sa.audit_uses(_audited(spark, d), 0, 2**62)
    asked = F.get_json_object("query", "$.bool.filter[1].term.app")
    return uses.select("origin", F.array_join("indices", ",").alias("indices"), asked.alias("asked"), "opaque", "n", "last_ms")


@_query(f"""WITH {_AUDIT}, s AS (SELECT unnest(['view', 'error']) AS service)
        SELECT service, origin, count(*) AS n FROM folded JOIN s ON (indices = '' OR list_contains(string_split(indices, ','), 'log-' || service)) AND (opaque OR asked IS NULL OR asked = service) GROUP BY 1, 2""")
def scope_readers(spark: SparkSession, d: str) -> DataFrame:
    """Who may have read a service's documents."""
    catalog = sa.Catalog(("log-view", "log-click", "log-error", "log-signup", "log-purchase"))
    scopes = [sa.Scope((f"log-{s}",), "app", s).expanded(catalog) for s in ("view", "error")]
    uses = sa.audit_uses(_audited(spark, d), 0, 2**62).withColumn("source", F.lit("audit"))
    return sa.scoped_readers(uses, scopes).groupBy("service", "origin").agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT service AS id, list_aggregate(list_sort(list_distinct(list(title) FILTER (title IS NOT NULL))), 'string_agg', '|') AS titles, count(*) FILTER (title IS NULL) > 0 AS unresolved
        FROM (SELECT c.service, p.t AS title FROM candidates c LEFT JOIN (SELECT 'p' || k::VARCHAR AS id, 'idx-' || k::VARCHAR AS t FROM range(5) AS r(k)) p ON p.id = 'p' || (c.cand_id % 7)::VARCHAR WHERE service IS NOT NULL) GROUP BY 1""")
def saved_objects(spark: SparkSession, d: str) -> DataFrame:
    """Index patterns that saved objects name."""
    objects = table(spark, d, "candidates").where("service is not null").select(F.col("service").alias("id"), F.concat(F.lit("p"), (F.col("cand_id") % 7).cast("string")).alias("ref_id"))
    patterns = spark.range(5).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("pattern_id"), F.concat(F.lit("idx-"), F.col("id").cast("string")).alias("title"))
    return sa.saved_searches(objects, patterns).select("id", F.when(F.size("titles") > 0, F.array_join("titles", "|")).alias("titles"), "unresolved")


@_query("SELECT 'monitor:' || cand_id::VARCHAR || '/0' AS origin, CASE WHEN cand_id % 5 = 0 THEN '' ELSE 'idx-' || (cand_id % 5)::VARCHAR END AS indices, service IS NULL AS no_query, false AS opaque FROM candidates")
def monitor_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Searches of alerting monitors; _all names every index."""
    c = table(spark, d, "candidates")
    index = F.when(F.col("cand_id") % 5 == 0, "_all").otherwise(F.concat(F.lit("idx-"), (F.col("cand_id") % 5).cast("string")))
    query = F.struct(F.when(F.col("service").isNotNull(), F.struct(F.struct(F.col("service").alias("app")).alias("term"))).alias("query"))
    body = F.to_json(F.struct(F.col("cand_id").cast("string").alias("name"), F.array(F.struct(F.struct(F.array(index).alias("indices"), query.alias("query")).alias("search"))).alias("inputs")))
    return sa.monitors(c.select(body.alias("body"))).select("origin", F.array_join("indices", ",").alias("indices"), F.col("query").isNull().alias("no_query"), "opaque")


@_query("SELECT min(epoch_us(ts) // 1000) AS oldest_ms, min(epoch_us(ts) // 1000) <= 1704067200000 + 3600000 AS covers FROM events")
def audit_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether an audit log reaches back to a window's start."""
    e = table(spark, d, "events").select(F.expr("unix_millis(cast(ts as timestamp))").alias("ts_ms"))
    return sa.audit_reaches_back(e, 1_704_067_200_000, 3_600_000)


@_query("""SELECT count(*) FILTER (list_contains(severities, 'INFO')) AS documents, count(*) FILTER (severities IS NULL OR len(severities) = 0) AS missing, count(*) FILTER (len(list_distinct(severities)) > 1) AS several,
        count(*) FILTER (severities IS NOT NULL AND NOT list_contains(severities, 'INFO')) AS other FROM candidates""")
def scope_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whether a field that should hold one name does."""
    return sa.verified_scope(table(spark, d, "candidates").select("severities"), "severities", "INFO")


# --- Languages ---------------------------------------------------------------------------------------------------------


@_query("SELECT cand_id, regexp_matches(template_text, removal_regex) AS by_automaton, regexp_matches(template_text, removal_regex) AS by_java FROM candidates WHERE removal_regex IS NOT NULL AND template_text IS NOT NULL")
def regex_engines(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's expression held against its template: by the automaton, and printed for the JVM's engine."""
    c = table(spark, d, "candidates").where("removal_regex is not null and template_text is not null").select("cand_id", "removal_regex", "template_text")
    got = _map_rows(c, "cand_id long, text string, printed string, by_automaton boolean", lambda i, r, t: [(i, t, java(r), at.matches(at.compile(r), t))])
    return got.select("cand_id", "by_automaton", F.expr("regexp_like(text, printed)").alias("by_java"))


_WILD = r"(?i)(?:\b|_)(?:err|error|errors|warn|warning|fatal|crit|critical|panic|exception|fail|failed|failure|denied|refused|timeout|timed out|unavailable|declined|emerg|alert)(?:\b|_)"


@_query(f"SELECT template_text, regexp_matches(template_text, '{_WILD}') AS error_like FROM (SELECT DISTINCT template_text FROM skipped_templates WHERE template_text <> '')")
def error_like(spark: SparkSession, d: str) -> DataFrame:
    """Whether a language, here of one line, has lines that look like errors: an intersection of automata."""
    t = table(spark, d, "skipped_templates").where("template_text <> ''").select("template_text").distinct()
    # The distinct texts are few bytes and would be joined into few tasks.
    t = t.repartition(piece_count(t))
    return _map_rows(t, "template_text string, error_like boolean", lambda x: [(x, at.intersects(at.exactly(x), at.compile(decide.ERROR_WORDS)) is not None)])


_NAMES = "n AS (SELECT r_name AS region, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """region, names: the names of its nations; five rows."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("region")).agg(F.array_sort(F.collect_set("n_name")).alias("names"))


def _one_of(names) -> str:
    return rf"\A(?:{'|'.join(map(quote, names))})\z"


@_query(f"""WITH {_NAMES}, l AS (SELECT unnest(['A', 'I', 'UNITED', 'IA$', 'Z']) AS letter)
        SELECT region, letter, bool_or(regexp_matches(name, letter)) AS reads, bool_and(regexp_matches(name, letter)) AS within, bool_or(NOT regexp_matches(name, letter)) AS escapes FROM n, l GROUP BY 1, 2""")
def language_filters(spark: SparkSession, d: str) -> DataFrame:
    """Languages of names against filters: whether they meet, lie within, and leave a name over; every witness is checked."""

    def of(region, names):
        language = at.compile(_one_of(names))
        for letter in ("A", "I", "UNITED", "IA$", "Z"):
            f = at.compile(letter)
            inside, outside = at.witness([at.Term(language), at.Term(f)]), at.witness([at.Term(language), at.Term(f, True)])
            for w, ok in ((inside, True), (outside, False)):
                if w is not None and (w not in names or at.matches(f, w) != ok):
                    raise AssertionError(f"{w!r} is no witness")
            yield region, letter, inside is not None, at.subset(language, f), outside is not None

    return _map_rows(_regions(spark, d), "region string, letter string, reads boolean, within boolean, escapes boolean", of)


_GLOBS = ("A*", "*IA", "UN?TED *", "*[", "CHINA", "*")


@_query(f"SELECT p_type AS name, g AS pattern, p_type GLOB replace(g, '[', '[[]') AS overlaps FROM (SELECT DISTINCT p_type FROM part UNION SELECT n_name FROM nation), unnest({list(_GLOBS)}) AS u(g)")
def glob_names(spark: SparkSession, d: str) -> DataFrame:
    """Whether a glob's language holds a name."""
    names = table(spark, d, "part").select("p_type").union(table(spark, d, "nation").select("n_name")).distinct()
    return _map_rows(names, "name string, pattern string, overlaps boolean", lambda n: [(n, g, at.overlap(at.glob(g), at.compile(rf"\A{quote(n)}\z"))) for g in _GLOBS])


# --- Verdicts ----------------------------------------------------------------------------------------------------------


@_query("""WITH r AS (SELECT unnest(['view', 'click', 'signup', 'purchase', 'error']) AS service), u AS (SELECT DISTINCT user_id FROM events)
        SELECT service, user_id, length(user_id::VARCHAR) <= 4 AS used FROM r, u""")
def reader_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Rules against one query for each user, which asks for its lines in one service after another: decided, not run."""
    users = table(spark, d, "events").select("user_id").distinct()
    services = ["view", "click", "signup", "purchase", "error"]
    text = F.concat(F.lit('{service_name="'), F.col("service"), F.lit('"} |= "user '), F.col("user_id").cast("string"), F.lit(' did "'))
    queries = users.select("user_id", F.explode(F.array(*map(F.lit, services))).alias("service")).select((F.col("user_id") * 5 + F.array_position(F.array(*map(F.lit, services)), F.col("service")) - 1).alias("query_id"), text.alias("query"))
    rules = spark.createDataFrame([(r.id, r.service, r.language) for r in RULES if r.id != "r-signup-slow"], "id string, service string, language string")
    v = decide.verdicts(rules, queries)
    return v.select(F.element_at(F.array(*map(F.lit, services)), (F.col("query_id") % 5 + 1).cast("int")).alias("service"), F.expr("query_id div 5").alias("user_id"), "used")


_MATCHERS = ('="view"', '!="view"', '=~"v.*|click"', '!~".*e.*"', '=~""', '!=""')


@_query(f"""SELECT name, m, CASE m WHEN {' WHEN '.join(f"'{m}' THEN {c}" for m, c in zip(_MATCHERS, ("name = 'view'", "name <> 'view'", "regexp_full_match(name, 'v.*|click')", "NOT regexp_full_match(name, '.*e.*')", "name = ''", "name <> ''"), strict=True))} END AS passes
        FROM (SELECT DISTINCT labels['service_name'] AS name FROM log_entries WHERE labels['service_name'] IS NOT NULL UNION SELECT event_type FROM events), unnest([{", ".join(f"'{m}'" for m in _MATCHERS)}]) AS u(m)""")
def label_matchers(spark: SparkSession, d: str) -> DataFrame:
    """Matchers evaluated on label values, as verdicts do."""
    names = table(spark, d, "log_entries").select(F.col("labels")["service_name"].alias("name")).where("name is not null").union(table(spark, d, "events").select("event_type")).distinct()
    held = [(m, parse(f'{{a{m}, b="x"}}').root.matchers[0]) for m in _MATCHERS]
    return _map_rows(names, "name string, m string, passes boolean", lambda n: [(n, text, us.match_label(m, n)) for text, m in held])


@_query(f"""WITH {_NAMES}, f AS (SELECT unnest(['|= "A"', '|~ "A|E|I|O|U"', '!= "Z"', '|= "RUSSIA" or "CHINA" or "A"']) AS filter)
        SELECT region, filter, bool_and(CASE filter WHEN '|= "A"' THEN contains(name, 'A') WHEN '|~ "A|E|I|O|U"' THEN regexp_matches(name, 'A|E|I|O|U') WHEN '!= "Z"' THEN NOT contains(name, 'Z') ELSE contains(name, 'A') OR contains(name, 'RUSSIA') OR contains(name, 'CHINA') END) AS covered
        FROM n, f GROUP BY 1, 2""")
def covered_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether a query provably keeps every line of a rule."""

    def of(region, names):
        rule = us.Target("r", (("region", region),), _one_of(names))
        for f in ('|= "A"', '|~ "A|E|I|O|U"', '!= "Z"', '|= "RUSSIA" or "CHINA" or "A"'):
            sel = decide.readings(parse(f'{{region="{region}"}} {f}'))[0]
            yield region, f, us.covers(sel, rule)

    return _map_rows(_regions(spark, d), "region string, filter string, covered boolean", of)


@_query(f"""{_TAGGED}, v AS (SELECT hit AS rule, sum(octet_length(encode(line)))::DOUBLE AS bytes FROM tagged WHERE hit IS NOT NULL GROUP BY 1)
        SELECT rule, CASE WHEN rule IN ('r-view', 'r-error') THEN 'none' ELSE 'aggregate' END AS action, CASE WHEN rule IN ('r-view', 'r-error') THEN 0.0::DOUBLE ELSE round(bytes / 30, 6) END AS removed_per_day,
               CASE WHEN rule = 'r-view' THEN 1 ELSE 0 END AS readers FROM v""")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """What may be done about each rule: one is read, one is error-like, the others are aggregated. One row for each rule reaches the driver."""
    r = _records(spark, d)
    volumes = {x.rule: float(x.bytes) for x in mining.measure(r, F.col("service"), F.col("text"), RULES).collect()}
    candidates = [decide.Candidate(x.id, x.service, x.language, (("service_name", x.service),), bytes=volumes[x.id], window_hours=720.0) for x in RULES if x.id in volumes]
    found = decide.decide(candidates, [decide.UsedQuery("ruler", "a", 'sum(rate({service_name="view"} |= "did view" [5m]))')], policy=decide.Policy(("aggregate",)))
    return spark.createDataFrame([(x.candidate.id, x.action, round(x.removed_per_day, 6), len(x.readers)) for x in found], "rule string, action string, removed_per_day double, readers int")


@_query(f"{_TAGGED} SELECT rule, count(*) AS lines, count(*) AS passed FROM tagged WHERE rule IS NOT NULL GROUP BY 1")
def shadow_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rules that only measure: what each would take, and that all of it passes."""
    r = _records(spark, d)
    done = enforce.enforce(r, RULES, ("service", "pod"), shadow=True)
    passed = enforce.tag(done.kept, RULES).where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("passed"))
    return done.volume.select("rule", "lines").join(passed, "rule")


@_query("SELECT cand_id, 'r-' || substr(sha256(service || chr(0) || coalesce(field_name, '') || chr(0) || removal_regex), 1, 12) AS rule FROM candidates WHERE service IS NOT NULL AND removal_regex IS NOT NULL")
def rule_ids(spark: SparkSession, d: str) -> DataFrame:
    """Names of rules by what they remove."""
    c = table(spark, d, "candidates").where("service is not null and removal_regex is not null")
    return c.select("cand_id", mining.rule_id(F.col("service"), F.coalesce("field_name", F.lit("")), F.col("removal_regex")).alias("rule"))


@_query("""SELECT labels['service_name'] AS service_name, coalesce(nullif(labels['level'], ''), nullif(labels['cluster_zone'], ''), '') AS level, count(*) AS n FROM log_entries GROUP BY 1, 2""")
def severity_levels(spark: SparkSession, d: str) -> DataFrame:
    """The first of several keys that a stream holds."""
    level = mining.level_of(F.col("labels"), None, ["level", "cluster.zone"])
    return table(spark, d, "log_entries").groupBy(F.col("labels")["service_name"].alias("service_name"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


# --- Templates and their languages --------------------------------------------------------------------------------------

_SAMPLED = SQL_OF_RULES["stratified_sample"].replace("SELECT service, ts_ns, line AS text FROM r WHERE", ", s AS (SELECT service, ts_ns, line AS text, regexp_extract(line, 'user ([0-9]+) did', 1) AS who, regexp_extract(line, 'took ([0-9]+)ms', 1) AS took FROM r WHERE") + ")"
_WORD_OF = "CASE WHEN service = 'error' THEN 'ERROR' ELSE 'INFO' END"


@_query(f"{_SAMPLED} SELECT service, {_WORD_OF} || ' user <*> did ' || service || ' took <*>' AS template, count(*) AS n FROM s GROUP BY 1, 2")
def event_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates of the sample of each service; the sample is the feature."""
    sample = rule_queries.stratified_sample(spark, d)
    return mining.template_lines(sample, "service", "ts_ns", "text", mining.DrainConfig()).groupBy("service", "template").agg(F.count(F.lit(1)).alias("n"))


_BRACES = lambda lo, hi: f"CASE WHEN {lo} = {hi} THEN '{{' || {lo}::VARCHAR || '}}' ELSE '{{' || {lo}::VARCHAR || ',' || {hi}::VARCHAR || '}}' END"


@_query(rf"""{_SAMPLED}, a AS (SELECT service, count(*) AS n, count(DISTINCT who) AS whos, count(DISTINCT took) AS tooks, min(length(who)) AS wl, max(length(who)) AS wh, min(length(took)) AS tl, max(length(took)) AS th,
            string_agg(DISTINCT who, '|' ORDER BY who) AS who_list, string_agg(DISTINCT took || 'ms', '|' ORDER BY took || 'ms') AS took_list, min(who) AS one FROM s GROUP BY 1)
        SELECT service, n::INTEGER AS samples, '\A' || {_WORD_OF} || ' user ' || CASE WHEN whos = 1 THEN one WHEN whos <= 16 AND n >= 4 * whos THEN '(?:' || who_list || ')' ELSE '[0-9]' || {_BRACES("wl", "wh")} END || ' did ' || service || ' took '
            || CASE WHEN tooks <= 16 AND n >= 4 * tooks THEN '(?:' || took_list || ')' ELSE '[0-9]' || {_BRACES("tl", "th")} || 'ms' END || '\z' AS regex FROM a WHERE n >= 20""")
def event_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of each of those templates: fixed words, small sets of values, shapes of digits."""
    sample = rule_queries.stratified_sample(spark, d)
    templated = mining.template_lines(sample, "service", "ts_ns", "text", mining.DrainConfig())
    return mining.infer_languages(templated, "service", "text").where("regex is not null").select(F.col("key").alias("service"), "samples", "regex")


@_query(f"SELECT 'dashboard:' || min(query_id)::VARCHAR || '/panel:1/A' AS origin, query_text AS expr FROM executed_queries WHERE {_KEPT} GROUP BY component, query_text HAVING component IS NOT NULL")
def dashboard_views(spark: SparkSession, d: str) -> DataFrame:
    """Queries that stand in several views of one dashboard, once each: views are the queries of one component."""
    q = table(spark, d, "executed_queries").where("query_text is not null and component is not null")
    panel = F.struct(F.lit(1).alias("id"), F.lit("main").alias("datasource"), F.array(F.struct(F.lit("A").alias("refId"), F.col("query_text").alias("expr"))).alias("targets"))
    docs = q.select(F.xxhash64("component").alias("org"), F.lit("dashboard").alias("type"), F.lpad(_id(), 12, "0").alias("uid"), F.to_json(F.struct(F.array(panel).alias("panels"))).alias("body"))
    found = db.read_documents(docs, _SOURCES)
    # One board for each component, so that its views differ in what follows the name.
    one = found.withColumn("origin", F.regexp_replace("origin", "^dashboard:([0-9]+)", "dashboard:board/$1"))
    return db.drop_views(one).select(F.regexp_replace("origin", "^dashboard:board/0*([0-9]+)", "dashboard:$1").alias("origin"), "expr")


@_query("SELECT template_text, true AS raw, true AS quoted FROM (SELECT DISTINCT template_text FROM skipped_templates WHERE template_text IS NOT NULL)")
def string_literals(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as strings of the query language in either way, and read back."""
    t = table(spark, d, "skipped_templates").where("template_text is not null").select("template_text").distinct()
    return _map_rows(t, "template_text string, raw boolean, quoted boolean", lambda x: [(x, syntax.tokens(syntax.quote(x))[0].text == x, syntax.tokens(syntax.go_quote(x))[0].text == x)])


@_query("""SELECT kind, count(*) AS readers FROM (SELECT DISTINCT query_id, CASE u.k WHEN 0 THEN 'selector without a scope label' ELSE 'label filter' END AS kind FROM executed_queries, unnest([0, 1]) AS u(k)
        WHERE CASE u.k WHEN 0 THEN query_id % 2 = 0 ELSE query_id % 3 = 0 END) GROUP BY 1""")
def assumption_counts(spark: SparkSession, d: str) -> DataFrame:
    """What verdicts on a query for each row assume: some name no service, some filter by a label."""
    rule = us.Target("r", (("service_name", "kiln"),), r"\Akiln [0-9]+\z")

    def of(i):
        text = ("{pod=\"a\"}" if i % 2 == 0 else "{service_name=\"kiln\"}") + (" | json | depth > 3" if i % 3 == 0 else "")
        yield i, sorted({n.kind for s in decide.readings(parse(text)) for n in us.evaluate(s, rule).widened})

    readers = _map_rows(table(spark, d, "executed_queries").select("query_id"), "query_id long, kinds array<string>", of)
    return mining.assumption_histogram(readers, "kinds")


# --- Topologies --------------------------------------------------------------------------------------------------------

_CHAIN = """RECURSIVE reach AS (SELECT r_regionkey AS start, r_regionkey AS node FROM region UNION SELECT start, node + 1 FROM reach WHERE node < 4)"""


def _pipelines(spark: SparkSession, d: str) -> dict:
    """A pipeline for each region, which sends to its nations' exporters and on to the next region's pipeline."""
    n = table(spark, d, "nation").select("n_name", "n_regionkey").collect()
    regions = sorted(r[0] for r in table(spark, d, "region").select("r_regionkey").collect())
    return {
        "receivers": {"in": {}}, "exporters": {x.n_name: {} for x in n}, "connectors": {f"to/{k}": {} for k in regions[1:]},
        "service": {"pipelines": {f"logs/{k}": {"receivers": ["in"] if k == regions[0] else [f"to/{k}"], "exporters": [x.n_name for x in n if x.n_regionkey == k] + ([f"to/{k + 1}"] if k + 1 in regions else [])} for k in regions}},
    }


@_query(f"WITH {_CHAIN} SELECT 'logs/' || start::VARCHAR AS pipeline, n_name AS sink, n_name NOT IN ('CHINA', 'PERU') AS gap FROM reach JOIN nation ON n_regionkey = node")
def pipeline_sinks(spark: SparkSession, d: str) -> DataFrame:
    """What lies downstream of each pipeline of a collector, and which of it no evidence covers."""
    c = topology.Collector(_pipelines(spark, d))
    rows = []
    for p in c.pipelines:
        reach = c.downstream(p)
        gaps = {k for k, _ in topology.destination_gaps(reach, ("CHINA", "PERU"))}
        rows += [(p, s, f"sink:{s}" in gaps) for s in reach.sinks]
    return spark.createDataFrame(rows, "pipeline string, sink string, gap boolean")


@_query(f"WITH {_CHAIN} SELECT 'step' || start::VARCHAR AS node, n_name AS sink FROM reach JOIN nation ON n_regionkey = node")
def input_graph_sinks(spark: SparkSession, d: str) -> DataFrame:
    """The same where each component names its inputs."""
    n = table(spark, d, "nation").select("n_name", "n_regionkey").collect()
    regions = sorted({x.n_regionkey for x in n})
    g = topology.InputGraph({
        "sources": {"src": {}}, "transforms": {f"step{k}": {"inputs": ["src" if k == regions[0] else f"step{k - 1}.out"]} for k in regions}, "sinks": {x.n_name: {"inputs": [f"step{x.n_regionkey}*"]} for x in n},
    })
    return spark.createDataFrame([(f"step{k}", s) for k in regions for s in g.downstream(f"step{k}").sinks], "node string, sink string")


@_query("SELECT r_name AS tag, n_name AS output FROM region JOIN nation ON n_regionkey = r_regionkey")
def tag_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs that may get a tag, by globs."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()
    p = topology.TagPipeline(json.loads(json.dumps({"pipeline": {"outputs": [{"name": "x", "alias": x.n_name, "match": x.r_name[:3] + "*"} for x in n]}})))
    return spark.createDataFrame([(r, o) for r in sorted({x.r_name for x in n}) for o in p.receiving(r)], "tag string, output string")


# --- Functions in SQL --------------------------------------------------------------------------------------------------


@_query(f"WITH {_CELLS()} SELECT list_filter(cells, lambda x: x.k = 'level')[-1].v AS level, list_filter(cells, lambda x: x.k = 'component')[-1].v AS component, count(*) AS n FROM c WHERE form = 'good' GROUP BY 1, 2")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Registered functions from SQL: lines of good form by two of their cells."""
    functions.register(spark)
    form = f"^(?s: *({_PAIR}( +{_PAIR})*)? *)\\z"
    return spark.sql(
        "SELECT cells.level AS level, cells.component AS component, count(*) AS n FROM (SELECT logfmt(line) AS cells FROM {lines} WHERE line rlike '[^ \\\\s]' AND line rlike (SELECT max(re2_java(f)) FROM {forms})) GROUP BY 1, 2",
        lines=table(spark, d, "query_log"), forms=spark.createDataFrame([(form,)], "f string"),
    )
