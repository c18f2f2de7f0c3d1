"""Queries that dashboards, alert rules, links and histories hold, read from their JSON documents.

Each document is walked by itself, so a table of documents is read by one pass without a shuffle. What can't be read is a gap row, never silence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_VARIABLE = re.compile(r"^\$\{?(\w+)(?::\w+)?\}?$|^\[\[(\w+)\]\]$")
#: Datasources of expressions that the server computes itself.
SERVER_SIDE = ("__expr__", "-100")


@dataclass(frozen=True)
class Datasource:
    uid: str
    name: str
    type: str
    default: bool = False


@dataclass
class Walk:
    """What one document holds. queries: (origin, datasource uids, text, hidden); gaps: (origin, reason); notes likewise."""

    sources: tuple[Datasource, ...]
    kind: str = "loki"
    libraries: frozenset[str] = frozenset()
    variables: dict[str, str] = field(default_factory=dict)
    queries: list[tuple[str, list[str], str, bool]] = field(default_factory=list)
    gaps: list[tuple[str, str]] = field(default_factory=list)
    notes: list[tuple[str, str]] = field(default_factory=list)

    def all_of_kind(self) -> list[str]:
        return sorted(s.uid for s in self.sources if s.type == self.kind)

    def standard(self) -> list[str]:
        return [s.uid for s in self.sources if s.default and s.type == self.kind]

    def resolve(self, ref: object) -> tuple[list[str], bool]:
        """(uids of the log datasources that a reference may mean, whether it names none and inherits)."""
        kind = ""
        if isinstance(ref, dict):
            kind = ref.get("type") or ""
            ref = ref.get("uid") or ref.get("name") or ""
            if not ref and not kind:
                return [], True
        if ref is None or ref == "" and not kind:
            return [], True
        text = str(ref)
        if text in ("default", "-- Default --"):
            return self.standard(), False
        if text in ("-- Mixed --", "-- Dashboard --", "-- Grafana --", "grafana", *SERVER_SIDE):
            return [], text == "-- Mixed --"
        m = _VARIABLE.match(text)
        if m:
            declared = self.variables.get(m[1] or m[2])
            # A variable of another kind of datasource reads no logs; one that isn't declared may mean any.
            return ([] if declared not in (None, "", self.kind) else self.all_of_kind()), False
        found = [s for s in self.sources if text in (s.uid, s.name)]
        if found:
            return [s.uid for s in found if s.type == self.kind], False
        if kind and kind != self.kind and not _VARIABLE.match(kind):
            return [], False
        # Unknown: it counts as a log datasource of its own.
        return [text] if text else self.all_of_kind(), False

    def add(self, origin: str, uids: list[str], text: object, hidden: bool) -> None:
        if uids and isinstance(text, str) and text.strip():
            self.queries.append((origin, uids, text, hidden))

    # Dashboards

    def dashboard(self, uid: str, spec: dict) -> None:
        origin = f"dashboard:{uid}"
        if isinstance(spec.get("elements"), dict):
            self._second(origin, spec)
        else:
            self._classic(origin, spec)

    def _classic(self, origin: str, spec: dict) -> None:
        listed = lambda v: [x for x in v or [] if isinstance(x, dict)] if isinstance(v, list) else []
        for v in listed((spec.get("templating") or {}).get("list")):
            if v.get("type") == "datasource" and v.get("name"):
                self.variables[v["name"]] = v.get("query") or ""
        for i, a in enumerate(listed((spec.get("annotations") or {}).get("list"))):
            target = a.get("target") if isinstance(a.get("target"), dict) else {}
            self.add(f"{origin}/annotation:{i}", self.resolve(a.get("datasource"))[0], target.get("expr") or a.get("expr"), a.get("enable") is False)
        self._panels(origin, listed(spec.get("panels")))

    def _panels(self, origin: str, panels: list[dict]) -> None:
        for p in panels:
            if isinstance(p.get("panels"), list):  # a row keeps its panels
                self._panels(origin, [x for x in p["panels"] if isinstance(x, dict)])
            where = f"{origin}/panel:{p.get('id')}"
            if isinstance(p.get("libraryPanel"), dict):
                self._library(where, p["libraryPanel"].get("uid"))
                continue
            own, inherits = self.resolve(p.get("datasource"))
            if inherits and not own:
                own = self.standard()
            for t in p.get("targets") or []:
                if isinstance(t, dict):
                    uids, inherits = self.resolve(t.get("datasource"))
                    self.add(f"{where}/{t.get('refId')}", own if inherits else uids, t.get("expr"), t.get("hide") is True)

    def _library(self, where: str, uid: object) -> None:
        if uid not in self.libraries:
            self.notes.append((where, f"library panel {uid!r} does not exist, so the panel reads nothing"))

    def _second(self, origin: str, spec: dict) -> None:
        inside = lambda v, *path: inside(v.get(path[0]) if isinstance(v, dict) else None, *path[1:]) if path else v
        for v in spec.get("variables") or []:
            if inside(v, "kind") == "DatasourceVariable" and inside(v, "spec", "name"):
                self.variables[v["spec"]["name"]] = inside(v, "spec", "pluginId") or ""
        for i, a in enumerate(spec.get("annotations") or []):
            uids, text = self._data_query(inside(a, "spec", "query"))
            self.add(f"{origin}/annotation:{i}", uids, text, inside(a, "spec", "enable") is False)
        for key, e in sorted(spec["elements"].items()):
            kind = inside(e, "kind")
            if kind == "LibraryPanel":
                self._library(f"{origin}/{key}", inside(e, "spec", "libraryPanel", "uid"))
            elif kind == "Panel":
                for i, q in enumerate(inside(e, "spec", "data", "spec", "queries") or []):
                    uids, text = self._data_query(inside(q, "spec", "query"))
                    self.add(f"{origin}/{key}/{i}", uids, text, inside(q, "spec", "hidden") is True)
            else:
                self.gaps.append((f"{origin}/{key}", f"unknown element kind {kind!r}"))

    def _data_query(self, q: object) -> tuple[list[str], object]:
        if not isinstance(q, dict):
            return [], None
        group = q.get("group") or ""
        name = (q.get("datasource") or {}).get("name") or ""
        text = (q.get("spec") or {}).get("expr")
        if group == self.kind or _VARIABLE.match(group):
            uids, inherits = self.resolve({"uid": name, "type": self.kind})
        elif group == "":
            uids, inherits = self.resolve(name)
        else:
            return [], None
        return (self.standard() if inherits else uids), text

    # Rules, links, history

    def rule(self, doc: dict) -> None:
        kind = "recordingrule" if doc.get("record") else "alertrule"
        for i, d in enumerate(doc.get("data") or []):
            if d.get("datasourceUid") not in SERVER_SIDE:
                self.add(f"{kind}:{doc.get('uid')}/{i}", self.resolve({"uid": d.get("datasourceUid")})[0], (d.get("model") or {}).get("expr"), False)

    def link(self, name: str, path: str) -> None:
        """An explore link; links to dashboards are read with the dashboards."""
        if not path.lstrip("/").startswith("explore"):
            return
        origin, found = f"shorturl:{name}", False
        try:
            args = parse_qs(urlsplit("/" + path.lstrip("/")).query)
            panes = {}
            if args.get("panes"):
                panes |= json.loads(args["panes"][0])
            for side in ("left", "right"):
                if args.get(side):
                    panes[side] = json.loads(args[side][0])
        except ValueError as e:
            self.gaps.append((origin, f"panes: {e}"))
            return
        for key, pane in panes.items():
            own = self.resolve(pane.get("datasource"))[0]
            for i, q in enumerate(pane.get("queries") or []):
                uids, inherits = self.resolve(q.get("datasource"))
                self.add(f"{origin}/{key}/{i}", own if inherits else uids, q.get("expr"), False)
                found = True
        if not found:
            self.gaps.append((origin, "explore link without readable queries"))

    def history(self, doc: dict) -> None:
        for i, q in enumerate(doc.get("queries") or []):
            uids, inherits = self.resolve(q.get("datasource"))
            self.add(f"history:{doc.get('uid')}/{i}", self.resolve({"uid": doc.get("datasourceUid")})[0] if inherits else uids, q.get("expr"), False)

    def correlation(self, doc: dict) -> None:
        config = doc.get("config") or {}
        if (config.get("type") or "query") == "query":
            self.add(f"correlation:{doc.get('uid')}", self.resolve({"uid": doc.get("targetUID")})[0], (config.get("target") or {}).get("expr"), False)


OUTPUT = "org long, origin string, datasources array<string>, expr string, hidden boolean, gap string, note string"


def read_documents(docs: DataFrame, datasources: tuple[Datasource, ...], kind: str = "loki", libraries: frozenset[str] = frozenset()) -> DataFrame:
    """org, origin, datasources, expr, hidden of each query that documents hold; rows with `gap` are what couldn't be read, with `note` what reads nothing.

    docs: org, type (dashboard, library, rule, link, history, correlation), uid, body (JSON; for a link the path). Null bodies and bodies that are no JSON object are gaps.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for org, t, uid, body in zip(b["org"], b["type"], b["uid"], b["body"], strict=True):
                w = Walk(datasources, kind, libraries)
                try:
                    if t == "link":
                        w.link(uid, body or "")
                    else:
                        doc = json.loads(body) if body else None
                        if not isinstance(doc, dict):
                            raise ValueError("not a JSON object")
                        if t == "dashboard":
                            w.dashboard(uid, doc)
                        elif t == "library":
                            w._panels(f"library:{uid}", [{k: v for k, v in (doc.get("model") or doc).items() if k != "libraryPanel"}])
                        elif t in ("rule", "history", "correlation"):
                            getattr(w, t)({"uid": uid} | doc)
                        else:
                            raise ValueError(f"unknown type {t!r}")
                except (ValueError, AttributeError, TypeError, RecursionError) as e:
                    w.gaps.append((f"{t}:{uid}", str(e)))
                rows += [(org, o, u, x, h, None, None) for o, u, x, h in w.queries]
                rows += [(org, o, [], None, None, g, None) for o, g in w.gaps]
                rows += [(org, o, [], None, None, None, n) for o, n in w.notes]
            yield pd.DataFrame(rows, columns=["org", "origin", "datasources", "expr", "hidden", "gap", "note"])

    return docs.select("org", "type", "uid", "body").mapInPandas(run, OUTPUT)


def drop_views(found: DataFrame) -> DataFrame:
    """found without dashboard queries that another view of the same dashboard holds as well: the first by origin stays."""
    board = F.regexp_extract("origin", r"^dashboard:([^/]*)", 1)
    key = Window.partitionBy("org", board, "expr", "datasources", "hidden").orderBy("origin")
    plain = found.where(F.col("gap").isNotNull() | F.col("note").isNotNull() | ~F.col("origin").startswith("dashboard:"))
    views = found.where(F.col("gap").isNull() & F.col("note").isNull() & F.col("origin").startswith("dashboard:"))
    return plain.unionByName(views.withColumn("__n", F.row_number().over(key)).where("__n = 1").drop("__n"))


def unlisted(searched: DataFrame, listed: DataFrame, by: str = "uid") -> DataFrame:
    """Objects that a search finds and no list holds: gaps."""
    return searched.join(listed.select(by), by, "left_anti")


def ruler_rules(docs: DataFrame, body: str = "body") -> DataFrame:
    """namespace, group, name, kind, expr, gap of ruler rules. docs: a JSON object namespace -> [{name, rules: [{alert | record, expr}]}] in each row.

    A rule has to be an alert or a record; any other is a gap.
    """
    j = docs.select(F.from_json(body, "map<string,array<struct<name:string,rules:array<struct<alert:string,record:string,expr:string>>>>>").alias("j"))
    g = j.select(F.explode("j").alias("namespace", "groups")).select("namespace", F.explode("groups").alias("g"))
    r = g.select("namespace", F.col("g.name").alias("group"), F.explode("g.rules").alias("r"))
    kind = F.when(F.col("r.alert").isNotNull(), "alert").when(F.col("r.record").isNotNull(), "record")
    gap = F.when(kind.isNull(), "neither an alert nor a recording rule").when(F.col("r.expr").isNull(), "a rule without an expression")
    return r.select("namespace", "group", F.coalesce("r.alert", "r.record").alias("name"), kind.alias("kind"), F.col("r.expr").alias("expr"), gap.alias("gap"))


def stable_union(*lists: DataFrame, by: str = "name") -> DataFrame:
    """Several readings of a list that may change while it is read: every object once, the first by its whole text where readings differ."""
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    rest = [c for c in every.columns if c != by]
    return every.groupBy(by).agg(F.min(F.struct(*rest)).alias("o")).select(by, "o.*") if rest else every.distinct()


def classify_sources(found: DataFrame, analysed: tuple[str, ...], known: tuple[str, ...]) -> DataFrame:
    """found with `relevance`: read (a datasource that is analysed), other (all are known and none is), unknown (a gap: it counts as read)."""
    ds = F.col("datasources")
    inside = lambda names: F.arrays_overlap(ds, F.array(*map(F.lit, names)).cast("array<string>"))
    strange = F.size(F.array_except(ds, F.array(*map(F.lit, known)).cast("array<string>"))) > 0
    return found.withColumn("relevance", F.when(inside(analysed), "read").when(strange, "unknown").otherwise("other"))


def without_credentials(url: str) -> str:
    """A datasource's address without user and password."""
    return re.sub(r"^([a-z][a-z0-9+.-]*://)[^/@]*@", r"\1", url, flags=re.IGNORECASE)


def replace_expressions(docs: DataFrame, rewrites: dict[str, str]) -> DataFrame:
    """docs with each query of rewrites (old text -> new) replaced wherever it stands as `expr` in a body, and `replaced`, how many were.

    A body is written anew only if something in it is replaced; one that is no JSON stays as it is.
    """
    held = dict(rewrites)

    def walk(v: object) -> tuple[object, int]:
        if isinstance(v, dict):
            out, n = {}, 0
            for k, x in v.items():
                if k == "expr" and isinstance(x, str) and x in held:
                    out[k], m = held[x], 1
                else:
                    out[k], m = walk(x)
                n += m
            return out, n
        if isinstance(v, list):
            pairs = [walk(x) for x in v]
            return [x for x, _ in pairs], sum(m for _, m in pairs)
        return v, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bodies, counts = [], []
            for text in b["body"]:
                try:
                    new, n = walk(json.loads(text)) if text else (None, 0)
                except (ValueError, RecursionError):
                    n = 0
                bodies.append(json.dumps(new, ensure_ascii=False) if n else text)
                counts.append(n)
            yield b.assign(body=bodies, replaced=counts)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInPandas(run, f"{kept}, replaced int")
