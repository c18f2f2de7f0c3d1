"""Graphs of log pipelines: what lies downstream of a point, and what there isn't accounted for. Tens of nodes, on the driver."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from brindle.relang import automaton as at
from brindle.relang.syntax import SyntaxFault


class BadTopology(ValueError):
    """A configuration that names what isn't there."""


def merge(*files: dict) -> dict:
    """Configurations laid over each other: maps merge deeply, later files win, lists are replaced."""
    out: dict = {}
    for f in files:
        for k, v in (f or {}).items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_yaml(text: str) -> dict:
    """A YAML document as a map; JSON is read where no YAML library is at hand."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text) or {}


def _names(v: object, where: str) -> list[str]:
    if v is None:
        return []
    if isinstance(v, str):
        return [v]
    if isinstance(v, list) and all(isinstance(x, str) for x in v):
        return v
    raise BadTopology(f"{where}: not a list of names")


@dataclass
class Reach:
    """sinks: name -> a path to it. derived: nodes that make something else of the lines, such as metrics. visited: nodes passed."""

    sinks: dict[str, list[str]]
    derived: list[str]
    visited: list[str]


def _walk(start: str, next_of: Callable[[str], Iterable[tuple[str, str, bool, bool]]]) -> Reach:
    """Closure from a node. next_of gives (edge, node, is a sink, is derived) of each way on; every node is passed once."""
    reach = Reach({}, [], [])
    seen: set[str] = set()
    todo: list[tuple[str, list[str]]] = [(start, [])]
    while todo:
        node, path = todo.pop()
        if node in seen:
            continue
        seen.add(node)
        for edge, to, sink, derived in next_of(node):
            here = [*path, edge]
            if derived and to not in reach.derived:
                reach.derived.append(to)
            if sink:
                reach.sinks.setdefault(to, here)
            else:
                todo.append((to, here))
    reach.derived.sort()
    reach.visited = sorted(seen)
    return reach


# --- A collector: pipelines of receivers, processors and exporters, joined by connectors --------------------------------


class Collector:
    def __init__(self, *files: dict):
        c = merge(*files)
        self.parts = {k: c.get(k) or {} for k in ("receivers", "processors", "exporters", "connectors")}
        self.pipelines: dict[str, dict[str, list[str]]] = {}
        for name, p in ((c.get("service") or {}).get("pipelines") or {}).items():
            self.pipelines[name] = {k: _names((p or {}).get(k), f"pipeline {name} {k}") for k in ("receivers", "processors", "exporters")}
            for kind, used in self.pipelines[name].items():
                known = set(self.parts[kind]) | (set(self.parts["connectors"]) if kind != "processors" else set())
                if missing := [u for u in used if u not in known]:
                    raise BadTopology(f"pipeline {name} uses undefined {kind} {missing}")

    def downstream(self, pipeline: str, after: int = -1) -> Reach:
        """What lines reach from a processor (-1: from the receivers): exporters, and connectors into pipelines of another signal as derived."""
        if pipeline not in self.pipelines:
            raise BadTopology(f"no pipeline {pipeline}")
        if not -1 <= after < len(self.pipelines[pipeline]["processors"]):
            raise BadTopology(f"pipeline {pipeline} has no processor {after}")
        signal = lambda name: name.split("/", 1)[0]
        derived: set[str] = set()

        def next_of(name: str):
            for e in self.pipelines[name]["exporters"]:
                if e not in self.parts["connectors"]:
                    yield f"{name}->{e}", e, True, False
                    continue
                for other, p in self.pipelines.items():
                    if e in p["receivers"]:
                        if signal(other) != signal(name):
                            derived.add(e)
                        yield f"{name}->{e}", other, False, False

        reach = _walk(pipeline, next_of)
        reach.derived = sorted(derived)
        return reach


# --- A graph of sources, transforms and sinks that name their inputs ---------------------------------------------------


def takes(reference: str, node: str) -> bool:
    """Whether an input names a node: exactly, by a named output of it, or by a pattern of either."""
    if reference == node or reference.startswith(node + "."):
        return True
    return any(c in reference for c in "*?[") and any(fnmatch.fnmatchcase(node, r) for r in (reference, reference.split(".", 1)[0]))


class InputGraph:
    def __init__(self, *files: dict):
        c = merge(*files)
        self.parts = {k: {n: x or {} for n, x in (c.get(k) or {}).items()} for k in ("sources", "transforms", "sinks")}
        self.inputs = {(k, n): _names(x.get("inputs"), f"{k} {n}") for k in ("transforms", "sinks") for n, x in self.parts[k].items()}

    def downstream(self, node: str) -> Reach:
        """Sinks that a source or transform feeds, and the transforms on the way that count lines."""
        if node not in self.parts["sources"] and node not in self.parts["transforms"]:
            raise BadTopology(f"no component {node}")

        def next_of(name: str):
            for (kind, other), refs in sorted(self.inputs.items()):
                if any(takes(r, name) for r in refs):
                    yield f"{name}->{other}", other, kind == "sinks", self.parts[kind][other].get("type") == "log_to_metric"

        return _walk(node, next_of)


# --- Plugins that choose records by their tag ---------------------------------------------------------------------------


class TagPipeline:
    """Filters in order and outputs, each with `match` (a glob) or `match_regex`; property names ignore case."""

    def __init__(self, *files: dict):
        p = merge(*files).get("pipeline") or {}
        lower = lambda xs: [{k.lower(): v for k, v in (x or {}).items()} for x in xs or []]
        self.filters, self.outputs = lower(p.get("filters")), lower(p.get("outputs"))

    @staticmethod
    def name(plugin: dict, i: int) -> str:
        return plugin.get("alias") or f"{plugin.get('name')}#{i}"

    @staticmethod
    def may_take(plugin: dict, tags: at.Pattern) -> bool:
        """Whether a plugin may get a record whose tag is of a language; one that can't be modelled may."""
        try:
            own = at.compile(plugin["match_regex"]) if plugin.get("match_regex") else at.glob(plugin["match"]) if plugin.get("match") else None
        except SyntaxFault:
            return True
        return own is not None and at.overlap(tags, own)

    def receiving(self, tag: str) -> list[str]:
        return sorted(self.name(o, i) for i, o in enumerate(self.outputs) if self.may_take(o, at.glob(tag)))

    def downstream(self, match: str, after: str = "") -> Reach:
        """Outputs that may get records of a glob of tags behind a filter, and later filters that send records on or count them."""
        first = 0
        if after:
            found = [i for i, f in enumerate(self.filters) if f.get("alias") == after]
            if not found:
                raise BadTopology(f"no filter with alias {after}")
            first = found[-1] + 1
        tags = at.glob(match)
        derived = [self.name(f, i) for i, f in enumerate(self.filters) if i >= first and str(f.get("name")).lower() in ("rewrite_tag", "log_to_metrics") and self.may_take(f, tags)]
        return Reach({self.name(o, i): [str(o.get("name"))] for i, o in enumerate(self.outputs) if self.may_take(o, tags)}, sorted(derived), [])


def destination_gaps(reach: Reach, read: Sequence[str], acknowledged: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(key, reason) of each destination whose readers aren't known: sinks that no evidence covers, and nodes that derive something of the lines."""
    gaps = [(f"sink:{s}", f"lines also reach {s}, whose readers are unknown ({' '.join(p)})") for s, p in sorted(reach.sinks.items()) if s not in read]
    gaps += [(f"derived:{d}", f"{d} derives something of the lines") for d in reach.derived]
    return [g for g in gaps if g[0] not in acknowledged]
