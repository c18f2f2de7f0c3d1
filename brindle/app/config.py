"""Configuration: one strict document. Unknown keys and wrong types are refused."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import get_args, get_origin, get_type_hints

from brindle.operators.decide import ACTIONS, ERROR_WORDS
from brindle.operators.enforce import LEVEL_KEYS
from brindle.relang import syntax as sx


class BadConfig(ValueError):
    """The configuration can't be used."""


def window_hours(text: str) -> float:
    """Hours of a window such as 30m, 24h or 7d (at most 3650 days)."""
    m = re.fullmatch(r"(\d+)(s|m|h|d)", text)
    if m is None or m[2] == "d" and int(m[1]) > 3650 or int(m[1]) == 0:
        raise BadConfig(f"bad window {text!r}")
    return int(m[1]) * {"s": 1 / 3600, "m": 1 / 60, "h": 1.0, "d": 24.0}[m[2]]


@dataclass
class Discovery:
    window: str = "24h"
    slices: int = 24
    sample_lines: int = 5000


@dataclass
class Templating:
    depth: int = 4
    similarity: float = 0.4
    masks: dict[str, str] = field(default_factory=dict)
    seeds: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class PolicySection:
    actions: list[str] = field(default_factory=lambda: ["aggregate", "dedupe", "sample"])
    sample_percent: int = 10
    error_pattern: str = ERROR_WORDS
    exempt: list[str] = field(default_factory=list)
    acknowledged: list[str] = field(default_factory=list)
    min_daily_bytes: float = 0.0


@dataclass
class Pricing:
    per_gb: float = 0.0
    per_million_lines: float = 0.0


@dataclass
class Config:
    logs: str
    scope_label: str = "service_name"
    services: list[str] = field(default_factory=list)
    structured: dict[str, str] = field(default_factory=dict)
    severity_keys: list[str] = field(default_factory=list)
    query_log: str = ""
    ruler_rules: str = ""
    documents: str = ""
    discovery: Discovery = field(default_factory=Discovery)
    templating: Templating = field(default_factory=Templating)
    policy: PolicySection = field(default_factory=PolicySection)
    pricing: Pricing = field(default_factory=Pricing)

    def all_severity_keys(self) -> list[str]:
        return list(dict.fromkeys([*LEVEL_KEYS, *self.severity_keys]))


def _fits(value: object, hint: object) -> bool:
    if get_origin(hint) is list:
        return isinstance(value, list) and all(_fits(v, get_args(hint)[0]) for v in value)
    if get_origin(hint) is dict:
        return isinstance(value, dict) and all(_fits(k, get_args(hint)[0]) and _fits(v, get_args(hint)[1]) for k, v in value.items())
    if hint is float:
        return isinstance(value, int | float) and not isinstance(value, bool)
    return type(value) is hint


def _build(cls: type, doc: object, where: str):
    if not isinstance(doc, dict):
        raise BadConfig(f"{where or 'configuration'}: not a map")
    hints = get_type_hints(cls)
    if unknown := set(doc) - set(hints):
        raise BadConfig(f"{where}: unknown keys {sorted(unknown)}")
    out = {}
    for f in fields(cls):
        if f.name in doc:
            hint = hints[f.name]
            v = doc[f.name]
            if is_dataclass(hint):
                v = _build(hint, v, f"{where}.{f.name}".strip("."))
            elif not _fits(v, hint):
                raise BadConfig(f"{where}.{f.name}: wrong type".lstrip("."))
            out[f.name] = v
    try:
        return cls(**out)
    except TypeError as e:
        raise BadConfig(str(e)) from e


def load_config(doc: dict) -> Config:
    c = _build(Config, doc, "")
    window_hours(c.discovery.window)
    if c.discovery.slices < 1 or c.discovery.sample_lines < 1:
        raise BadConfig("discovery: slices and sample_lines are at least 1")
    if bad := set(c.policy.actions) - set(ACTIONS):
        raise BadConfig(f"policy: unknown actions {sorted(bad)}")
    if not 1 <= c.policy.sample_percent <= 99:
        raise BadConfig("policy: sample_percent is 1 to 99")
    for service, name in c.structured.items():
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
            raise BadConfig(f"structured {service}: {name!r} is not a plain field")
    for text in [c.policy.error_pattern, *(e for e in c.policy.exempt if not e.startswith("r-")), *c.templating.masks.values()]:
        try:
            sx.parse(text)
        except sx.SyntaxFault as e:
            raise BadConfig(str(e)) from e
    return c
