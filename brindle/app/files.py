"""Files that the driver writes: atomically, with text that can't break out of its place; rules files that are checked when they are read."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from brindle.operators.enforce import ACTIONS, check_rules
from brindle.operators.mining import LineRule

RULES_VERSION = 1


def write_atomic(path: str | Path, data: str) -> None:
    """Write beside and rename; a file that exists keeps its permissions, a new one is the owner's alone."""
    path = Path(path)
    if path.is_symlink() and path.lstat().st_uid != os.getuid():
        raise PermissionError(f"{path} is another user's link")
    target = path.resolve()
    mode = target.stat().st_mode & 0o777 if target.exists() else 0o600
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(name, mode)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


#: Bytes that a job's summary page takes.
SUMMARY_BYTES = 1_000_000


def append_summary(path: str | Path, text: str, limit: int = SUMMARY_BYTES) -> None:
    """Add text to the summary page of a job. What the page has no room for is cut at a line's end, and the cut is told."""
    path = Path(path)
    room = limit - (path.stat().st_size if path.exists() else 0)
    data = text.encode()
    if len(data) > room:
        note = "\n\n(cut: the page is full)\n"
        data = data[: max(0, room - len(note))].rpartition(b"\n")[0] + note.encode() if room > len(note) else b""
    with open(path, "ab") as f:
        f.write(data)


def printable(text: str) -> str:
    """text with everything that a terminal or a page could obey spelled out."""
    return "".join(c if c.isprintable() else f"\\u{{{ord(c):x}}}" for c in text)


def code(text: str) -> str:
    """text as inline code of Markdown, whatever backticks it holds."""
    text = printable(text)
    runs = [len(r) for r in "".join(c if c == "`" else " " for c in text).split()]
    fence = "`" * (max(runs, default=0) + 1)
    pad = " " if text[:1] in ("`", " ", "") or text[-1:] in ("`", " ") else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def rule_key(service: str, field: str, language: str) -> str:
    """Id of a rule, derived from what it removes."""
    return "r-" + hashlib.sha256(f"{service}\0{field}\0{language}".encode()).hexdigest()[:12]


_RULE = {"id": str, "service": str, "field": str, "language": str, "action": str, "keep": int, "template": str}


def dump_rules(rules: list[LineRule], drain_digest: str, fields: dict[str, str] | None = None) -> str:
    rows = [{"id": r.id, "service": r.service, "field": (fields or {}).get(r.service, ""), "language": r.language, "action": r.action, "keep": r.keep, "template": r.template} for r in rules]
    return json.dumps({"version": RULES_VERSION, "templating": drain_digest, "rules": rows}, indent=1)


def load_rules(text: str, drain_digest: str | None = None) -> list[LineRule]:
    """Rules of a file: unknown keys, wrong types, ids that aren't derived from their rule, rules that overlap and another templating are refused."""

    def no_twice(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    doc = json.loads(text, object_pairs_hook=no_twice)
    if not isinstance(doc, dict) or set(doc) != {"version", "templating", "rules"} or doc["version"] != RULES_VERSION or not isinstance(doc["rules"], list):
        raise ValueError("not a rules file of this version")
    if drain_digest is not None and doc["templating"] != drain_digest:
        raise ValueError("the rules were made with another templating")
    out = []
    for r in doc["rules"]:
        if not isinstance(r, dict) or set(r) != set(_RULE) or any(type(r[k]) is not t for k, t in _RULE.items()):
            raise ValueError(f"bad rule {str(r)[:80]}")
        if r["id"] != rule_key(r["service"], r["field"], r["language"]):
            raise ValueError(f"{r['id']} is not the id of its rule")
        if r["action"] not in ACTIONS:
            raise ValueError(f"unknown action {r['action']!r}")
        out.append(LineRule(r["id"], r["service"], r["language"], r["action"], r["keep"], r["template"]))
    check_rules(out)
    return out


def differences(a: object, b: object, path: str = "") -> list[str]:
    """Paths at which two documents differ."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [x for k in sorted({*a, *b}) for x in (differences(a[k], b[k], f"{path}.{k}") if k in a and k in b else [f"{path}.{k}: {'missing' if k in a else 'added'}"])]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for i, (p, q) in enumerate(zip(a, b, strict=True)) for x in differences(p, q, f"{path}[{i}]")]
    return [] if a == b else [f"{path}: {json.dumps(a)[:60]} became {json.dumps(b)[:60]}"]


def deployed_difference(deployed: object, *expected: object) -> list[str]:
    """Differences of what is deployed from the closest of what it may be."""
    return min((differences(e, deployed) for e in expected), key=len)
