"""Texts of a language, and texts just outside it, for tests of verdicts and rules."""

from __future__ import annotations

import random

from brindle.relang import automaton as at
from brindle.relang import syntax as sx


def _text(node, rng: random.Random, more: int) -> str:
    if isinstance(node, sx.Chars):
        total = sum(b - a + 1 for a, b in node.ranges)
        k = rng.randrange(total)
        for a, b in node.ranges:
            if k <= b - a:
                return chr(a + k)
            k -= b - a + 1
    if isinstance(node, sx.Group):
        return _text(node.part, rng, more)
    if isinstance(node, sx.Repeat):
        high = node.low + more if node.high is None else min(node.high, node.low + more)
        return "".join(_text(node.part, rng, more) for _ in range(rng.randint(node.low, high)))
    if isinstance(node, sx.Alt):
        return _text(rng.choice(node.parts), rng, more)
    if isinstance(node, sx.Concat):
        return "".join(_text(p, rng, more) for p in node.parts)
    return ""  # an assertion or nothing


def members(expression: str, n: int, rng: random.Random, more: int = 3) -> list[str]:
    """Up to n texts that the expression matches, drawn from its tree and checked by the automaton. Surrogates are left out."""
    tree, pattern = sx.parse(expression), at.compile(expression)
    drawn = (_text(tree, rng, more) for _ in range(4 * n))
    return [t for t in drawn if not any(0xD800 <= ord(c) < 0xE000 for c in t) and at.matches(pattern, t)][:n]


def near_misses(expression: str, n: int, rng: random.Random, alphabet: str = "aZ0 -.") -> list[str]:
    """Up to n texts that the expression doesn't match, one edit away from texts that it matches."""
    pattern, out = at.compile(expression), []
    for text in members(expression, 4 * n, rng):
        k, c = rng.randrange(len(text) + 1), rng.choice(alphabet)
        edited = rng.choice([text[:k] + c + text[k:], text[:k] + text[k + 1 :], text[:k] + c + text[k + 1 :]])
        if not at.matches(pattern, edited):
            out.append(edited)
    return out[:n]
