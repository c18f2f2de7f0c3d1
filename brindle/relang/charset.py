"""Sets of code points as sorted ranges, Unicode classes and case-folding orbits."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache

TOP = sys.maxunicode
Ranges = tuple[tuple[int, int], ...]

SURROGATES: Ranges = ((0xD800, 0xDFFF),)


def union(ranges: Iterable[tuple[int, int]]) -> Ranges:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return tuple(out)


def negate(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for lo, hi in ranges:
        if at < lo:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= TOP:
        out.append((at, TOP))
    return tuple(out)


def intersect(a: Ranges, b: Ranges) -> Ranges:
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        lo, hi = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if lo <= hi:
            out.append((lo, hi))
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return tuple(out)


def contains(ranges: Ranges, c: int) -> bool:
    i = bisect_right(ranges, (c, TOP + 1))
    return bool(i) and ranges[i - 1][1] >= c


#: The classes of the syntax, in ASCII.
DIGIT: Ranges = ((0x30, 0x39),)
WORD: Ranges = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
SPACE: Ranges = ((0x09, 0x0A), (0x0C, 0x0D), (0x20, 0x20))
ANY: Ranges = ((0, TOP),)
NOT_NEWLINE: Ranges = ((0, 9), (11, TOP))
POSIX: dict[str, Ranges] = {
    "alnum": ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
    "alpha": ((0x41, 0x5A), (0x61, 0x7A)),
    "ascii": ((0, 0x7F),),
    "blank": ((9, 9), (0x20, 0x20)),
    "cntrl": ((0, 0x1F), (0x7F, 0x7F)),
    "digit": DIGIT,
    "graph": ((0x21, 0x7E),),
    "lower": ((0x61, 0x7A),),
    "print": ((0x20, 0x7E),),
    "punct": ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "space": ((9, 13), (0x20, 0x20)),
    "upper": ((0x41, 0x5A),),
    "word": WORD,
    "xdigit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)),
}


@lru_cache(maxsize=256)
def unicode_class(name: str) -> Ranges | None:
    """Ranges of a general category or script; None for an unknown name."""
    import regex

    if name == "Any":
        return ANY
    try:
        one = regex.compile(rf"\p{{{name}}}+")
    except regex.error:
        return None
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, TOP + 1))))
    shift = lambda i: i if i < 0xD800 else i + 0x800
    found = []
    for m in one.finditer(text):
        a, b = shift(m.start()), shift(m.end() - 1)
        found += [(a, 0xD7FF), (0xE000, b)] if a < 0xD800 <= b else [(a, b)]
    return union(found)


@lru_cache(maxsize=1)
def _orbits() -> dict[int, frozenset[int]]:
    """Code point -> all code points that simple case folding takes for the same, where there are several."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    # Most blocks have no letter with a case.
    blocks = (range(b, b + 256) for b in range(0, TOP + 1, 256) if not 0xD800 <= b < 0xE000)
    for c in (c for block in blocks if (t := "".join(map(chr, block))) != t.lower() or t != t.upper() or t != t.casefold() for c in block):
        if c in (0x130, 0x131):  # dotted and dotless i fold to themselves
            continue
        ch = chr(c)
        for other in (ch.lower(), ch.upper(), ch.casefold()):
            if len(other) == 1 and other != ch and ord(other) not in (0x130, 0x131):
                a, b = find(c), find(ord(other))
                if a != b:
                    root[max(a, b)] = min(a, b)
    groups: dict[int, set[int]] = {}
    for c in root:
        groups.setdefault(find(c), {find(c)}).add(c)
    return {c: frozenset(g) for g in groups.values() for c in g}


def orbit(c: int) -> frozenset[int]:
    return _orbits().get(c, frozenset((c,)))


@lru_cache(maxsize=4096)
def fold(ranges: Ranges) -> Ranges:
    """ranges with all that simple case folding takes for the same."""
    extra = []
    if sum(hi - lo for lo, hi in ranges) < 3000:
        members = (c for lo, hi in ranges for c in range(lo, hi + 1))
        extra = [(o, o) for c in members for o in orbit(c)]
    else:
        extra = [(o, o) for c, g in _orbits().items() if contains(ranges, c) for o in g]
    return union([*ranges, *extra])
