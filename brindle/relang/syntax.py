"""Regular expressions in RE2 syntax: parser, and printer for java.util.regex, the engine of rlike.

The two engines read many constructs differently (end of text, dot, word boundary, white space, case folding, classes); the
printer writes every construct in a form that java.util.regex reads as RE2 does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from brindle.relang import charset as cs
from brindle.relang.charset import Ranges

MAX_REPEAT = 1000


class SyntaxFault(ValueError):
    """The text is no expression of the syntax."""


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Chars:
    ranges: Ranges
    #: Set where the construct is one literal character: that character, before case folding.
    literal: int | None = None


@dataclass(frozen=True)
class Concat:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    part: object
    low: int
    high: int | None
    greedy: bool


@dataclass(frozen=True)
class Group:
    part: object
    index: int
    name: str | None


#: Kinds: begin and end of text, begin and end of a line, word boundary and its opposite.
@dataclass(frozen=True)
class Assert:
    kind: str


def concat(parts: list):
    flat = [q for p in parts for q in (p.parts if isinstance(p, Concat) else (p,)) if not isinstance(q, Empty)]
    return Empty() if not flat else flat[0] if len(flat) == 1 else Concat(tuple(flat))


def alternate(parts: list):
    """Alternation; neighbouring single characters become one class, which no engine has to backtrack over."""
    out: list = []
    for p in parts:
        if out and isinstance(p, Chars) and isinstance(out[-1], Chars):
            out[-1] = Chars(cs.union([*out[-1].ranges, *p.ranges]))
        else:
            out.append(p)
    return out[0] if len(out) == 1 else Alt(tuple(out))


_PERL = {"d": cs.DIGIT, "w": cs.WORD, "s": cs.SPACE}
_CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}


class _Parser:
    def __init__(self, text: str):
        self.s, self.i, self.groups = text, 0, 0
        self.names: set[str] = set()
        self.flags = {"i": False, "m": False, "s": False, "U": False}

    def fault(self, why: str) -> SyntaxFault:
        return SyntaxFault(f"{why} at {self.i} in {self.s[:80]!r}")

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def parse(self):
        node = self.alternation(0)
        if self.i < len(self.s):
            raise self.fault("unexpected )")
        return node

    def alternation(self, depth: int):
        if depth > 1000:
            raise self.fault("nested too deep")
        branches, parts = [], []
        while self.i < len(self.s) and self.peek() != ")":
            if self.peek() == "|":
                self.i += 1
                branches.append(concat(parts))
                parts = []
                continue
            before = self.i
            atom = self.atom(depth)
            if atom is None:
                continue
            parts.append(self.repeated(atom, before))
        branches.append(concat(parts))
        return alternate(branches)

    def repeated(self, atom, start: int):
        times = 0
        while self.i < len(self.s):
            c = self.peek()
            if c in "*+?":
                low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
                self.i += 1
            elif c == "{" and (m := re.compile(r"\{(\d+)(?:(,)(\d*))?\}").match(self.s, self.i)):
                low = int(m[1])
                high = low if not m[2] else int(m[3]) if m[3] else None
                if low > MAX_REPEAT or (high or 0) > MAX_REPEAT or (high is not None and high < low):
                    raise self.fault("repeat count out of range")
                self.i = m.end()
            else:
                break
            times += 1
            if times > 1:
                raise self.fault("nested repetition operator")
            greedy = not self.flags["U"]
            if self.peek() == "?":
                self.i += 1
                greedy = not greedy
            atom = Repeat(atom, low, high, greedy)
            if _size(atom) > MAX_REPEAT:
                raise self.fault("repetitions multiply beyond the limit")
        return atom

    def chars(self, ranges: Ranges, literal: int | None = None) -> Chars:
        return Chars(cs.fold(ranges) if self.flags["i"] else ranges, literal)

    def atom(self, depth: int):
        c = self.peek()
        if c == "(":
            return self.group(depth)
        self.i += 1
        if c == "[":
            return self.bracket()
        if c == ".":
            return Chars(cs.ANY if self.flags["s"] else cs.NOT_NEWLINE)
        if c == "^":
            return Assert("line_begin" if self.flags["m"] else "text_begin")
        if c == "$":
            return Assert("line_end" if self.flags["m"] else "text_end")
        if c in "*+?":
            raise self.fault("nothing to repeat")
        if c == "\\":
            return self.escape()
        return self.chars(((ord(c), ord(c)),), ord(c))

    def group(self, depth: int):
        self.i += 1
        saved = dict(self.flags)
        index, name = None, None
        if self.peek() == "?":
            m = re.compile(r"\?(?:P?<(\w+)>|([imsU]*)(?:-([imsU]+))?([:)]))", re.ASCII).match(self.s, self.i)
            if m is None or (m[2] == "" and m[3] is None and m[4] == ")"):
                raise self.fault("bad group")
            self.i = m.end()
            if m[1]:
                if m[1] in self.names:
                    raise self.fault("group name stands twice")
                name = m[1]
                self.names.add(name)
                self.groups += 1
                index = self.groups
            else:
                for on, letters in ((True, m[2]), (False, m[3] or "")):
                    for x in letters:
                        self.flags[x] = on
                if m[4] == ")":
                    return None  # flags up to the end of this group
        else:
            self.groups += 1
            index = self.groups
        node = self.alternation(depth + 1)
        if self.peek() != ")":
            raise self.fault("missing )")
        self.i += 1
        self.flags = saved
        return Group(node, index, name) if index is not None else _Plain(node)

    def number(self, pattern: str, base: int) -> int:
        m = re.compile(pattern).match(self.s, self.i)
        if m is None:
            raise self.fault("bad escape")
        self.i = m.end()
        v = int(next(g for g in m.groups() if g is not None), base)
        if v > cs.TOP:
            raise self.fault("code point out of range")
        return v

    def escaped_char(self) -> int | None:
        """The code point of the escape at hand, None where it is no character."""
        c = self.peek()
        if not c:
            raise self.fault("trailing backslash")
        if c in _CONTROL:
            self.i += 1
            return _CONTROL[c]
        if c == "x":
            self.i += 1
            return self.number(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})", 16)
        if c in "01234567" and (c == "0" or re.compile(r"[1-7][0-7]{1,2}").match(self.s, self.i)):
            return self.number(r"([0-7]{1,3})", 8)
        if not c.isalnum() and c != "_" and ord(c) < 128 or c == "_":
            self.i += 1
            return ord(c)
        return None

    def class_escape(self) -> Ranges | None:
        c = self.peek()
        if c.lower() in _PERL:
            self.i += 1
            return self.named(_PERL[c.lower()], not c.islower())
        if c in ("p", "P"):
            m = re.compile(r"[pP](?:\{(\^?)([A-Za-z_]+)\}|([A-Z]))").match(self.s, self.i)
            ranges = cs.unicode_class(m[2] or m[3]) if m else None
            if ranges is None:
                raise self.fault("unknown character class")
            self.i = m.end()
            return self.named(ranges, (c == "P") != bool(m[1]))
        return None

    def named(self, ranges: Ranges, negated: bool) -> Ranges:
        """A named class: folded before it is negated."""
        if self.flags["i"]:
            ranges = cs.fold(ranges)
        return cs.negate(ranges) if negated else ranges

    def escape(self):
        c = self.peek()
        if c == "Q":
            end = self.s.find("\\E", self.i)
            text = self.s[self.i + 1 : end if end >= 0 else len(self.s)]
            self.i = end + 2 if end >= 0 else len(self.s)
            return concat([self.chars(((ord(x), ord(x)),), ord(x)) for x in text])
        if c == "E":
            self.i += 1
            return None
        simple = {"A": "text_begin", "z": "text_end", "b": "word", "B": "not_word"}.get(c)
        if simple:
            self.i += 1
            return Assert(simple)
        ranges = self.class_escape()
        if ranges is not None:
            return Chars(ranges)
        v = self.escaped_char()
        if v is None:
            raise self.fault("unknown escape")
        return self.chars(((v, v),), v)

    def bracket(self) -> Chars:
        negated = self.peek() == "^"
        self.i += negated
        found: list[tuple[int, int]] = []
        first = True
        while True:
            c = self.peek()
            if not c:
                raise self.fault("missing ]")
            if c == "]" and not first:
                self.i += 1
                break
            first = False
            if c == "[" and (m := re.compile(r"\[:(\^?)(\w+):\]").match(self.s, self.i)):
                if m[2] not in cs.POSIX:
                    raise self.fault("unknown class")
                found += self.named(cs.POSIX[m[2]], bool(m[1]))
                self.i = m.end()
                continue
            low = self.member()
            if not isinstance(low, int):
                found += low
                continue
            high = low
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                self.i += 1
                high = self.member()
                if not isinstance(high, int) or high < low:
                    raise self.fault("bad range")
            found.append((low, high))
        ranges = cs.union(found)
        if self.flags["i"]:
            ranges = cs.fold(ranges)
        return Chars(cs.negate(ranges) if negated else ranges)

    def member(self):
        c = self.peek()
        self.i += 1
        if c != "\\":
            return ord(c)
        ranges = self.class_escape()
        if ranges is not None:
            return ranges
        v = self.escaped_char()
        if v is None:
            raise self.fault("unknown escape in a class")
        return v


def _Plain(node):  # noqa: N802
    """A group without a number: one unit for what repeats it."""
    return node if not isinstance(node, Concat | Empty) else Concat((node,)) if isinstance(node, Concat) else node


def _size(node) -> int:
    """How many copies of its smallest part a tree of counted repetitions comes to."""
    if isinstance(node, Repeat):
        return max(1, node.high if node.high is not None else node.low) * _size(node.part)
    if isinstance(node, Group):
        return _size(node.part)
    if isinstance(node, Concat | Alt):
        return max((_size(p) for p in node.parts), default=1)
    return 1


@lru_cache(maxsize=4096)
def parse(text: str, flags: str = ""):
    """Tree of an expression; flags: letters of i, m, s, U that hold from the start."""
    p = _Parser(text)
    for f in flags:
        p.flags[f] = True
    return p.parse()


def group_names(node) -> list[str | None]:
    """Names of the numbered groups in order, None for those without."""
    if isinstance(node, Group):
        return [node.name, *group_names(node.part)]
    if isinstance(node, Repeat):
        return group_names(node.part)
    if isinstance(node, Concat | Alt):
        return [n for p in node.parts for n in group_names(p)]
    return []


def quote(text: str) -> str:
    """An expression that matches text itself."""
    return re.sub(r"([\\.+*?()|\[\]{}^$])", r"\\\1", text)


# --- Printer ---------------------------------------------------------------------------------------------------------

_W = "[0-9A-Z\\x{5f}a-z]"
_ASCII_WORD = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_ASCII_NO_WORD = rf"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))"


@dataclass(frozen=True)
class Dialect:
    """How an engine writes what engines read differently; the rest is written alike, classes as ranges of code points."""

    line_begin: str
    line_end: str
    word: str
    not_word: str
    nothing: str = r"[^\x{0}-\x{10ffff}]"
    text_begin: str = r"\A"
    text_end: str = r"\z"


JAVA = Dialect(r"(?:\A|(?<=\x{a}))", r"(?=\x{a}|\z)", _ASCII_WORD, _ASCII_NO_WORD)
RUST = Dialect("(?m:^)", "(?m:$)", r"(?-u:\b)", r"(?-u:\B)")
ONIGMO = Dialect("^", "$", _ASCII_WORD, _ASCII_NO_WORD, "(?!)")


def _point(c: int) -> str:
    ch = chr(c)
    return ch if ch.isascii() and ch.isalnum() else f"\\x{{{c:x}}}"


def _class(ranges: Ranges, d: Dialect) -> str:
    if ranges == cs.ANY:
        return r"[\x{0}-\x{10ffff}]"
    if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
        return _point(ranges[0][0])
    if not ranges:
        return d.nothing
    body = lambda rs: "".join(_point(a) if a == b else f"{_point(a)}-{_point(b)}" for a, b in rs)
    other = cs.negate(ranges)
    return f"[^{body(other)}]" if other and len(other) < len(ranges) else f"[{body(ranges)}]"


def print_for(node, d: Dialect, capture: bool = True) -> str:
    """The expression in an engine's dialect; flags are spelled out, so that none has to be set."""
    again = lambda n: print_for(n, d, capture)
    if isinstance(node, Empty):
        return "(?:)"
    if isinstance(node, Chars):
        return _class(node.ranges, d)
    if isinstance(node, Assert):
        return getattr(d, node.kind)
    if isinstance(node, Group):
        return f"({again(node.part)})" if capture else f"(?:{again(node.part)})"
    if isinstance(node, Concat):
        return "".join(f"(?:{again(p)})" if isinstance(p, Alt | Concat) else again(p) for p in node.parts)
    if isinstance(node, Alt):
        return "|".join(map(again, node.parts))
    inner = again(node.part)
    if not isinstance(node.part, Chars | Group):
        inner = f"(?:{inner})"
    count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((node.low, node.high))
    if count is None:
        count = f"{{{node.low}}}" if node.high == node.low else f"{{{node.low},{'' if node.high is None else node.high}}}"
    return inner + count + ("" if node.greedy else "?")


def to_java(node, capture: bool = True) -> str:
    return print_for(node, JAVA, capture)


def rust(text: str) -> str:
    """The expression for Rust's regex crate."""
    return print_for(parse(text), RUST)


def onigmo(text: str) -> str:
    """The expression for Onigmo with Ruby's syntax; white space is escaped, as some configurations split at it."""
    return print_for(parse(text), ONIGMO)


def backtracks_deeply(node) -> bool:
    """Whether java.util.regex recurses once for each turn of a loop: a repeated part that is more than one class.

    Such a loop overflows the stack of the JVM on a long text; those expressions are run on our own automaton instead.
    """
    if isinstance(node, Repeat):
        part = node.part
        while isinstance(part, Group):
            part = part.part
        if isinstance(part, Concat) and len(part.parts) == 1:
            part = part.parts[0]
        return (node.high is None or node.high > 50) and not isinstance(part, Chars) or backtracks_deeply(node.part)
    if isinstance(node, Group):
        return backtracks_deeply(node.part)
    if isinstance(node, Concat | Alt):
        return any(backtracks_deeply(p) for p in node.parts)
    return False


def java(text: str, anchored: bool = False, flags: str = "") -> str:
    """java.util.regex form of an RE2 expression: as a search, or anchored at both ends with dot for every character."""
    if anchored:
        return rf"\A(?:{to_java(parse(text, flags + 's'))})\z"
    return to_java(parse(text, flags))
