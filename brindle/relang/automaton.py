"""Questions about regular languages: does any text satisfy these terms, does one language lie in another.

An expression is compiled to a nondeterministic automaton; a question about several is a breadth-first search over the product of their
state sets, one representative code point for each class of code points that all automata treat alike. Assertions look at the
character before and the kind of the one after, so a state carries the kind of the last character and a step is taken per kind of the next.
A step after which a wanted expression can match no more isn't taken, and a question about one text only is answered by reading that text.
State sets are kept with the automaton, so that later questions about the same expression find them made.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

from brindle.relang import charset as cs
from brindle.relang import syntax as sx

#: A search that meets more states than this, or does more than WORK times as many steps, gives no answer.
STATES = 200_000
WORK = 16
MAX_NODES = 60_000
#: So many sets, rows and moves are kept for one automaton, and those of so many automata.
KEPT, KEPT_AUTOMATA = 200_000, 256


class Undecided(Exception):
    """The search was given up: the answer is unknown."""


# Kinds of a neighbouring character.
KINDS = NONE, WORD, NEWLINE, OTHER = range(4)


def kind_of(c: int) -> int:
    return NEWLINE if c == 10 else WORD if cs.contains(cs.WORD, c) else OTHER


_KIND_RANGES = {WORD: cs.WORD, NEWLINE: ((10, 10),), OTHER: cs.negate(cs.union([*cs.WORD, (10, 10)]))}


def _holds(kind: str, before: int, after: int) -> bool:
    if kind == "text_begin":
        return before == NONE
    if kind == "text_end":
        return after == NONE
    if kind == "line_begin":
        return before in (NONE, NEWLINE)
    if kind == "line_end":
        return after in (NONE, NEWLINE)
    edge = (before == WORD) != (after == WORD)
    return edge if kind == "word" else not edge


@dataclass(eq=False)
class Program:
    """eps[i]: silent moves (target, assertion or None). step[i]: (ranges, target) or None. accept: the accepting node."""

    eps: list[list[tuple[int, str | None]]] = field(default_factory=list)
    step: list[tuple[cs.Ranges, int] | None] = field(default_factory=list)
    start: int = 0
    accept: int = 0

    def node(self) -> int:
        if len(self.eps) >= MAX_NODES:
            raise Undecided("the automaton is too large")
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def build(self, t, to: int) -> int:
        """Node from which t leads to node `to`."""
        if isinstance(t, sx.Empty):
            return to
        if isinstance(t, sx.Chars):
            n = self.node()
            self.step[n] = (t.ranges, to)
            return n
        if isinstance(t, sx.Assert):
            n = self.node()
            self.eps[n].append((to, t.kind))
            return n
        if isinstance(t, sx.Group):
            return self.build(t.part, to)
        if isinstance(t, sx.Concat):
            for p in reversed(t.parts):
                to = self.build(p, to)
            return to
        if isinstance(t, sx.Alt):
            n = self.node()
            self.eps[n] += [(self.build(p, to), None) for p in t.parts]
            return n
        if t.high is None:
            loop = self.node()
            self.eps[loop] += [(self.build(t.part, loop), None), (to, None)]
            to = loop
        else:
            for _ in range(t.high - t.low):
                n = self.node()
                self.eps[n] += [(self.build(t.part, to), None), (to, None)]
                to = n
        for _ in range(t.low):
            to = self.build(t.part, to)
        return to

    def closure(self, nodes: frozenset[int], before: int, after: int) -> frozenset[int]:
        """Nodes reachable by silent moves between a character of kind `before` and one of kind `after`."""
        seen, todo = set(nodes), list(nodes)
        while todo:
            for to, a in self.eps[todo.pop()]:
                if to not in seen and (a is None or _holds(a, before, after)):
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def lasting(self) -> set[int]:
        """Nodes that may lead to acceptance once a character was read; from all others there is no way."""
        into: list[list[int]] = [[] for _ in self.eps]
        for n, (moves, step) in enumerate(zip(self.eps, self.step, strict=True)):
            for to, a in moves:
                if a != "text_begin":
                    into[to].append(n)
            if step and step[0]:
                into[step[1]].append(n)
        seen, todo = {self.accept}, [self.accept]
        while todo:
            new = [n for n in into[todo.pop()] if n not in seen]
            seen.update(new)
            todo += new
        return seen


class _Gap:
    """The nodes reached between two characters, as far as searches ask about them. to: the next character -> the nodes behind it."""

    __slots__ = ("accepts", "edges", "steps", "to", "within")


class _Row(dict):
    """Nodes behind a character, or at the beginning, as a state of the deterministic form: the next character -> its row, True where a match is found."""

    __slots__ = ("before", "nodes")


class _Known:
    """What was found out about an automaton; a search enters it at every character, as the match may begin anywhere."""

    def __init__(self, program: Program):
        self.program, self.start = program, frozenset((program.start,))
        self.gaps: dict = {}
        self.rows: dict = {}
        self.ways: dict = {}
        self.size = 0

    @cached_property
    def lasting(self) -> set[int]:
        return self.program.lasting()

    @cached_property
    def anchored(self) -> bool:
        """Whether a match can begin at the beginning only."""
        return self.program.start not in self.lasting

    def count(self) -> None:
        self.size += 1
        if self.size > KEPT:
            self.gaps, self.rows, self.ways, self.size = {}, {}, {}, 0

    def gap(self, nodes: frozenset[int], before: int, after: int) -> _Gap:
        """Between a character of kind `before`, which led to these nodes, and one of kind `after`."""
        g = self.gaps.get((nodes, before, after))
        if g is None:
            self.count()
            closed = self.program.closure(nodes | self.start, before, after)
            g = self.gaps[nodes, before, after] = _Gap()
            g.accepts, g.steps, g.to = self.program.accept in closed, [s for n in closed if (s := self.program.step[n])], {}
            g.edges = g.within = None
        return g

    def ask(self, g: _Gap, after: int) -> None:
        """Set a gap's edges and, where a match must go on with the next character, the code points of that kind that it can go on with."""
        g.edges = {e for ranges, _ in g.steps for lo, hi in ranges for e in (lo, hi + 1)}
        if self.anchored and after != NONE:
            g.within = cs.intersect(cs.union(r for ranges, to in g.steps if to in self.lasting for r in ranges), _KIND_RANGES[after])

    def onward(self, nodes: frozenset[int], before: int) -> list[int]:
        """The kinds of the next character with which a match is found or may still be."""
        kinds = self.ways.get((nodes, before))
        if kinds is None:
            self.count()
            kinds = self.ways[nodes, before] = []
            for after in KINDS:
                g = self.gap(nodes, before, after)
                if g.edges is None:
                    self.ask(g, after)
                if g.accepts or after != NONE and g.within != ():
                    kinds.append(after)
        return kinds

    def behind(self, g: _Gap, c: int) -> frozenset[int]:
        nodes = g.to.get(c)
        if nodes is None:
            self.count()
            nodes = g.to[c] = frozenset(to for ranges, to in g.steps if cs.contains(ranges, c))
        return nodes

    def row(self, nodes: frozenset[int], before: int) -> _Row:
        r = self.rows.get((nodes, before))
        if r is None:
            self.count()
            r = self.rows[nodes, before] = _Row()
            r.nodes, r.before = nodes, before
        return r

    def follow(self, row: _Row, c: str) -> _Row | bool:
        self.count()
        after = kind_of(ord(c))
        g = self.gap(row.nodes, row.before, after)
        row[c] = found = g.accepts or self.row(self.behind(g, ord(c)), after)
        return found


@lru_cache(maxsize=KEPT_AUTOMATA)
def _known(program: Program) -> _Known:
    return _Known(program)


@dataclass(frozen=True)
class Pattern:
    """A compiled expression with search meaning: it matches a text that holds a match anywhere. only: the one text that it matches, None where it isn't one given text."""

    text: str
    tree: object
    only: str | None = field(default=None, compare=False, repr=False)

    @cached_property
    def program(self) -> Program:
        p = Program()
        p.accept = p.node()
        p.start = p.build(self.tree, p.accept)
        return p


def _spelled(tree) -> str | None:
    r"""The text of a tree that is one text between \A and \z."""
    parts = tree.parts if isinstance(tree, sx.Concat) else ()
    if len(parts) < 2 or parts[0] != _BEGIN or parts[-1] != _END:
        return None
    points = [p.ranges[0][0] for p in parts[1:-1] if isinstance(p, sx.Chars) and len(p.ranges) == 1 and p.ranges[0][0] == p.ranges[0][1] and not 0xD800 <= p.ranges[0][0] <= 0xDFFF]
    return "".join(map(chr, points)) if len(points) == len(parts) - 2 else None


_BEGIN, _END = sx.Assert("text_begin"), sx.Assert("text_end")


@lru_cache(maxsize=8192)
def compile(text: str, flags: str = "") -> Pattern:  # noqa: A001
    tree = sx.parse(text, flags)
    p = Pattern(text, tree, _spelled(tree))
    p.program  # noqa: B018  an automaton that is too large is found here
    return p


@lru_cache(maxsize=4096)
def _one(c: str) -> sx.Chars:
    return sx.Chars(((ord(c), ord(c)),), ord(c))


def exactly(text: str) -> Pattern:
    """A pattern of that text alone, made without reading an expression."""
    tree = sx.Concat((_BEGIN, *map(_one, text), _END))
    return Pattern(rf"\A{sx.quote(text)}\z", tree, text)


def literal(text: str) -> Pattern:
    return compile(sx.quote(text))


def glob(pattern: str) -> Pattern:
    """A whole-text pattern in which * stands for any text."""
    return compile(r"\A(?s:" + ".*".join(map(sx.quote, pattern.split("*"))) + r")\z")


def matches(p: Pattern, text: str) -> bool:
    """Whether the text holds a match, by simulation: linear in the text, no recursion."""
    if p.only is not None:
        return text == p.only
    known = _known(p.program)
    row = known.row(frozenset(), NONE)
    for c in text:
        to = row.get(c)
        row = known.follow(row, c) if to is None else to
        if row is True:
            return True
    return known.gap(row.nodes, row.before, NONE).accepts


@dataclass(frozen=True)
class Term:
    pattern: Pattern
    negated: bool = False


_MATCHED = frozenset((-1,))


def _cells(edges: set[int], within: cs.Ranges) -> list[int]:
    """One code point of each class into which the edges cut the ranges; a space first where there is one."""
    if within[0][0] == within[-1][1]:
        return [c] if not 0xD800 <= (c := within[0][0]) <= 0xDFFF else []
    cuts = sorted(edges)
    reps = []
    for lo, hi in within:
        at = lo
        while at <= hi:
            i = bisect_right(cuts, at)
            end = min(hi, cuts[i] - 1) if i < len(cuts) else hi
            if at <= 0x20 <= end:
                reps.insert(0, 0x20)
            elif 0xD800 <= at <= 0xDFFF:
                if end > 0xDFFF:
                    reps.append(0xE000)
            else:
                # A letter or digit reads better in a witness than a control character.
                reps.append(next((x for x in (0x61, 0x30, 0x21, 0xE9) if at <= x <= end), at))
            at = end + 1
    return reps


def witness(terms: Sequence[Term], limit: int = STATES) -> str | None:
    """A shortest text that every positive term matches and no negated one, None where there is none; Undecided beyond the limit."""
    only = next((t.pattern.only for t in terms if not t.negated and t.pattern.only is not None), None)
    if only is not None:
        return only if all(matches(t.pattern, only) != t.negated for t in terms) else None
    held = [(_known(t.pattern.program), t.negated) for t in terms]
    lead = next((i for i, (known, neg) in enumerate(held) if not neg and known.anchored), None)
    empty = frozenset()
    first = (tuple(empty for _ in terms), NONE)
    parent: dict = {first: None}
    queue = deque([first])
    work = 0
    while queue:
        node = queue.popleft()
        states, before = node
        for after in KINDS if lead is None or states[lead] is _MATCHED else held[lead][0].onward(states[lead], before):
            gaps: list[_Gap | None] = []
            within = None if after == NONE else _KIND_RANGES[after]
            for (known, neg), s in zip(held, states, strict=True):
                if s is _MATCHED:
                    gaps.append(None)
                    continue
                g = known.gap(s, before, after)
                work += 1
                if g.accepts:
                    if neg:
                        break
                    gaps.append(None)
                    continue
                gaps.append(g)
                if g.edges is None:
                    known.ask(g, after)
                if not neg and g.within is not None:
                    within = g.within if within is _KIND_RANGES[after] else cs.intersect(within, g.within)
                    if not within:
                        break
            else:
                if after == NONE:
                    if all(neg or g is None for g, (_, neg) in zip(gaps, held, strict=True)):
                        return _text(parent, node)
                    continue
                edges = set().union(*(g.edges for g in gaps if g is not None)) if within[0][0] < within[-1][1] else ()
                for rep in _cells(edges, within):
                    work += len(gaps)
                    child = (tuple([_MATCHED if g is None else known.behind(g, rep) for g, (known, _) in zip(gaps, held, strict=True)]), after)
                    if child not in parent:
                        parent[child] = (node, rep)
                        if len(parent) > limit or work > WORK * limit:
                            raise Undecided("the search was given up")
                        queue.append(child)
    return None


def _text(parent: dict, node) -> str:
    out = []
    while parent[node] is not None:
        node, c = parent[node]
        out.append(chr(c))
    return "".join(reversed(out))


def intersects(a: Pattern, b: Pattern) -> str | None:
    """A text that both match."""
    return witness([Term(a), Term(b)])


def subset(a: Pattern, b: Pattern) -> bool:
    """Whether b matches every text that a matches."""
    return witness([Term(a), Term(b, True)]) is None


def overlap(a: Pattern, b: Pattern) -> bool:
    """Whether some text is matched by both; an undecided question counts as yes."""
    try:
        return intersects(a, b) is not None
    except Undecided:
        return True
