"""Tree of a LogQL query. Places in the text (spans) make no difference between equal trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Matcher:
    """label op value; a matcher that is one template variable has no op."""

    label: str
    op: str
    value: str


@dataclass(frozen=True)
class LineFilter:
    """A line passes if it fits one of the alternatives, or, negated, none of them. Alternatives: (kind, text), kind contains, regex, pattern or ip."""

    negated: bool
    alternatives: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Parse:
    """kind: json, logfmt, regexp, pattern, unpack. fields: (label, expression) asked for, none for all. text: expression of regexp and pattern."""

    kind: str
    fields: tuple[tuple[str, str], ...] = ()
    text: str = ""
    strict: bool = False
    keep_empty: bool = False


@dataclass(frozen=True)
class Decolorize:
    pass


@dataclass(frozen=True)
class LineFormat:
    template: str


@dataclass(frozen=True)
class LabelFormat:
    """(label, source, is a template) in order."""

    items: tuple[tuple[str, str, bool], ...]


@dataclass(frozen=True)
class Project:
    """drop, or keep: labels, each with a condition (op, value) or none."""

    keep: bool
    items: tuple[tuple[str, str, str], ...]


@dataclass(frozen=True)
class Unwrap:
    label: str
    conversion: str = ""


@dataclass(frozen=True)
class Compare:
    """label op value; kind: string, number, duration, bytes, ip or variable. value is text for string, ip and variable, else a number."""

    label: str
    op: str
    kind: str
    value: object


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


@dataclass(frozen=True)
class Keep:
    """A stage that keeps rows by a condition on labels: Compare, Both or Either."""

    condition: object
    source: str


@dataclass(frozen=True)
class VariableStage:
    name: str


@dataclass(frozen=True)
class LogQuery:
    matchers: tuple[Matcher, ...]
    stages: tuple
    #: Span of the selector and spans of the line filters in the text.
    selector: tuple[int, int] = field(default=(0, 0), compare=False)
    filters: tuple[tuple[int, int], ...] = field(default=(), compare=False)
    wrapped: bool = False


@dataclass(frozen=True)
class Grouping:
    without: bool
    labels: tuple[str, ...]
    #: Whether it was written with parentheses only around nothing.
    span: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class RangeAgg:
    func: str
    log: LogQuery
    range_text: str
    offset_text: str = ""
    param: float | None = None
    grouping: Grouping | None = None
    span: tuple[int, int] = field(default=(0, 0), compare=False)

    @property
    def plain(self) -> bool:
        """A selector and line filters only: no parameter, grouping, parentheses or other stage."""
        return self.param is None and self.grouping is None and not self.log.wrapped and all(isinstance(s, LineFilter) for s in self.log.stages)


@dataclass(frozen=True)
class VectorAgg:
    func: str
    inner: object
    param: float | None = None
    grouping: Grouping | None = None
    span: tuple[int, int] = field(default=(0, 0), compare=False)


@dataclass(frozen=True)
class Matching:
    ignoring: bool
    labels: tuple[str, ...]
    #: '', 'left' or 'right': the side with many rows for one of the other.
    many: str = ""
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    as_bool: bool = False
    matching: Matching | None = None


@dataclass(frozen=True)
class Negate:
    inner: object


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Vector:
    value: float


@dataclass(frozen=True)
class LabelReplace:
    inner: object
    target: str
    replacement: str
    source: str
    pattern: str


@dataclass(frozen=True)
class Variants:
    items: tuple
    of: RangeAgg


@dataclass
class Query:
    text: str
    root: object
    #: Log queries in the order in which they are completed in the text, with whether only counts of their lines are read.
    logs: list[tuple[LogQuery, bool]] = field(default_factory=list)
    ranges: list[RangeAgg] = field(default_factory=list)
    vectors: list[VectorAgg] = field(default_factory=list)
