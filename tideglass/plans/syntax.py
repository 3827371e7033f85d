"""The syntax tree: what a query says, before any data is looked at."""

from __future__ import annotations

from dataclasses import dataclass, field

SCALAR, VECTOR, MATRIX, STRING = "scalar", "instant vector", "range vector", "string"
COMPARISONS = ("==", "!=", "<", ">", "<=", ">=")
SETS = ("and", "or", "unless")
#: Of native histograms: what is above or below a value goes.
TRIMS = ("</", ">/")


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str


@dataclass
class Duration:
    """A duration that is computed: op is + - * / % ^ min max step range neg, or number (seconds)."""

    op: str
    args: list = field(default_factory=list)
    value: float = 0.0


@dataclass
class Number:
    value: float


@dataclass
class String:
    value: str


@dataclass
class Selector:
    name: str
    matchers: list[Matcher]
    offset: int | Duration = 0
    at: int | str | None = None  # ms, "start" or "end"
    mode: str = ""  # anchored or smoothed
    ignore_buckets: bool = False


@dataclass
class Matrix:
    selector: Selector
    range: int | Duration


@dataclass
class Subquery:
    expr: object
    range: int | Duration
    step: int | Duration
    offset: int | Duration = 0
    at: int | str | None = None


@dataclass
class Aggregate:
    op: str
    expr: object
    param: object = None
    labels: tuple[str, ...] = ()
    without: bool = False


@dataclass
class Matching:
    on: bool = False
    labels: tuple[str, ...] = ()
    card: str = "one-to-one"  # or group_left, group_right
    include: tuple[str, ...] = ()
    given: bool = False
    fill_left: float | None = None
    fill_right: float | None = None


@dataclass
class Binary:
    op: str
    lhs: object
    rhs: object
    bool: bool = False
    matching: Matching = field(default_factory=Matching)


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Paren:
    expr: object


@dataclass
class Unary:
    op: str
    expr: object


def unwrap(e):
    while isinstance(e, Paren):
        e = e.expr
    return e
