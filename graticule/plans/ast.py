"""Syntax trees of queries.  Times and durations are integer milliseconds."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str  # = != =~ !~
    value: str


class Expr:
    """Any node."""


@dataclass(frozen=True)
class Number(Expr):
    value: float


@dataclass(frozen=True)
class String(Expr):
    value: str


@dataclass(frozen=True)
class Selector(Expr):
    matchers: tuple[Matcher, ...]
    offset: int = 0
    at: int | str | None = None  # milliseconds, "start" or "end"


@dataclass(frozen=True)
class Matrix(Expr):
    selector: Selector
    range: int


@dataclass(frozen=True)
class Subquery(Expr):
    expr: Expr
    range: int
    step: int = 0  # 0: the default step
    offset: int = 0
    at: int | str | None = None


@dataclass(frozen=True)
class Paren(Expr):
    expr: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    expr: Expr


@dataclass(frozen=True)
class Matching:
    on: bool = False
    labels: tuple[str, ...] = ()
    group: str | None = None  # left or right: the many side
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    matching: Matching = field(default_factory=Matching)
    bool_: bool = False


@dataclass(frozen=True)
class Aggregate(Expr):
    op: str
    expr: Expr
    param: Expr | None = None
    grouping: tuple[str, ...] = ()
    without: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...] = ()
