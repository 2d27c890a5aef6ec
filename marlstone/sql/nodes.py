"""The syntax tree. Nodes are compared by value, which GROUP BY matching relies on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: int | float | str | None


@dataclass(frozen=True)
class Name(Expr):
    table: str | None
    column: str


@dataclass(frozen=True)
class Star(Expr):
    table: str | None = None


@dataclass(frozen=True)
class Variable(Expr):
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    arg: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Aggregate(Expr):
    name: str
    arg: Expr | None  # None: *
    distinct: bool = False


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    kind: str
    size: int | None


@dataclass(frozen=True)
class Case(Expr):
    subject: Expr | None
    branches: tuple[tuple[Expr, Expr], ...]
    default: Expr | None


@dataclass(frozen=True)
class Subquery(Expr):
    query: Select


# Conditions


@dataclass(frozen=True)
class Compare(Expr):
    op: str  # = <> < <= > >=
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Logic(Expr):
    op: str  # AND OR
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    arg: Expr


@dataclass(frozen=True)
class InList(Expr):
    arg: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    arg: Expr
    query: Select
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    arg: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class IsNull(Expr):
    arg: Expr
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    arg: Expr
    low: Expr
    high: Expr
    negated: bool


# Statements


@dataclass(frozen=True)
class TableName:
    name: str  # file, variable (with @) or temporary table (with #)
    schema: str | None = None


@dataclass(frozen=True)
class Source:
    table: TableName | Select
    alias: str | None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left
    source: Source
    on: Expr


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    source: Source | None = None
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    order: tuple[Order, ...] = ()
    distinct: bool = False
    top: Expr | None = None
    into: TableName | None = None
    unions: tuple[Select, ...] = ()
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class Update:
    target: TableName
    sets: tuple[tuple[str, Expr], ...]
    source: Source | None
    joins: tuple[Join, ...]
    where: Expr | None
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class Delete:
    target: TableName
    source: Source | None
    joins: tuple[Join, ...]
    where: Expr | None
    text: str = field(default="", compare=False)


@dataclass(frozen=True)
class Declare:
    name: str
    kind: str
    size: int | None
    value: Expr | None


@dataclass(frozen=True)
class Set:
    name: str
    value: Expr


@dataclass(frozen=True)
class If:
    condition: Expr
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class While:
    condition: Expr
    body: tuple
