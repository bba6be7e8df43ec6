"""Trees of the dialect. Frozen, so equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

# ------------------------------------------------------------------ expressions


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: Any


@dataclass(frozen=True)
class Name(Expr):
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Param(Expr):
    number: int


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not(Expr):
    value: Expr


@dataclass(frozen=True)
class Negative(Expr):
    value: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    value: Expr


@dataclass(frozen=True)
class InList(Expr):
    value: Expr
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class InQuery(Expr):
    value: Expr
    query: Query


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Expr
    high: Expr


@dataclass(frozen=True)
class Like(Expr):
    value: Expr
    pattern: Expr
    ignore_case: bool


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Aggregate(Expr):
    name: str
    arg: Expr | None


# ---------------------------------------------------------------------- queries


@dataclass(frozen=True)
class Source:
    """A table, view or CTE by name, or a derived table."""

    name: str | None
    query: Query | None
    alias: str | None


@dataclass(frozen=True)
class Join:
    source: Source
    how: str
    on: Expr | None


@dataclass(frozen=True)
class Query:
    pass


@dataclass(frozen=True)
class Select(Query):
    items: tuple[tuple[Expr, str | None], ...]
    source: Source
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOp(Query):
    op: str
    all: bool
    left: Query
    right: Query


@dataclass(frozen=True)
class Ordered(Query):
    """ORDER BY, LIMIT and OFFSET over a whole query."""

    query: Query
    order: tuple[tuple[Expr, bool], ...]
    limit: int | None
    offset: int


@dataclass(frozen=True)
class With(Query):
    ctes: tuple[tuple[str, Query], ...]
    query: Query


# ------------------------------------------------------------------- statements


@dataclass(frozen=True)
class Insert:
    table: str
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, Expr], ...]
    where: Expr | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Expr | None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    length: int | None = None
    primary_key: bool = False
    not_null: bool = False
    unique: bool = False


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...]


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool


@dataclass(frozen=True)
class CreateView:
    name: str
    query: Query
    text: str


@dataclass(frozen=True)
class Drop:
    kind: str
    name: str


@dataclass(frozen=True)
class Transaction:
    action: str  # BEGIN, COMMIT, ROLLBACK, SAVEPOINT, RELEASE, ROLLBACK TO
    name: str | None = None


@dataclass(frozen=True)
class Explain:
    statement: Any
