"""Statements of the dialect.

Expressions are parsed by binding power: OR, AND, NOT, predicates, sums, products,
sign. A statement must end where its grammar ends; only a semicolon may follow.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..functions import AGGREGATES, FUNCTIONS
from . import ast
from .lexer import ParseError, Token, tokenize

__all__ = ["ParseError", "parse"]

RESERVED = frozenset(
    "SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS OUTER ON AND OR NOT IN IS NULL LIKE ILIKE BETWEEN "
    "AS BY ASC DESC DISTINCT ALL WITH INSERT INTO VALUES UPDATE SET DELETE CREATE DROP TRUE FALSE".split()
)
COMPARISONS = ("=", "!=", "<", ">", "<=", ">=")


def parse(sql: str) -> Any:
    return _Parser(sql).statement()


class _Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i, self.marks = sql, tokenize(sql), 0, 0

    # -- tokens

    @property
    def token(self) -> Token:
        return self.tokens[self.i]

    def _is(self, *texts: str, ahead: int = 0) -> bool:
        """Whether the next token is one of these key words or operators."""
        token = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return token.kind == "op" and token.text in texts or token.kind == "word" and token.text.upper() in texts

    def _take(self, *texts: str) -> str | None:
        if self._is(*texts):
            self.i += 1
            return self.tokens[self.i - 1].text.upper()
        return None

    def _need(self, *texts: str) -> str:
        found = self._take(*texts)
        if found is None:
            raise self._error(f"expected {' or '.join(texts)}")
        return found

    def _error(self, what: str) -> ParseError:
        found = self.token.text or "end of statement"
        return ParseError(f"{what}, found {found!r} at {self.token.at}")

    def _identifier(self) -> str:
        token = self.token
        if token.kind == "name" or token.kind == "word" and token.text.upper() not in RESERVED:
            self.i += 1
            return token.text
        raise self._error("expected a name")

    def _integer(self) -> int:
        if self.token.kind != "number" or not self.token.text.isdigit():
            raise self._error("expected a whole number")
        self.i += 1
        return int(self.tokens[self.i - 1].text)

    def _list(self, item: Callable[[], Any]) -> tuple:
        found = [item()]
        while self._take(","):
            found.append(item())
        return tuple(found)

    def _in_parentheses(self, item: Callable[[], Any]) -> Any:
        self._need("(")
        found = item()
        self._need(")")
        return found

    # -- statements

    def statement(self) -> Any:
        found = self._statement()
        while self._take(";"):
            pass
        if self.token.kind != "end":
            raise self._error("expected the end of the statement")
        return found

    def _statement(self) -> Any:
        if self._take("EXPLAIN"):
            return ast.Explain(self._statement())
        if self._is("SELECT", "WITH"):
            return self._query()
        if self._take("INSERT"):
            self._need("INTO")
            table = self._identifier()
            self._need("VALUES")
            return ast.Insert(table, self._list(lambda: self._in_parentheses(lambda: self._list(self._expr))))
        if self._take("UPDATE"):
            table = self._identifier()
            self._need("SET")
            return ast.Update(table, self._list(self._assignment), self._expr() if self._take("WHERE") else None)
        if self._take("DELETE"):
            self._need("FROM")
            return ast.Delete(self._identifier(), self._expr() if self._take("WHERE") else None)
        if self._take("CREATE"):
            return self._create()
        if self._take("DROP"):
            return ast.Drop(self._need("TABLE", "INDEX", "VIEW"), self._identifier())
        if action := self._take("BEGIN", "COMMIT"):
            return ast.Transaction(action)
        if self._take("ROLLBACK"):
            if not self._take("TO"):
                return ast.Transaction("ROLLBACK")
            self._take("SAVEPOINT")
            return ast.Transaction("ROLLBACK TO", self._identifier())
        if self._take("SAVEPOINT"):
            return ast.Transaction("SAVEPOINT", self._identifier())
        if self._take("RELEASE"):
            self._take("SAVEPOINT")
            return ast.Transaction("RELEASE", self._identifier())
        raise self._error("expected a statement")

    def _assignment(self) -> tuple[str, ast.Expr]:
        column = self._identifier()
        self._need("=")
        return column, self._expr()

    def _create(self) -> Any:
        if self._take("TABLE"):
            return self._create_table()
        if self._take("VIEW"):
            name = self._identifier()
            self._need("AS")
            at = self.token.at
            query = self._query()
            return ast.CreateView(name, query, self.sql[at : self.token.at].strip())
        unique = bool(self._take("UNIQUE"))
        self._need("INDEX")
        name = self._identifier()
        self._need("ON")
        return ast.CreateIndex(name, self._identifier(), self._in_parentheses(lambda: self._list(self._identifier)), unique)

    def _create_table(self) -> ast.CreateTable:
        name = self._identifier()
        columns: list[ast.ColumnDef] = []
        keys: list[ast.ForeignKey] = []
        primary: list[str] = []

        def element() -> None:
            if self._is("FOREIGN") and self._is("KEY", ahead=1):
                self.i += 2
                keys.append(self._foreign_key())
            elif self._is("PRIMARY") and self._is("KEY", ahead=1):
                self.i += 2
                primary.extend(self._in_parentheses(lambda: self._list(self._identifier)))
            else:
                columns.append(self._column())

        self._in_parentheses(lambda: self._list(element))
        primary = primary or [c.name for c in columns if c.primary_key]
        return ast.CreateTable(name, tuple(columns), tuple(primary), tuple(keys))

    def _column(self) -> ast.ColumnDef:
        name, kind = self._identifier(), self._identifier()
        length = self._in_parentheses(self._integer) if self._is("(") else None
        flags = {"primary_key": False, "not_null": False, "unique": False}
        while word := self._take("PRIMARY", "NOT", "UNIQUE"):
            if word != "UNIQUE":
                self._need("KEY" if word == "PRIMARY" else "NULL")
            flags[{"PRIMARY": "primary_key", "NOT": "not_null", "UNIQUE": "unique"}[word]] = True
        return ast.ColumnDef(name, kind.upper(), length, **flags)

    def _foreign_key(self) -> ast.ForeignKey:
        column = self._in_parentheses(self._identifier)
        self._need("REFERENCES")
        parent = self._identifier()
        parent_column = self._in_parentheses(self._identifier)
        actions = {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        while self._take("ON"):
            event = self._need("DELETE", "UPDATE")
            action = self._need("CASCADE", "RESTRICT", "SET")
            if action == "SET":
                self._need("NULL")
                action = "SET NULL"
            actions[event] = action
        return ast.ForeignKey(column, parent, parent_column, actions["DELETE"], actions["UPDATE"])

    # -- queries

    def _query(self) -> ast.Query:
        ctes = ()
        if self._take("WITH"):
            ctes = self._list(self._cte)
        query: ast.Query = self._select()
        while op := self._take("UNION", "INTERSECT", "EXCEPT"):
            every = bool(self._take("ALL"))
            query = ast.SetOp(op, every, query, self._select())
        order = ()
        if self._take("ORDER"):
            self._need("BY")
            order = self._list(self._order_key)
        limit, offset = None, 0
        while word := self._take("LIMIT", "OFFSET"):
            if word == "LIMIT":
                limit = self._integer()
            else:
                offset = self._integer()
        if order or limit is not None or offset:
            query = ast.Ordered(query, order, limit, offset)
        return ast.With(ctes, query) if ctes else query

    def _cte(self) -> tuple[str, ast.Query]:
        name = self._identifier()
        self._need("AS")
        return name, self._in_parentheses(self._query)

    def _order_key(self) -> tuple[ast.Expr, bool]:
        expr = self._expr()
        return expr, self._take("ASC", "DESC") != "DESC"

    def _select(self) -> ast.Select:
        self._need("SELECT")
        distinct = bool(self._take("DISTINCT"))
        items = self._list(self._item)
        self._need("FROM")
        source, joins = self._source(), []
        while self._is("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS"):
            joins.append(self._join())
        where = self._expr() if self._take("WHERE") else None
        group = ()
        if self._take("GROUP"):
            self._need("BY")
            group = self._list(self._expr)
        having = self._expr() if self._take("HAVING") else None
        return ast.Select(items, source, tuple(joins), where, group, having, distinct)

    def _item(self) -> tuple[ast.Expr, str | None]:
        if self._take("*"):
            return ast.Star(), None
        expr = self._expr()
        return expr, self._alias()

    def _alias(self) -> str | None:
        if self._take("AS"):
            return self._identifier()
        token = self.token
        if token.kind == "name" or token.kind == "word" and token.text.upper() not in RESERVED:
            return self._identifier()
        return None

    def _source(self) -> ast.Source:
        if self._is("("):
            return ast.Source(None, self._in_parentheses(self._query), self._alias())
        name = self._identifier()
        return ast.Source(name, None, self._alias())

    def _join(self) -> ast.Join:
        how = self._take("INNER", "LEFT", "RIGHT", "FULL", "CROSS") or "INNER"
        if how in ("LEFT", "RIGHT", "FULL"):
            self._take("OUTER")
        self._need("JOIN")
        source = self._source()
        if how == "CROSS":
            return ast.Join(source, "cross", None)
        self._need("ON")
        return ast.Join(source, how.lower(), self._expr())

    # -- expressions

    def _expr(self) -> ast.Expr:
        left = self._and()
        while self._take("OR"):
            left = ast.Binary("OR", left, self._and())
        return left

    def _and(self) -> ast.Expr:
        left = self._not()
        while self._take("AND"):
            left = ast.Binary("AND", left, self._not())
        return left

    def _not(self) -> ast.Expr:
        return ast.Not(self._not()) if self._take("NOT") else self._predicate()

    def _predicate(self) -> ast.Expr:
        left = self._sum()
        while True:
            if op := self._take(*COMPARISONS):
                left = ast.Binary(op, left, self._sum())
            elif self._take("IS"):
                negative = self._take("NOT")
                self._need("NULL")
                left = ast.Not(ast.IsNull(left)) if negative else ast.IsNull(left)
            elif self._is("NOT") and self._is("IN", "LIKE", "ILIKE", "BETWEEN", ahead=1):
                self.i += 1
                left = ast.Not(self._test(left))
            elif self._is("IN", "LIKE", "ILIKE", "BETWEEN"):
                left = self._test(left)
            else:
                return left

    def _test(self, value: ast.Expr) -> ast.Expr:
        word = self._need("IN", "LIKE", "ILIKE", "BETWEEN")
        if word == "BETWEEN":
            low = self._sum()
            self._need("AND")
            return ast.Between(value, low, self._sum())
        if word != "IN":
            return ast.Like(value, self._sum(), word == "ILIKE")
        self._need("(")
        found = ast.InQuery(value, self._query()) if self._is("SELECT", "WITH") else ast.InList(value, self._list(self._expr))
        self._need(")")
        return found

    def _sum(self) -> ast.Expr:
        left = self._product()
        while op := self._take("+", "-"):
            left = ast.Binary(op, left, self._product())
        return left

    def _product(self) -> ast.Expr:
        left = self._sign()
        while op := self._take("*", "/"):
            left = ast.Binary(op, left, self._sign())
        return left

    def _sign(self) -> ast.Expr:
        if not self._take("-"):
            return self._atom()
        value = self._sign()
        if isinstance(value, ast.Literal) and isinstance(value.value, int | float) and not isinstance(value.value, bool):
            return ast.Literal(-value.value)
        return ast.Negative(value)

    def _atom(self) -> ast.Expr:
        token = self.token
        if self._is("("):
            return self._in_parentheses(self._expr)
        if word := self._take("NULL", "TRUE", "FALSE"):
            return ast.Literal({"NULL": None, "TRUE": True, "FALSE": False}[word])
        if token.kind == "number":
            self.i += 1
            return ast.Literal(int(token.text) if token.text.isdigit() else float(token.text))
        if token.kind == "string":
            self.i += 1
            return ast.Literal(token.text)
        if token.kind == "param":
            self.i += 1
            self.marks += token.text == "?"
            return ast.Param(self.marks if token.text == "?" else int(token.text[1:]))
        if token.kind == "word" and self._is("(", ahead=1):
            return self._call(token.text.upper())
        name = self._identifier()
        return ast.Name(self._identifier(), name) if self._take(".") else ast.Name(name)

    def _call(self, name: str) -> ast.Expr:
        self.i += 1
        if name in AGGREGATES:
            return ast.Aggregate(name, self._in_parentheses(lambda: None if name == "COUNT" and self._take("*") else self._expr()))
        if name not in FUNCTIONS:
            self.i -= 1
            raise self._error("unknown function")
        return ast.Call(name, self._in_parentheses(lambda: () if self._is(")") else self._list(self._expr)))
