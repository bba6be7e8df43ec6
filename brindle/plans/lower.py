"""Trees to DataFrames. All names resolve through Spark; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions, operators
from . import ast
from .lexer import ParseError


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def name_of(expr: ast.Expr) -> str:
    """What an item without an alias is called."""
    if isinstance(expr, ast.Name):
        return expr.name
    if isinstance(expr, ast.Aggregate | ast.Call):
        return expr.name.lower()
    return "expr"


def literal(value: Any) -> Column:
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("int" if -(2**31) <= value < 2**31 else "bigint")
    return F.lit(value)


def children(expr: ast.Expr) -> list[ast.Expr]:
    found: list[ast.Expr] = []
    for value in vars(expr).values():
        found += [x for x in (value if isinstance(value, tuple) else (value,)) if isinstance(x, ast.Expr)]
    return found


def replace(expr: ast.Expr, change: Callable[[ast.Expr], ast.Expr | None]) -> ast.Expr:
    """*expr* with every outermost node for which *change* returns another one replaced."""
    new = change(expr)
    if new is not None:
        return new
    fields = {}
    for name, value in vars(expr).items():
        if isinstance(value, ast.Expr):
            value = replace(value, change)
        elif isinstance(value, tuple):
            value = tuple(replace(x, change) if isinstance(x, ast.Expr) else x for x in value)
        fields[name] = value
    return type(expr)(**fields)


def aggregates_in(expr: ast.Expr) -> list[ast.Aggregate]:
    if isinstance(expr, ast.Aggregate):
        return [expr]
    return [a for child in children(expr) for a in aggregates_in(child)]


def queries_in(expr: ast.Expr) -> list[ast.InQuery]:
    """The outermost IN (SELECT ...) of an expression."""
    if isinstance(expr, ast.InQuery):
        return [expr]
    return [q for child in children(expr) for q in queries_in(child)]


def conjuncts(expr: ast.Expr) -> list[ast.Expr]:
    if isinstance(expr, ast.Binary) and expr.op == "AND":
        return conjuncts(expr.left) + conjuncts(expr.right)
    return [expr]


class Lowering:
    """Lowers one statement's trees.

    ``table`` gives the DataFrame of a base table, ``view`` the tree of a view, each
    None for an unknown name. CTEs hide views, and views hide tables.
    """

    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame | None], view: Callable[[str], ast.Query | None] = lambda name: None, params: Sequence[Any] = ()):
        self.spark, self.table, self.view, self.params = spark, table, view, params

    # -- queries

    def query(self, q: ast.Query, ctes: dict[str, DataFrame] | None = None) -> DataFrame:
        ctes = ctes or {}
        if isinstance(q, ast.With):
            scope = dict(ctes)
            for name, inner in q.ctes:
                scope[name] = self.query(inner, scope)
            return self.query(q.query, scope)
        if isinstance(q, ast.Ordered):
            return self._ordered(q, ctes)
        if isinstance(q, ast.SetOp):
            return self._set_op(q, ctes)
        return self._select(q, (), ctes)

    def _set_op(self, q: ast.SetOp, ctes: dict[str, DataFrame]) -> DataFrame:
        left, right = self.query(q.left, ctes), self.query(q.right, ctes)
        if len(left.columns) != len(right.columns):
            raise ParseError(f"{q.op} needs as many columns on both sides: {len(left.columns)} and {len(right.columns)}")
        apply = {
            ("UNION", False): operators.union,
            ("UNION", True): operators.union_all,
            ("INTERSECT", False): operators.intersect,
            ("INTERSECT", True): operators.intersect_all,
            ("EXCEPT", False): operators.except_,
            ("EXCEPT", True): operators.except_all,
        }[q.op, q.all]
        return apply(left, right)

    def _ordered(self, q: ast.Ordered, ctes: dict[str, DataFrame]) -> DataFrame:
        if isinstance(q.query, ast.Select):
            df = self._select(q.query, q.order, ctes)
        else:
            df = self.query(q.query, ctes)
            if q.order:
                df = operators.sort(df, *[(self.expr(e, df, ctes), up) for e, up in q.order])
        return operators.limit(df, q.limit, q.offset)

    def source(self, s: ast.Source, ctes: dict[str, DataFrame]) -> DataFrame:
        if s.query is not None:
            df = self.query(s.query, ctes)
            return df.alias(s.alias) if s.alias else df
        if s.name in ctes:
            df = ctes[s.name]
        elif (tree := self.view(s.name)) is not None:
            df = self.query(tree)
        else:
            df = self.table(s.name)
            if df is None:
                raise ParseError(f"unknown table: {s.name}")
        return df.alias(s.alias or s.name)

    def _select(self, q: ast.Select, order: Sequence[tuple[ast.Expr, bool]], ctes: dict[str, DataFrame]) -> DataFrame:
        df = self.source(q.source, ctes)
        for join in q.joins:
            right = self.source(join.source, ctes)
            if join.on is None:
                df = df.crossJoin(right)
            else:
                df = operators.join(df, right, self.expr(join.on, df, ctes, right), join.how)
        if q.where is not None:
            if aggregates_in(q.where):
                raise ParseError("WHERE may not hold aggregates")
            df = self._filter(df, q.where, ctes)

        aliases = {alias: expr for expr, alias in q.items if alias}

        def known(expr: ast.Expr, columns: Sequence[str], first: bool) -> ast.Expr:
            """Aliases of items stand for their expressions; *first*: before columns."""

            def change(e: ast.Expr) -> ast.Expr | None:
                if isinstance(e, ast.Name) and e.table is None and e.name in aliases and (first or e.name not in columns):
                    return aliases[e.name]
                return None

            return replace(expr, change)

        columns = df.columns
        group = [known(e, columns, False) for e in q.group]
        having = known(q.having, columns, False) if q.having is not None else None
        order = [(known(e, columns, True), up) for e, up in order]
        items = [(e, alias or name_of(e)) for e, alias in q.items]
        exprs = [e for e, _ in items] + [e for e, _ in order] + ([having] if having is not None else [])
        if group or any(aggregates_in(e) for e in exprs):
            df, place = self._aggregate(df, group, exprs, ctes)
            items = [(place(e), name) for e, name in items]
            order = [(place(e), up) for e, up in order]
            having = place(having) if having is not None else None
            if any(isinstance(e, ast.Star) for e, _ in items):
                raise ParseError("* can't be selected with GROUP BY or aggregates")
        if having is not None:
            df = self._filter(df, having, ctes)

        def selected() -> list[Column]:
            return [F.col("*") if isinstance(e, ast.Star) else self.expr(e, df, ctes).alias(name) for e, name in items]

        if not q.distinct:
            if order:
                df = operators.sort(df, *[(self.expr(e, df, ctes), up) for e, up in order])
            return df.select(*selected())
        if not order:
            return df.select(*selected()).distinct()
        # DISTINCT comes before ORDER BY, whose keys must be among the items.
        position = {e: i for i, (e, _) in enumerate(items)}
        if any(e not in position for e, _ in order):
            raise ParseError("with DISTINCT, ORDER BY takes selected expressions only")
        out = df.select(*[self.expr(e, df, ctes).alias(f"__{i}") for i, (e, _) in enumerate(items)]).distinct()
        out = operators.sort(out, *[(F.col(f"__{position[e]}"), up) for e, up in order])
        return out.select(*[F.col(f"__{i}").alias(name) for i, (_, name) in enumerate(items)])

    def _aggregate(self, df: DataFrame, group: list[ast.Expr], exprs: list[ast.Expr], ctes: dict[str, DataFrame]) -> tuple[DataFrame, Callable[[ast.Expr], ast.Expr]]:
        """The grouped DataFrame, and what stands in it for an expression over groups."""
        calls = list(dict.fromkeys(a for e in exprs for a in aggregates_in(e)))
        if any(aggregates_in(a.arg) for a in calls if a.arg is not None) or any(aggregates_in(g) for g in group):
            raise ParseError("aggregates may not be nested or grouped by")
        keys = [self.expr(g, df, ctes).alias(f"__g{i}") for i, g in enumerate(group)]
        args = [None if a.arg is None else self.expr(a.arg, df, ctes) for a in calls]
        medians = {f"__a{i}": arg for i, (a, arg) in enumerate(zip(calls, args, strict=True)) if a.name.upper() in functions.MEDIANS}
        if medians and not operators.is_small(df):
            made = [functions.aggregate(a.name, arg).alias(f"__a{i}") for i, (a, arg) in enumerate(zip(calls, args, strict=True)) if f"__a{i}" not in medians]
            grouped = operators.group_with_medians(df, keys, made, medians)
        else:
            made = [functions.aggregate(a.name, arg).alias(f"__a{i}") for i, (a, arg) in enumerate(zip(calls, args, strict=True))]
            grouped = operators.group(df, keys, made) if made else df.select(*keys).distinct()

        def same(g: ast.Expr, e: ast.Expr) -> bool:
            if isinstance(g, ast.Name) and isinstance(e, ast.Name):
                return g.name == e.name and (g.table is None or e.table is None or g.table == e.table)
            return g == e

        def change(e: ast.Expr) -> ast.Expr | None:
            if isinstance(e, ast.Aggregate):
                return ast.Name(f"__a{calls.index(e)}")
            for i, g in enumerate(group):
                if same(g, e):
                    return ast.Name(f"__g{i}")
            if isinstance(e, ast.Name):
                raise ParseError(f"{e.name} is neither grouped by nor aggregated")
            return None

        return grouped, lambda e: e if isinstance(e, ast.Star) else replace(e, change)

    def _filter(self, df: DataFrame, condition: ast.Expr, ctes: dict[str, DataFrame]) -> DataFrame:
        """Filters by conjuncts; IN and NOT IN over queries become joins.

        Where one stands alone it is a semi or anti join; within an expression, say
        under OR, a join marks the rows with its truth value.
        """
        plain, marks = None, []
        for part in conjuncts(condition):
            negative = isinstance(part, ast.Not)
            inner = part.value if negative else part
            if isinstance(inner, ast.InQuery):
                right = self._one_column(inner, ctes)
                value = self.expr(inner.value, df, ctes)
                if negative:
                    df = operators.not_in(df, value, right)
                else:
                    right = right.toDF("__in")
                    df = operators.semi_join(df, right, value == F.col("__in"))
            else:
                for query in queries_in(part):
                    marks.append(f"__in{len(marks)}")
                    df = operators.mark_in(df, self.expr(query.value, df, ctes), self._one_column(query, ctes), marks[-1])
                    mark = ast.Name(marks[-1])
                    part = replace(part, lambda e, query=query, mark=mark: mark if e is query else None)
                column = self.expr(part, df, ctes)
                plain = column if plain is None else plain & column
        return df if plain is None else operators.filter_(df, plain).drop(*marks)

    def _one_column(self, e: ast.InQuery, ctes: dict[str, DataFrame]) -> DataFrame:
        right = self.query(e.query, ctes)
        if len(right.columns) != 1:
            raise ParseError("IN takes a query of one column")
        return right

    # -- expressions

    def expr(self, e: ast.Expr, df: DataFrame | None, ctes: dict[str, DataFrame] | None = None, right: DataFrame | None = None) -> Column:
        """*e* as a column of *df* (and of *right*, in the condition of a join)."""

        def low(x: ast.Expr) -> Column:
            return self.expr(x, df, ctes, right)

        match e:
            case ast.Literal(value):
                return literal(value)
            case ast.Param():
                return literal(self._value(e))
            case ast.Name(name, None):
                return F.col(quoted(name))
            case ast.Name(name, table):
                return F.col(f"{quoted(table)}.{quoted(name)}")
            case ast.Binary("AND", a, b):
                return low(a) & low(b)
            case ast.Binary("OR", a, b):
                return low(a) | low(b)
            case ast.Binary("/", a, b):
                x, y = low(a), low(b)
                return functions.divide(x, y, self._types(df, right, x, y))
            case ast.Binary(op, a, b):
                x, y = low(a), low(b)
                return {"=": x.__eq__, "!=": x.__ne__, "<": x.__lt__, ">": x.__gt__, "<=": x.__le__, ">=": x.__ge__, "+": x.__add__, "-": x.__sub__, "*": x.__mul__}[op](y)
            case ast.Not(value):
                return ~low(value)
            case ast.Negative(value):
                return functions.negate(low(value))
            case ast.IsNull(value):
                return functions.is_null(low(value))
            case ast.InList(value, items):
                return functions.in_list(low(value), [low(x) for x in items])
            case ast.InQuery(value, _):
                return low(value).isin(self._one_column(e, ctes or {}))
            case ast.Between(value, a, b):
                return functions.between(low(value), low(a), low(b))
            case ast.Like(value, pattern, ignore_case):
                known = self._value(pattern)
                return (functions.ilike if ignore_case else functions.like)(low(value), known if isinstance(known, str) else low(pattern))
            case ast.Call(name, args):
                return functions.call(name, [low(x) for x in args])
            case ast.Aggregate():
                raise ParseError("an aggregate can't stand here")
            case ast.Star():
                raise ParseError("* can't stand here")
        raise ParseError(f"unknown expression: {e}")

    def _value(self, e: ast.Expr) -> Any:
        """What a literal or a parameter stands for; None for other expressions."""
        if isinstance(e, ast.Param):
            if not 1 <= e.number <= len(self.params):
                raise ParseError(f"parameter {e.number} has no value")
            return self.params[e.number - 1]
        return e.value if isinstance(e, ast.Literal) else None

    def _types(self, df: DataFrame | None, right: DataFrame | None, *columns: Column) -> tuple[str, ...]:
        base = self.spark.range(1) if df is None else df
        if right is not None:
            base = base.crossJoin(right)
        return tuple(kind for _, kind in base.select(*[c.alias(f"_{i}") for i, c in enumerate(columns)]).dtypes)
