"""Constraint checks as joins and grouped counts over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A statement would break a constraint."""


def check_not_null(df: DataFrame, table: str, columns: Sequence[str]) -> None:
    """One pass for all columns."""
    if not columns:
        return
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    for c in columns:
        if counts[c]:
            raise ConstraintError(f"Constraint Violation: Column '{c}' of table '{table}' cannot be NULL")


def check_unique(df: DataFrame, columns: Sequence[str], name: str) -> None:
    """No two rows with equal keys; keys with a null are distinct."""
    known = df.select(*columns).dropna()
    if not known.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").isEmpty():
        raise ConstraintError(f"Constraint Violation: Duplicate key value violates Primary Key / Unique index '{name}'")


def check_new_keys(new: DataFrame, old: DataFrame, columns: Sequence[str], name: str) -> None:
    """*new* has no repeated key and none that *old* has."""
    check_unique(new, columns, name)
    keys = new.select(*columns).dropna()
    if not old.select(*columns).join(keys, list(columns), "left_semi").isEmpty():
        raise ConstraintError(f"Constraint Violation: Duplicate key value violates Primary Key / Unique index '{name}'")


def check_parents(rows: DataFrame, column: str, parents: DataFrame, parent_column: str, child: str, parent: str) -> None:
    """Every value of *column*, nulls aside, has a parent row."""
    wanted = rows.select(F.col(column).alias("__key")).dropna().distinct()
    have = parents.select(F.col(parent_column).alias("__key"))
    if not wanted.join(have, "__key", "left_anti").isEmpty():
        raise ConstraintError(f"Constraint Violation: Foreign key '{child}.{column}' has no matching row in '{parent}.{parent_column}'")
