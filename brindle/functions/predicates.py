"""Predicates with SQL's three-valued logic."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(pattern: str | Column) -> Column:
    """LIKE patterns have no escape character: a backslash stands for itself."""
    if isinstance(pattern, str):
        return F.lit(pattern.replace("\\", "\\\\"))
    return F.replace(pattern, F.lit("\\"), F.lit("\\\\"))


def _without_backtracking(pattern: str) -> str | None:
    """A regular expression for patterns with several inner parts.

    Each inner part may be taken where it is found first, so atomic groups lose no
    match, and the time is linear where plain LIKE would try all combinations.
    """
    first, *inner, last = pattern.split("%") if "%" in pattern else (pattern, "")
    if len(inner) < 3:
        return None

    def piece(text: str) -> str:
        return "".join("." if c == "_" else re.escape(c) for c in text)

    return rf"(?s)\A{piece(first)}" + "".join(f"(?>.*?{piece(p)})" for p in inner if p) + rf".*{piece(last)}\z"


def _by_row(value: Column, pattern: Column, plain: Callable[[Column, Column], Column]) -> Column:
    """LIKE with a pattern of each row's own; what :func:`_without_backtracking` does, as an expression."""

    def piece(text: Column) -> Column:
        return F.replace(F.regexp_replace(text, r"([^\w\s]|\s)", r"\\$1"), F.lit("_"), F.lit("."))

    parts = F.split(pattern, "%")
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p != "")
    steps = F.array_join(F.transform(inner, lambda p: F.concat(F.lit("(?>.*?"), piece(p), F.lit(")"))), "")
    regex = F.concat(F.lit(r"(?s)\A"), piece(F.get(parts, F.lit(0))), steps, F.lit(".*"), piece(F.element_at(parts, -1)), F.lit(r"\z"))
    many = F.size(parts) >= 5
    # The branch not taken may be evaluated, too, so it gets nothing to try.
    return F.when(many, F.rlike(value, regex)).otherwise(plain(value, F.when(many, F.lit("")).otherwise(_pattern(pattern))))


def like(value: Column, pattern: str | Column) -> Column:
    if not isinstance(pattern, str):
        return _by_row(value, pattern, F.like)
    if regex := _without_backtracking(pattern):
        return F.rlike(value, F.lit(regex))
    return F.like(value, _pattern(pattern))


def ilike(value: Column, pattern: str | Column) -> Column:
    if not isinstance(pattern, str):
        return _by_row(F.lower(value), F.lower(pattern), F.like)
    if regex := _without_backtracking(pattern.lower()):
        return F.rlike(F.lower(value), F.lit(regex))
    return F.ilike(value, _pattern(pattern))


def between(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value <= high)


def in_list(value: Column, items: Sequence[Column]) -> Column:
    return value.isin(*items)


def is_null(value: Column) -> Column:
    return value.isNull()
