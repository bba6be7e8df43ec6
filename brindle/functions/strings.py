"""String functions: any null argument makes the result null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def length(s: Column) -> Column:
    """Characters."""
    return F.length(s)


def octet_length(s: Column) -> Column:
    """Bytes in UTF-8."""
    return F.octet_length(s)


def concat(*parts: Column) -> Column:
    return F.concat(*[p.cast("string") for p in parts])


def substring(s: Column, start: Column, count: Column) -> Column:
    """*count* characters from *start* (from 1; less counts as 1; a negative count as 0)."""
    return F.substr(s, F.greatest(start, F.lit(1)).cast("int"), F.greatest(count, F.lit(0)).cast("int"))


#: name -> builder, least and most number of arguments
FUNCTIONS: dict[str, tuple[Callable[..., Column], int, int | None]] = {
    "UPPER": (upper, 1, 1),
    "LOWER": (lower, 1, 1),
    "LENGTH": (length, 1, 1),
    "OCTET_LENGTH": (octet_length, 1, 1),
    "CONCAT": (concat, 2, None),
    "SUBSTRING": (substring, 3, 3),
}


def call(name: str, args: list[Column]) -> Column:
    build, least, most = FUNCTIONS[name.upper()]
    if len(args) < least or most is not None and len(args) > most:
        raise ValueError(f"{name.upper()} takes {least if most == least else f'at least {least}'} arguments, not {len(args)}")
    return build(*args)
