"""Arithmetic. Nulls propagate; integer overflow and division by zero are errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def negate(a: Column) -> Column:
    return -a


def int_divide(a: Column, b: Column, wide: bool = True) -> Column:
    """The quotient truncated towards zero, as bigint or int."""
    out = F.call_function("div", a, b)
    return out if wide else out.cast("int")


def divide(a: Column, b: Column, types: tuple[str, str]) -> Column:
    """``/`` of the dialect: between integers it truncates, else it divides doubles."""
    integers = {"tinyint", "smallint", "int", "bigint"}
    if types[0] in integers and types[1] in integers:
        return int_divide(a, b, "bigint" in types)
    return a.cast("double") / b.cast("double")
