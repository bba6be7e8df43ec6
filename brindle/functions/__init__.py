"""Scalar and aggregate functions of the dialect as Column builders; no UDFs."""

from .aggregates import AGGREGATES, MEDIANS, aggregate
from .arithmetic import add, divide, int_divide, multiply, negate, subtract
from .predicates import between, ilike, in_list, is_null, like
from .strings import FUNCTIONS, call, concat, length, lower, octet_length, substring, upper

__all__ = [
    "AGGREGATES",
    "FUNCTIONS",
    "MEDIANS",
    "add",
    "aggregate",
    "between",
    "call",
    "concat",
    "divide",
    "ilike",
    "in_list",
    "int_divide",
    "is_null",
    "length",
    "like",
    "lower",
    "multiply",
    "negate",
    "octet_length",
    "substring",
    "subtract",
    "upper",
]
