"""Aggregates: nulls are ignored, and over no rows all but COUNT are null.

MEDIAN as an aggregate holds the different values of a group in one task; it is for
inputs of a checked size. See :func:`brindle.operators.group_with_medians`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "COUNT": F.count,
    "SUM": F.sum,
    "MIN": F.min,
    "MAX": F.max,
    "AVG": F.avg,
    "AVERAGE": F.avg,
    "MEDIAN": F.median,
    "MED": F.median,
}

#: Names of the aggregate that needs the values of a group in order.
MEDIANS = ("MEDIAN", "MED")


def aggregate(name: str, arg: Column | None) -> Column:
    """The aggregate *name*; COUNT without an argument counts rows."""
    if arg is None:
        if name.upper() != "COUNT":
            raise ValueError(f"{name.upper()} needs an argument")
        return F.count(F.lit(1))
    return AGGREGATES[name.upper()](arg)
