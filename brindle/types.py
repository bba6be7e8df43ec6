"""SQL type names of the dialect and what values become when they are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "BOOLEAN": T.BooleanType(),
    "BOOL": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DECIMAL": T.DoubleType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "TEXT": T.StringType(),
    "CHAR": T.StringType(),
    "DATE": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(),
}


def data_type(name: str) -> T.DataType:
    try:
        return TYPES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown type: {name}") from None


def store_cast(value: Column, type_name: str, length: int | None) -> Column:
    """*value* as a column of the type stores it; fails at run time if it doesn't fit.

    Casts follow the ANSI rules: overflow and malformed text are errors. A text
    longer than its declared length is an error; CHAR drops trailing blanks first.
    """
    out = value.cast(data_type(type_name))
    if length is not None and type_name.upper() in ("VARCHAR", "CHAR"):
        if type_name.upper() == "CHAR":
            out = F.rtrim(out)
        too_long = F.raise_error(F.lit(f"value too long for type {type_name.upper()}({length})"))
        out = F.when(F.length(out) > length, too_long.cast("string")).otherwise(out)
    return out
