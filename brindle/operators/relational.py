"""Scan, projection, filter, joins, aggregation, distinct, sort, limit, set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SortKey = str | Column | tuple[str | Column, bool]


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet table; *columns* and *where* reach the reader (pruning, pushdown)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def values(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def derived(df: DataFrame, alias: str) -> DataFrame:
    return df.alias(alias)


def project(df: DataFrame, *items: str | Column) -> DataFrame:
    return df.select(*items)


def filter_(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; null is not."""
    return df.filter(condition)


def join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    return left.join(right, on, how)


def semi_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """``x IN (SELECT …)``."""
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows without a partner (NOT EXISTS; nulls on either side have none)."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, value: Column, right: DataFrame) -> DataFrame:
    """``value NOT IN (SELECT first column of right)``: nothing if *right* has a null.

    Two cheap facts about the right side (is it empty, has it a null) are joined in
    as one row, so the main join stays an equi-join that can be shuffled; a
    null-aware anti join would have to broadcast the right side whatever its size.
    """
    column = right.columns[0]
    keys = right.select(F.col(column).alias("__key"))
    facts = keys.agg(F.count(F.lit(1)).alias("__n"), F.count("__key").alias("__known"))
    kept = left.withColumn("__value", value).join(keys.where("__key is not null"), F.col("__value") == F.col("__key"), "left_anti")
    kept = kept.crossJoin(F.broadcast(facts))  # a single row
    kept = kept.where((F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col("__value").isNotNull()))
    return kept.drop("__value", "__n", "__known")


def mark_in(left: DataFrame, value: Column, right: DataFrame, name: str) -> DataFrame:
    """*left* with a column *name*: the truth value of ``value IN (first column of right)``.

    The keys of the right side meet the rows in an equi-join, whatever their number.
    """
    keys = right.select(F.col(right.columns[0]).alias("__key"))
    facts = keys.agg(F.count(F.lit(1)).alias("__n"), F.count("__key").alias("__known"))
    known = keys.where("__key is not null").distinct().withColumn("__met", F.lit(True))
    met = left.withColumn("__value", value).join(known, F.col("__value") == F.col("__key"), "left").crossJoin(F.broadcast(facts))  # a single row
    unknown = F.col("__value").isNull() | (F.col("__known") < F.col("__n"))
    mark = F.when(F.col("__n") == 0, F.lit(False)).when(F.col("__met"), F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return met.withColumn(name, mark).drop("__value", "__key", "__met", "__n", "__known")


def group(df: DataFrame, keys: Sequence[str | Column], aggregates: Sequence[Column]) -> DataFrame:
    """Keys, then aggregates; without keys one row, also over no rows."""
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


#: Estimated size of an input whose groups one task may hold.
SMALL_BYTES = 256 << 20


def is_small(df: DataFrame) -> bool:
    """Whether Spark estimates *df* at no more than ``SMALL_BYTES`` (unknown sizes are large)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


#: percentile_approx keeps ranks to within a group's size divided by this.
RANK_ACCURACY = 10_000


def _medians(df: DataFrame, keys: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The median of *value* by *keys* (``__k0`` ...), in two passes of bounded memory.

    A sketch gives values that lie surely before and behind the middle; the second
    pass counts what is smaller and orders only what lies between them.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], value.cast("double").alias("__v")).where("__v is not null")
    margin = 3 / RANK_ACCURACY
    bounds = F.percentile_approx("__v", [0.5 - margin, 0.5 + margin], RANK_ACCURACY)
    sketch = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), bounds.alias("__b"))
    sketch = sketch.select(*[F.col(n).alias(f"{n}s") for n in names], "__n", F.col("__b")[0].alias("__low"), F.col("__b")[1].alias("__high"))
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}s"))
    met = rows.join(sketch, same) if names else rows.crossJoin(F.broadcast(sketch))  # a single row
    # What is smaller counts under a null, which comes first.
    kept = F.when(F.col("__v") >= F.col("__low"), F.col("__v"))
    met = met.where(F.col("__v") <= F.col("__high")).groupBy(*names, "__n", kept.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*names).orderBy(F.col("__v").asc_nulls_first()))
    met = met.withColumn("__upto", upto)
    middle = [F.min(F.when(F.col("__upto") >= F.expr(rank), F.col("__v"))) for rank in ("(__n + 1) div 2", "__n div 2 + 1")]
    return met.groupBy(*names).agg((0.5 * middle[0] + 0.5 * middle[1]).alias(name))


def group_with_medians(df: DataFrame, keys: Sequence[str | Column], aggregates: Sequence[Column], medians: Mapping[str, Column]) -> DataFrame:
    """Keys, then aggregates, then medians by name; no task holds a group's values."""
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    if keys:
        out = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
    else:
        out = df.agg(*aggregates) if aggregates else df.sparkSession.range(1).select()
    own = out.columns[: len(keys)]
    for name, value in medians.items():
        found = _medians(df, keys, value, name)
        same = F.lit(True)
        for i, key in enumerate(own):
            same &= out[f"`{key}`"].eqNullSafe(found[f"__k{i}"])
        out = out.join(found, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    return out


def having(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def _orders(keys: Sequence[SortKey]) -> list[Column]:
    out = []
    for key in keys:
        expr, ascending = key if isinstance(key, tuple) else (key, True)
        column = F.col(expr) if isinstance(expr, str) else expr
        out.append(column.asc_nulls_last() if ascending else column.desc_nulls_last())
    return out


def sort(df: DataFrame, *keys: SortKey) -> DataFrame:
    """Keys are columns or (column, ascending); nulls come last either way."""
    return df.orderBy(*_orders(keys))


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    if count is not None:
        return (df.offset(offset) if offset else df).limit(count)
    return _skip(df, offset) if offset else df


def _skip(df: DataFrame, offset: int) -> DataFrame:
    """All rows but the first *offset*, in order.

    Spark's own offset passes the whole rest through one task, so beyond a small
    size the rows are written where they lie (a checkpoint), counted by partition,
    and each partition leaves out what is its own.
    """
    if is_small(df) or df.sparkSession.sparkContext.getCheckpointDir() is None:
        return df.offset(offset)
    at = F.monotonically_increasing_id()
    placed = df.select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")).checkpoint()
    # One count for each partition.
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    rest, before = F.lit(False), 0
    for part in sorted(counts):
        if before + counts[part] > offset:
            rest = (F.col("__part") > part) | ((F.col("__part") == part) & (F.col("__place") >= offset - before))
            break
        before += counts[part]
    return placed.where(rest).drop("__part", "__place")


def top_n(df: DataFrame, keys: Sequence[SortKey], count: int, offset: int = 0) -> DataFrame:
    """Sort and limit; Spark keeps the first rows of each task instead of sorting all."""
    return limit(sort(df, *keys), count, offset)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)
