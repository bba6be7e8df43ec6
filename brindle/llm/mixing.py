"""Mixing sources to target weights by the cube method.

Sources share the whole size of the corpus in proportion to their weights; a
target stops at ``cap`` times its source's size and the excess is shared anew
among the rest. A document of a source is taken, in expectation, target / source
size times: a whole number of times for sure, and once more with the fraction
that is left. These fractions are rounded by balanced sampling: three units at a
time move along the null space of (number of documents, number of words) until
one of them becomes whole, so both totals keep their expectations exactly. Each
block of a source leaves at most two units; those meet in blocks of their own,
level by level, until one block per source is left. A dozen of its units, of
all sizes, are landed together with the last two, so that the words come closest
to the target.

Work is split by source and hashed block, so a source that holds most rows is
many tasks; equal rows are numbered, so they meet in no block of their own. All draws are seeded by source, block and level: reruns agree.

Edge cases: a null text has size 0; a null source is a source of its own, after
all others; rows of size 0 are drawn but take nothing; a source of total size 0
has target 0; repeated rows are units of their own; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, columns_of, row_key, spread, stored, unused, work_dir

#: Up to this many sources their totals are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def flight(sizes: Sequence[float], chances: list[float], rng: random.Random) -> None:
    """Round *chances* in place, keeping both totals, until at most two are fractions."""
    held: list[int] = []
    for unit, chance in enumerate(chances):
        if not _EPS < chance < 1 - _EPS:
            chances[unit] = float(round(chance))
            continue
        held.append(unit)
        if len(held) < 3:
            continue
        a, b, c = (sizes[i] for i in held)
        move = (b - c, c - a, a - b)
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, v in zip(held, move, strict=True):
            if v > 0:
                up, down = min(up, (1 - chances[i]) / v), min(down, chances[i] / v)
            elif v < 0:
                up, down = min(up, chances[i] / -v), min(down, (1 - chances[i]) / -v)
        by = up if rng.random() * (up + down) < down else -down
        left = []
        for i, v in zip(held, move, strict=True):
            moved = chances[i] + by * v
            if _EPS < moved < 1 - _EPS:
                chances[i] = moved
                left.append(i)
            else:
                chances[i] = float(round(moved))
        held = left


#: Units, besides the two that the flight leaves, among which the landing chooses.
LANDING_UNITS = 12


def land(sizes: Sequence[float], chances: list[float]) -> None:
    """Round the last fractions so that the words come closest to what is expected.

    Among all roundings those come first that keep the number of documents to
    within one.
    """
    open_ = [i for i, p in enumerate(chances) if p not in (0.0, 1.0)]
    if not open_:
        return
    size, chance = np.array([sizes[i] for i in open_]), np.array([chances[i] for i in open_])
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(bits.sum(axis=1) - chance.sum()) >= 1
    miss = np.abs(bits @ size - size @ chance)
    best = bits[np.lexsort((miss, off))[0]]
    for j, i in enumerate(open_):
        chances[i] = float(best[j])


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Per source: its number in code point order (null last), total size, rows, target."""
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("source_no", number)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    return sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))


def _water_level(sources: DataFrame, share: float) -> float:
    """The size per weight at which targets, stopped at their caps, add up to the whole."""
    level, before = 0.0, -1
    total, weights = sources.agg(F.sum("source_size") * float(share), F.sum("weight")).first()
    if not total:
        return 0.0
    level = total / weights
    while True:
        above = F.col("most") < F.col("weight") * level
        full, n, rest = sources.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.count(F.when(above, True)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == before or not rest:
            return level
        level, before = (total - full) / rest, n


def _drawing(seed: int, number: int, carry: Sequence[str]):
    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", *carry, "copy"], ascending=False, kind="stable", na_position="last")
        sizes, chances = part["size"].astype(float).tolist(), part["part"].tolist()
        last = part["blocks"].iloc[0] == 1
        # The last block of a source keeps some units of all sizes for the landing.
        kept = {round(i * (len(sizes) - 1) / (LANDING_UNITS - 1)) for i in range(LANDING_UNITS)} if last else set()
        flown = [i for i in range(len(sizes)) if i not in kept]
        moved = [chances[i] for i in flown]
        flight([sizes[i] for i in flown], moved, random.Random(f"{seed}:{key[0]}:{key[1]}:{number}"))
        for i, p in zip(flown, moved, strict=True):
            chances[i] = p
        if last:
            land(sizes, chances)
        return part.assign(part=chances)

    return draw


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    share: float = 1.0,
    source_col: str = "source",
    size: Column | None = None,
    block_rows: int = 4096,
    seed: int = 20,
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Rows of *docs* (columns *carry*) with size, source_size, target, times and taken."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    taken_names = {"size", "source", "s", "source_no", "source_size", "target", "times", "taken", "whole", "part", "blocks", "block", "copies", "copy"}
    if wrong := sorted(c for c in carry if c.lower() in taken_names):
        raise ValueError(f"columns to carry may not be called {wrong}")
    size = word_count(docs["text"]) if size is None else size
    # As strings, ids pass through pandas unchanged also where some are null.
    kinds = {c: docs.schema[c].dataType for c in carry}
    rows = docs.select(*[docs[c].cast("string").alias(c) for c in carry], docs[source_col].alias("source"), size.alias("size"))
    rows = rows.groupBy(*carry, "source", "size").agg(F.count("*").alias("copies"))
    rows = stored(rows, f"{folder}/sizes")
    sources = stored(source_targets(rows, weights, cap), f"{folder}/sources")
    most = rows.agg(F.coalesce(F.max("copies"), F.lit(0))).first()[0]
    rows = spread(rows, "copies", "copy", most).drop("copies")
    level = _water_level(sources, share)
    n_sources, largest = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    target = F.least("most", F.col("weight") * level)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("target", target).withColumn("times", times)
    sources = sources.select(F.col("source").alias("s"), "source_no", "source_size", "target", F.floor("times").cast("long").alias("whole"), (F.col("times") - F.floor("times")).alias("part"), F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"))
    units = rows.join(F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources, rows["source"].eqNullSafe(sources["s"])).drop("s", "source")

    number, blocks_left, done = 0, -(-largest // block_rows), None
    while True:

        block = F.pmod(F.xxhash64(F.lit(number), "size", "copy", *carry), F.col("blocks"))
        drawn = units.withColumn("block", block).groupBy("source_no", "block").applyInPandas(_drawing(seed, number, carry), units.withColumn("block", block).schema)
        drawn = stored(drawn.drop("block"), f"{folder}/level{number}")
        fixed = F.col("part").isin(0.0, 1.0)
        done = drawn.where(fixed) if done is None else done.unionByName(drawn.where(fixed))
        if blocks_left <= 1:
            break
        # At most two units are left of each block.
        blocks_left = -(-2 * blocks_left // block_rows)
        units = drawn.where(~fixed).withColumn("blocks", F.ceil(F.col("blocks") * 2 / block_rows).cast("long"))
        number += 1
    times = F.col("whole") + F.col("part").cast("long")
    return done.select(*[F.col(c).cast(kinds[c]).alias(c) for c in carry], "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def take(docs: DataFrame, source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """*docs* with every row repeated as often as the mix takes it.

    Only a key of each row goes through the mix; rows equal in every column have
    one key and are made as often as the mix takes any of them.
    """
    key, times, copies, place = (unused(docs.columns, f"__{n}") for n in ("key", "times", "copies", "place"))
    keyed = docs.withColumn(key, row_key(docs))
    mixed = mix(keyed, source_col=source_col, size=word_count(docs[text_col]), carry=[key], **options)
    drawn = mixed.groupBy(key).agg(F.sum("times").alias(times), F.count("*").alias(copies)).where(F.col(times) > 0)
    drawn = stored(drawn, f"{work_dir(docs.sparkSession)}/drawn")
    every = columns_of(docs)
    repeated, most = drawn.agg(F.coalesce(F.max(copies), F.lit(0)), F.coalesce(F.max(times), F.lit(0))).first()
    if repeated <= 1:
        rows = keyed.join(drawn, key)
    else:
        met = keyed.join(drawn, key)
        one = F.first(F.struct(*every)).alias("row")
        several = met.where(F.col(copies) > 1).groupBy(key, times, copies).agg(one).select(key, "row.*", times, copies)
        rows = met.where(F.col(copies) == 1).select(*[F.col(f"`{c}`") for c in several.columns]).unionByName(several)
    return spread(rows, times, place, most).select(*[F.col(f"`{c}`") for c in docs.columns])
