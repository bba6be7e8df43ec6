"""Helpers shared by the text operators: tables, work folders, words, windows."""

from __future__ import annotations

import gc
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Used where the session names no checkpoint folder, as in tests.
LOCAL_WORK_DIR = "file:///tmp/brindle-work"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table *name* below *sf_dir*, by Spark's own reader (any store works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the scratch blocks that are open, the innermost last.
_scratch: list[str] = []
#: Folders made outside of such blocks.
_made: list[str] = []


def work_dir(spark: SparkSession, keep: bool = False) -> str:
    """A new folder below the session's shared checkpoint folder.

    Within a :func:`scratch` block it goes with the block, unless *keep* is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or LOCAL_WORK_DIR
    if _scratch and not keep:
        base = _scratch[-1]
    folder = f"{base.rstrip('/')}/brindle-{uuid.uuid4().hex}"
    if not keep and not _scratch:
        _made.append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work folders made within the block are deleted at its end: results must be written by then."""
    folder = work_dir(spark)
    _scratch.append(folder)
    try:
        yield
    finally:
        _scratch.remove(folder)
        release(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete all work folders that this process has made, but for those it was told to keep.

    For the end of a session: lazy results that were not written lose what they read.
    """
    release(spark, *_made)
    _made.clear()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write *df* to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what came
    before, and costly stages run once however often the result is used.
    """
    spark = df.sparkSession
    path = path or f"{work_dir(spark)}/table"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts that travel to a Python worker at once in jobs over whole documents.
BATCH_TEXTS = "1000"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run within the block send few rows at once to Python workers, which bounds their memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_TEXTS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete work folders that are done with, and let Spark drop shuffle files.

    Spark frees the files of a shuffle once the driver's JVM has collected the
    plan that made it; without a collection they would pile up.
    """
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    spark._jvm.System.gc()


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of *folder* and the path in it; a plain path is a local one."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{os.path.abspath(folder)}")


def ascii_lower(col):
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(col, UPPER, LOWER)


def unused(columns: list[str], name: str) -> str:
    """*name*, or a longer one that none of *columns* has (names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [df[f"`{c}`"] for c in df.columns]


def row_key(df: DataFrame) -> Column:
    """128 bits, as text, that rows share only if they are equal in every column."""
    every = columns_of(df)
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in every])
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), nulls, *every)), 16, "0") for seed in (1, 2)])


#: Copies of a row that one task makes.
CHUNK_COPIES = 1 << 16


def spread(rows: DataFrame, count: str, place: str, most: int) -> DataFrame:
    """Each row as often as its *count* says (*most* at most), numbered from 0 by *place*.

    The copies of a row of many copies are made by many tasks.
    """
    chunk, n = unused([*rows.columns, place], "chunk"), F.col(count).cast("long")
    if most <= CHUNK_COPIES:
        return rows.where(n >= 1).withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    few = rows.where(n.between(1, CHUNK_COPIES)).withColumn(place, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    many = rows.where(n > CHUNK_COPIES).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / CHUNK_COPIES)))).repartition(chunk)
    first = F.col(chunk) * CHUNK_COPIES
    return few.unionByName(many.withColumn(place, F.explode(F.sequence(first, F.least(n, first + CHUNK_COPIES) - 1))).drop(chunk))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- numpy helpers

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD_LOWER = _FOLD.copy()
_FOLD_LOWER[65:91] += 32
_BLANK_BYTE = re.compile(rb"[\x20\x09-\x0d]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (grown by doubling)."""
    size = 1 << max(10, int(n - 1).bit_length())
    if 0 not in _powers or len(_powers[0][0]) < n:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _BASE_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _powers[0]
    return up[:n], down[:n]


#: Longer words, in bytes, are hashed each by itself.
LONG_WORD = 256
#: Bytes of text that are hashed at once; each takes some 40 bytes of memory.
CHUNK_BYTES = 1 << 20


def cut_at_blanks(text: bytes) -> list[bytes]:
    """*text* in pieces of about CHUNK_BYTES that cut no word."""
    pieces, start = [], 0
    while len(text) - start > CHUNK_BYTES and (blank := _BLANK_BYTE.search(text, start + CHUNK_BYTES)):
        pieces.append(text[start : blank.start()])
        start = blank.start()
    return [*pieces, text[start:]]


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of *texts*, and the number of words of each.

    Words are runs of bytes other than ASCII white space. Hashes of a word are
    the same wherever it stands, on every machine and in every run.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    start = 0
    while start < len(texts):
        if len(texts[start]) > CHUNK_BYTES:  # alone, piece by piece
            for piece in cut_at_blanks(texts[start]):
                h, n = _word_hashes([piece], lower)
                hashes.append(h)
                counts[start] += n[0]
            start += 1
            continue
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < CHUNK_BYTES):
            size += len(texts[end]) + 1
            end += 1
        h, n = _word_hashes(texts[start:end], lower)
        hashes.append(h)
        counts[start:end] = n
        start = end
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def word_places(texts: list[bytes], lower: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, where words begin and end in it, their hashes, and the words of each text."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    blank = _BLANK[raw]
    edges = np.diff(blank.view(np.int8), prepend=np.int8(1))
    begins = np.flatnonzero(edges == -1)
    ends = np.flatnonzero(edges == 1)
    if begins.size == 0:
        return joined, begins, begins, np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    if lower:
        raw = _FOLD_LOWER[raw]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix64((sums[ends] - sums[begins]) * down[begins])
    # Sums of powers modulo 2**64 are the same for certain words of 1024 letters.
    for i in np.flatnonzero(ends - begins > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[begins[i] : ends[i]].tobytes())
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return joined, begins, ends, hashes, np.diff(np.searchsorted(begins, bounds), prepend=0)


def _word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    return word_places(texts, lower)[3:]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of *width* consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if width <= 8:
        h = np.zeros(n, np.uint64)
        for j in range(width):
            h = h * _ROLL + words[j : j + n]
        return mix64(h)
    up, down = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[:n])
