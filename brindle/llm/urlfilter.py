"""URL filters: longest-match rules, then a Bloom filter cascade over domain keys.

A list of domains, given as a table, blocks these and all their subdomains. The
cascade holds the list exactly, relative to the complete key universe of the corpus:
all hosts and the domains above them. Level 1 is a Bloom filter of the listed keys;
level 2 encodes the keys of the universe that level 1 takes for listed by mistake;
level 3 encodes the listed keys that level 2 takes in, and so on until no mistake is
left. A key of the universe is decided by the first level that doesn't hold it. No
row of the corpus is joined or shuffled.

A list of any length is held by the same method: keys are dealt to shards by hash,
each with a cascade of its own of about ``SHARD_BITS``. The bits are files in the
shared folder that Spark hands to the executors, where they are mapped, not loaded.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and no key, and is allowed. Repeated urls give repeated rows; an empty
table gives no rows; an empty list allows every key; null and empty entries of the
list and repeated ones don't matter, entries of more than ``MAX_LABELS`` labels are
no domains and are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, filesystem, mix64, release, stored, work_dir

#: action, host, path
Rule = tuple[str, str, str]

MAX_LABELS = 127
#: Bits of a shard's levels, and so what the driver gathers at once (32 MB).
SHARD_BITS = 1 << 28


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits (nulls where none does)."""
    name = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(rule_name(r))):
        fits = ((host == rule[1]) | F.endswith(host, F.lit(f".{rule[1]}"))) & F.startswith(path, F.lit(rule[2]))
        name = F.when(fits, F.lit(rule_name(rule))).otherwise(name)
        action = F.when(fits, F.lit(rule[0])).otherwise(action)
    return name, action


def domains_of(host: Column, labels: int) -> Column:
    """The host and the domains above it, as far as they have at most *labels* labels."""

    def above(parts: Column) -> Column:
        least = F.greatest(F.lit(1), F.size(parts) - (labels - 1))
        return F.transform(F.sequence(least, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    parts = F.split(host, r"\.")
    return F.when(host != "", F.get(F.transform(F.array(parts), above), F.lit(0))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    """A Bloom filter whose bits are in a file that Spark hands to the executors."""

    bits: int
    hashes: int
    name: str

    def words(self) -> np.ndarray:
        if self.name not in _mapped:
            _mapped[self.name] = np.memmap(SparkFiles.get(self.name), "<u8", "r")
        return _mapped[self.name]


_mapped: dict[str, np.ndarray] = {}


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    a = mix64(h1 + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
    b = mix64(h2 + np.uint64(level) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    for j in range(hashes):
        yield (a + np.uint64(j) * b) % np.uint64(bits)


def _holds(level_no: int, level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    inside, words = np.ones(len(h1), bool), level.words()
    for p in _positions(h1, h2, level_no, level.bits, level.hashes):
        inside &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return inside


class Cascade:
    """The levels of each shard; exact on the universe they were built over."""

    def __init__(self, shards: list[list[Level]]):
        self.shards = shards

    @property
    def bits(self) -> int:
        return sum(level.bits for levels in self.shards for level in levels)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(h1), bool)
        shard = h1.view(np.int64) % len(self.shards)
        for number in np.unique(shard).tolist():
            own = np.flatnonzero(shard == number)
            listed[own] = self._within(self.shards[number], h1[own], h2[own])
        return listed

    def lists(self, keys: list[list[str]]) -> np.ndarray:
        """Which of the lists of keys have one that is listed."""
        found = np.zeros(len(keys), bool)
        if any(keys):
            inside = self.contains(*key_hashes([k for own in keys for k in own]))
            found[np.repeat(np.arange(len(keys)), [len(own) for own in keys])[inside]] = True
        return found

    @staticmethod
    def _within(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        listed = np.full(len(h1), len(levels) % 2 == 1)
        open_ = np.ones(len(h1), bool)
        for i, level in enumerate(levels):
            inside = _holds(i, level, h1, h2)
            listed[open_ & ~inside] = i % 2 == 1
            open_ &= inside
        return listed


def _as_u64(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def _level_words(keys: DataFrame, level_no: int, bits: int, hashes: int) -> np.ndarray:
    """The level's bit array: OR-ed within each batch, then by word over all tasks."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.concatenate(list(_positions(_as_u64(batch["h1"]), _as_u64(batch["h2"]), level_no, bits, hashes)))
            word, inverse = np.unique(p >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (p & np.uint64(63)))
            yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

    rows = keys.select("h1", "h2").mapInPandas(partial, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros((bits + 63) // 64, "<u8")
    words[rows["word"].to_numpy()] = rows["value"].to_numpy(np.int64).view(np.uint64)
    return words


def key_hashes(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key."""
    found = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys]), "<u8").reshape(-1, 2)
    return found[:, 0].astype(np.uint64), found[:, 1].astype(np.uint64)


def hashed_keys(keys: DataFrame) -> DataFrame:
    """h1, h2 and listed of *keys* (key, listed)."""

    @F.pandas_udf("h1 long, h2 long")
    def hashes(column: pd.Series) -> pd.DataFrame:
        h1, h2 = key_hashes(column.tolist())
        return pd.DataFrame({"h1": h1.view(np.int64), "h2": h2.view(np.int64)})

    return keys.select(hashes("key").alias("h"), "listed").select("h.*", "listed")


def _published(words: np.ndarray, folder: str, spark) -> str:
    """The name under which executors find a file of *words*."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    name = f"level-{uuid.uuid4().hex}.bits"
    with fs.open_output_stream(f"{base}/{name}") as out:
        out.write(words.tobytes())
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def _first_rate(n_in: int, n_out: int) -> float:
    return min(0.5, max(n_in / max(n_out, 1), 1e-6) / math.sqrt(2))


def _bits(n: int, rate: float) -> int:
    return max(64, math.ceil(n * -math.log2(rate) / math.log(2)))


def build_cascade(universe: DataFrame, folder: str, shard_bits: int = SHARD_BITS) -> Cascade:
    """The cascade over *universe* (columns h1, h2, listed; distinct keys)."""
    universe = stored(universe, f"{folder}/universe")
    total = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n_in, n_out = total.get(True, 0), total.get(False, 0)
    # The first level's bits, and twice two bits a key for all that follow.
    shards = max(1, -(-(_bits(n_in, _first_rate(n_in, n_out)) + 4 * n_in) // shard_bits))
    parts = [universe] if shards == 1 else [universe.where(F.pmod("h1", F.lit(shards)) == i) for i in range(shards)]
    return Cascade([_levels(part, f"{folder}/shard{i}") for i, part in enumerate(parts)])


def _levels(universe: DataFrame, folder: str) -> list[Level]:
    spark = universe.sparkSession
    inside, outside = universe.where("listed"), universe.where("not listed")
    n_in, n_out = inside.count(), outside.count()
    levels: list[Level] = []
    while n_in:
        rate = 0.5 if levels else _first_rate(n_in, n_out)
        no, hashes, bits = len(levels), max(1, round(-math.log2(rate))), _bits(n_in, rate)
        level = Level(bits, hashes, _published(_level_words(inside, no, bits, hashes), f"{folder}/bits", spark))
        levels.append(level)

        def mistaken(batches: Iterator[pd.DataFrame], no: int = no, level: Level = level) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch[_holds(no, level, _as_u64(batch["h1"]), _as_u64(batch["h2"]))]

        wrong = stored(outside.select("h1", "h2").mapInPandas(mistaken, "h1 long, h2 long"), f"{folder}/level{no}")
        inside, outside, n_in = wrong, inside, wrong.count()
    for no in range(len(levels)):
        release(spark, f"{folder}/level{no}")
    return levels


def filter_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url_col: str = "url", shard_bits: int = SHARD_BITS) -> DataFrame:
    """*pages* with host, path, rule, listed and verdict columns added.

    *listed*: a table whose first column has the domains on the list. Columns of these
    names in *pages* are replaced.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url_col))
    added = ("host", "path", "rule", "listed", "verdict")
    if url_col.lower() in added:
        raise ValueError(f"the url column may not be called {url_col}")
    parsed = pages.drop(*[c for c in pages.columns if c.lower() in added]).withColumns({"host": host, "path": path})
    entries = listed.select(ascii_lower(F.col(listed.columns[0]).cast("string")).alias("key"))
    entries = entries.where((F.col("key") != "") & (F.size(F.split("key", r"\.")) <= MAX_LABELS)).distinct()
    labels = entries.agg(F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(1))).first()[0]
    folder = work_dir(spark)
    keys = parsed.select("host").where("host <> ''").distinct().select(F.explode(domains_of(F.col("host"), labels)).alias("key")).distinct()
    keys = keys.join(entries.withColumn("listed", F.lit(True)), "key", "left")
    cascade = build_cascade(hashed_keys(keys.select("key", F.coalesce("listed", F.lit(False)).alias("listed"))), folder, shard_bits)

    @F.pandas_udf("boolean")
    def member(hosts: pd.Series) -> pd.Series:
        place, known = pd.factorize(hosts)
        return pd.Series(cascade.lists([[".".join(parts[i:]) for i in range(max(0, len(parts) - labels), len(parts))] if host else [] for host in known for parts in [host.split(".")]])[place])

    parsed = parsed.withColumn("listed", member("host"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "verdict": F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))})
    release(spark, f"{folder}/universe")
    return parsed
