"""Benchmark decontamination with DataFrame functions only.

A document is contaminated by an item if some window of the item's length has a
weighted shingle similarity (multiset Jaccard, shared / total counts) of at least
``THRESHOLD`` per cent with it.

1. *Item-sized windows.* A window of n shingles reaches the threshold only if at
   least 6/7 of them are shared with an item of its length, so it begins at a shared
   shingle or at most n/7 words before the first of a run of shared ones. Every window
   that begins there is laid, in whatever order it holds the item's parts; a document
   shorter than the item is laid whole. Equal windows are looked at once.
2. *SimHash and multi-index Hamming blocks.* Windows and items of one length are
   fingerprinted over their shingle multisets. Fingerprints within ``RADIUS`` bits
   agree in some block up to ``RADIUS // BLOCKS`` bits (pigeonhole), so every block
   of a window is looked up among the items' blocks with up to that many bits
   flipped: no fingerprint within the radius is missed. At similarity 0.75 the
   distance has mean 11 and standard deviation 3; the radius lies 4 deviations off.
3. *Verification.* Candidates within the radius are compared exactly.

The benchmark doesn't grow with the corpus; its shingles are broadcast in chunks of
at most ``CHUNK_SHINGLES``, one pass over the documents for each.

Edge cases: words are runs of other than ASCII white space with A-Z lower-cased; an
item of fewer than five words is no evidence and never matches; a document shorter
than an item is one window; null and empty texts match nothing; repeated rows of
one id give one row; items without an id are found as well and count as one item of
a null id; empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, ascii_lower, stored, work_dir

SHINGLE = 5
THRESHOLD = 75  # per cent
RADIUS, BLOCKS = 23, 8
BLOCK_BITS = 64 // BLOCKS
CHUNK_SHINGLES = 500_000


def words_of(text: Column) -> Column:
    """The words of *text*, A-Z lower-cased; null for a text without words."""
    bare = F.trim(ascii_lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE_CLASS + "+"))


def _shingle_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)])


def shingles_of(words: Column) -> Column:
    """Hashes of all shingles in order; empty for fewer words than a shingle."""
    n = F.size(words) - SHINGLE
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: _shingle_at(words, i))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """The 64-bit SimHash of a multiset of hashes: each counts as often as it occurs."""

    def bit(acc: Column, b: Column) -> Column:
        votes = F.aggregate(shingles, F.lit(0), lambda v, h: v + F.getbit(h, b) * 2 - 1)
        one = F.when(votes > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.shiftleft(acc, 1).bitwiseOR(one)

    return F.aggregate(F.sequence(F.lit(63), F.lit(0)), F.lit(0).cast("long"), bit)


def block(fingerprint: Column, number: int) -> Column:
    shifted = F.shiftrightunsigned(fingerprint, number * BLOCK_BITS)
    return shifted.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).cast("int")


def shared_weight(a: Column, b: Column) -> Column:
    """The sum over all shingles of the smaller of both counts."""

    def count(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda y: y == x))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))


def benchmark_items(benchmark: DataFrame, text_col: str, item_col: str) -> DataFrame:
    """item_id, item_key, length in words, shingles and fingerprint of every usable item."""
    items = benchmark.select(benchmark[item_col].alias("item_id"), words_of(benchmark[text_col]).alias("words")).where(F.size("words") >= SHINGLE)
    items = items.select("item_id", F.size("words").alias("length"), shingles_of(F.col("words")).alias("item_shingles"))
    # The key is that of the words and length: item ids may be null.
    items = items.withColumn("item_key", F.xxhash64("item_shingles", "length"))
    return items.withColumn("item_print", simhash(F.col("item_shingles")))


def _windows(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """id, length, at, window: all windows that begin where one that reaches the threshold can."""
    each = rows.select("id", "words", F.posexplode("words").alias("pos", "word")).where(F.col("pos") <= F.size("words") - SHINGLE)
    each = each.withColumn("shingle", _shingle_at(F.col("words"), F.col("pos")))
    met = each.join(F.broadcast(starts), F.col("shingle") == F.col("item_shingle"))
    before = F.when(F.col("pos") > 0, _shingle_at(F.col("words"), F.col("pos") - 1))
    # Behind a shared shingle only the window that begins here is new.
    first = before.isNull() | ~F.array_contains("item_befores", before)
    n = F.col("length") - (SHINGLE - 1)
    foreign = F.floor(n * (100 - THRESHOLD) / (100 + THRESHOLD)).cast("int")
    end = F.size("words") - F.col("length")  # the last window's beginning
    low = F.when(first, F.greatest(F.lit(0), F.col("pos") - foreign)).otherwise(F.col("pos"))
    met = met.withColumn("low", F.when(end > 0, low).when(first, F.lit(0))).withColumn("high", F.greatest(F.lit(0), F.least(F.col("pos"), end)))
    met = met.where(F.col("low") <= F.col("high"))
    met = met.select("id", "length", "low", F.col("high") - F.col("low"), F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + F.col("length"))).toDF("id", "length", "low", "more", "piece")
    met = met.withColumn("skip", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("more")))))
    return met.select("id", "length", (F.col("low") + F.col("skip")).alias("at"), F.slice("piece", F.col("skip") + 1, F.col("length")).alias("window"))


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Contaminated documents: doc_id, item_id, at (first word of the best window),
    shared, total (shingle counts) and similarity. The id column keeps its name."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    items = stored(benchmark_items(benchmark, item_text_col, item_col), f"{folder}/items")
    starts = items.select("length", F.posexplode("item_shingles").alias("offset", "item_shingle"), "item_shingles")
    item_before = F.when(F.col("offset") > 0, F.get("item_shingles", F.col("offset") - 1))
    starts = starts.groupBy("length", "item_shingle").agg(F.collect_set(item_before).alias("item_befores"))
    starts = stored(starts, f"{folder}/starts")
    rows = docs.select(docs[id_col].alias("id"), words_of(docs[text_col]).alias("words"))
    chunks = max(1, -(-starts.count() // CHUNK_SHINGLES))
    met = None
    for i in range(chunks):
        part = starts if chunks == 1 else starts.where(F.pmod(F.xxhash64("item_shingle"), F.lit(chunks)) == i)
        found = _windows(rows, part)
        met = found if met is None else met.unionAll(found)
    met = met.withColumn("shingles", shingles_of(F.col("window"))).select("id", "length", "at", "shingles", F.xxhash64("shingles", "length").alias("key"))
    met = stored(met, f"{folder}/windows")

    prints = met.groupBy("key", "length").agg(F.first("shingles").alias("shingles"))
    prints = stored(prints.withColumn("print", simhash(F.col("shingles"))), f"{folder}/prints")
    flips = [sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r)]
    flips = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>")
    own = items.select("item_key", "length", "item_print").distinct()
    index = own.select("item_key", "length", "item_print", F.posexplode(F.array(*[block(F.col("item_print"), b) for b in range(BLOCKS)])).alias("block", "value"))
    index = index.withColumn("flip", F.explode(flips)).select("item_key", "length", "item_print", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    probes = prints.select("key", "length", "print", F.posexplode(F.array(*[block(F.col("print"), b) for b in range(BLOCKS)])).alias("block", "value"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    # Spark doesn't foresee how many rows the flips make, and might broadcast them.
    candidates = probes.hint("merge").join(index, ["length", "block", "value"]).where(near).select("key", "length", "item_key").distinct()

    weighed = candidates.join(prints.select("key", "length", "shingles"), ["key", "length"]).join(items.select("item_id", "item_key", "item_shingles").distinct(), "item_key")
    weighed = weighed.withColumn("shared", shared_weight(F.col("shingles"), F.col("item_shingles")))
    weighed = weighed.withColumn("total", F.size("shingles") + F.size("item_shingles") - F.col("shared"))
    weighed = weighed.where(F.col("shared") * 100 >= F.col("total") * THRESHOLD).select("key", "length", "item_id", "shared", "total")
    hits = met.select("id", "at", "key", "length").join(weighed, ["key", "length"])
    best = F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("at")).alias("back"), F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"))
    hits = hits.groupBy("id", "item_id").agg(F.max(best).alias("best"))
    return hits.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), (-F.col("best.back")).cast("long").alias("at"), "best.shared", "best.total", "best.similarity")
