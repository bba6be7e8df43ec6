"""MinHash near-duplicates with b-bit signatures.

1. Every whole text becomes its set of word shingles; the set's minima under
   ``HASHES`` hash functions are taken at once. Bands of ``ROWS`` minima become
   band keys; of each minimum the ``BITS`` lowest bits are kept and packed into bit
   planes. Documents with equal sets are one class from here on.
2. In each band bucket all classes are paired with two leaders. The signatures'
   agreement, counted in bits and corrected for chance collisions, estimates the
   similarity; pairs more than ``SLACK`` below the threshold go. Of what remains
   each class confirms its best leader on the full sets, and components form.
3. In every bucket that still holds more than one component, all pairs across
   components are estimated (blockwise; large buckets are split among tasks) and
   those that survive are confirmed on the full sets, in the task that met them.
   Pairs inside a component can't change the result, so nothing is lost by leaving
   them out; only links that join components leave a task. In a large bucket the
   blocks of its largest component meet those of the other rows only, so where one
   component holds nearly all rows, as in a group of copies, each is sent once.

With the values below a pair at similarity 0.75 shares no band with probability
2e-5, at 0.8 with probability 1e-7.

Edge cases: words are runs of other than ASCII white space with A-Z lower-cased; a
text of fewer words than a shingle is one shingle; a null, empty or blank text has
an empty set, is linked with nothing and is its own component. Rows of one id with
different texts are judged each by its own text. An empty table gives no rows. Rows with a null id
are never linked: their component is null and they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, release, small_batches, stored, window_hashes, word_hashes, work_dir
from .components import components

SHINGLE = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
BITS = 2
PLANE_WORDS = -(-HASHES // 64)
#: The estimate's standard deviation at the threshold is 0.037.
SLACK = 0.16
#: Rows of a bucket that are compared with one another in one task.
BUCKET_ROWS = 2048

_seeds = mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = (_seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = _seeds.astype(np.uint32)


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts], lower=True)
    sets, at = [], 0
    for n in counts.tolist():
        own = words[at : at + n]
        at += n
        sets.append(np.unique(window_hashes(own, min(width, n)) + np.uint64(min(width, n))) if n else np.empty(0, np.uint64))
    return sets


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of the HASHES functions over a non-empty set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), 2048):
        part = low[i : i + 2048]
        mixed = part[:, None] * _MUL + _ADD
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key ^ rows[:, i]) + np.uint64(i)
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """BITS planes of one bit per function, each padded to whole 64-bit words."""
    planes = [np.packbits(np.pad((least >> np.uint32(b + 7)) & np.uint32(1), (0, PLANE_WORDS * 64 - HASHES)).astype(np.uint8)) for b in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def estimate(agreeing: int | np.ndarray) -> float | np.ndarray:
    """Similarity from the number of agreeing values, corrected for chance collisions."""
    chance = 0.5**BITS
    return (agreeing / HASHES - chance) / (1 - chance)


def least_agreement(similarity: float) -> int:
    chance = 0.5**BITS
    return int(np.ceil(HASHES * (chance + similarity * (1 - chance)) - 1e-9))


NEEDED = least_agreement(THRESHOLD / 100 - SLACK)


def agreement(a: Column, b: Column) -> Column:
    """Agreeing values of two signatures (arrays of longs), by bit counts."""
    total = F.lit(HASHES)
    for w in range(PLANE_WORDS):
        apart = None
        for plane in range(BITS):
            i = F.lit(plane * PLANE_WORDS + w)
            x = F.get(a, i).bitwiseXOR(F.get(b, i))
            apart = x if apart is None else apart.bitwiseOR(x)
        total = total - F.bit_count(apart)
    return total


def digest(shingles: np.ndarray, k: int) -> int:
    """The *k*-th 64-bit digest of a set."""
    return int(mix64(mix64(shingles + np.uint64(k)).sum(keepdims=True) + np.uint64(len(shingles)))[0].view(np.int64))


def sketch(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Per row: id, mark (a hash of the text), n_shingles, key_a and key_b (the set's digest), bands, planes."""

    @F.pandas_udf("n_shingles long, key_a long, key_b long, bands array<long>, planes array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for begin in range(0, len(texts), 128):
            for s in shingle_sets(texts.iloc[begin : begin + 128].tolist()):
                if not s.size:
                    rows.append((0, None, None, None, None))
                    continue
                least = minima(s)
                rows.append((len(s), digest(s, 1), digest(s, 2), band_keys(least), signature(least)))
        out = pd.DataFrame(rows, columns=["n_shingles", "key_a", "key_b", "bands", "planes"], dtype=object)
        # Not by way of floats, which would round keys beside a null.
        return out.assign(n_shingles=out["n_shingles"].astype("int64"), key_a=out["key_a"].astype("Int64"), key_b=out["key_b"].astype("Int64"))

    return docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("mark"), run(docs[text_col]).alias("s")).select("id", "mark", "s.*")


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of *pairs* (a, b) whose full sets reach the threshold. *texts*: id, text."""

    @F.pandas_udf("boolean")
    def confirm(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for begin in range(0, len(left), 64):
            xs = shingle_sets(left.iloc[begin : begin + 64].tolist())
            ys = shingle_sets(right.iloc[begin : begin + 64].tolist())
            for x, y in zip(xs, ys, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    met = met.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    return met.where(confirm("left", "right")).select("a", "b")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each value of ``grp``, from batches in the order of ``grp``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        cuts = np.flatnonzero(batch["grp"].to_numpy()[1:] != batch["grp"].to_numpy()[:-1]) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            part = batch.iloc[start:stop]
            if held and held[0]["grp"].iloc[0] != part["grp"].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _candidates(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows of other components that may be linked with it.

    Rows of side 0 meet one another and rows of side 1 meet those of side 2. A pair
    is looked at in the first band that its two rows share, and nowhere else.
    """
    comps, sides, band = group["component"].to_numpy(), group["side"].to_numpy(), group["band"].iloc[0]
    planes = np.stack(group["planes"].to_list()).view(np.uint64).reshape(len(group), BITS, PLANE_WORDS)
    bands = np.stack(group["bands"].to_list())
    before = np.arange(BANDS) < np.flatnonzero(bands[0] == band)[0]
    for i in range(len(group) - 1):
        good = comps[i + 1 :] != comps[i]
        good &= (sides[i + 1 :] == 0) if sides[i] == 0 else (sides[i + 1 :] + sides[i] == 3)
        at = np.flatnonzero(good) + i + 1
        if at.size:
            apart = np.bitwise_or.reduce(planes[at] ^ planes[i], axis=1)
            at = at[HASHES - np.bitwise_count(apart).sum(axis=1, dtype=np.int64) >= NEEDED]
            at = at[~(bands[at][:, before] == bands[i][before]).any(axis=1)]
        if at.size:
            yield i, at


def _promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that have a candidate in their group."""
    for group in _groups(batches):
        seen = np.zeros(len(group), bool)
        for i, at in _candidates(group):
            seen[i] = True
            seen[at] = True
        if seen.any():
            yield group[["grp", "id"]][seen]


def _joining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b), confirmed on the full sets, that join components of a group.

    A pair whose rows are joined already isn't looked at, so a group gives fewer
    links than it has rows.
    """
    for group in _groups(batches):
        ids, comps = group["id"].to_numpy(), group["component"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        sizes = np.array([len(x) for x in sets])
        known, local = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        marked = np.zeros(len(known), bool)
        roots = comps.copy()
        a, b = [], []
        for i, at in _candidates(group):
            at = at[roots[at] != roots[i]]
            if not at.size:
                continue
            own = local[starts[i] : starts[i] + sizes[i]]
            marked[own] = True
            hits = marked[np.concatenate([local[starts[j] : starts[j] + sizes[j]] for j in at])]
            both = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes[at]) - sizes[at])
            marked[own] = False
            for j in at[100 * both >= THRESHOLD * (sizes[i] + sizes[at] - both)]:
                if roots[j] != roots[i]:
                    roots[roots == roots[j]] = roots[i]
                    a.append(ids[i])
                    b.append(ids[j])
        if a:
            yield pd.DataFrame({"a": a, "b": b})


def _across(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components: *rows* are grp, band, side, id, component, planes, bands."""

    @F.pandas_udf("binary")
    def shingles(column: pd.Series) -> pd.Series:
        return pd.Series([s.tobytes() for begin in range(0, len(column), 64) for s in shingle_sets(column.iloc[begin : begin + 64].tolist())])

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("grp").sortWithinPartitions("grp")

    promising = in_order(rows).mapInPandas(_promising, "grp long, id long")
    sets = texts.join(promising.select("id").distinct(), "id", "left_semi").select("id", shingles("text").alias("shingles"))
    met = rows.join(promising, ["grp", "id"]).join(sets, "id")
    return in_order(met).mapInPandas(_joining, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """*rows* of large buckets, each as often as blocks of other rows are to be met."""
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy("band").agg(F.sum("size").alias("rows"), F.max(F.struct("size", "component")).alias("main"))
    main = main.select("band", F.col("main.component").alias("main"), F.col("main.size").alias("inner"), (F.col("rows") - F.col("main.size")).alias("outer"))

    def blocks(number: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(number) * 2 / BUCKET_ROWS)).cast("int")

    met = rows.join(main, "band").withColumn("in_main", F.col("component") == F.col("main"))
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("in_main"), blocks("inner")).otherwise(blocks("outer"))).cast("int"))
    met = met.where(F.col("outer") > 0)
    columns = ["grp", "band", "side", "id", "component", "planes", "bands"]
    # The largest component's blocks and all others meet.
    others = F.when(F.col("in_main"), blocks("outer")).otherwise(blocks("inner"))
    across = met.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    across = across.withColumn("grp", F.when(F.col("in_main"), F.xxhash64("band", F.lit("main"), "block", "other")).otherwise(F.xxhash64("band", F.lit("main"), "other", "block")))
    across = across.withColumn("side", F.when(F.col("in_main"), 1).otherwise(2)).select(*columns)
    # The others' blocks meet one another and each itself.
    among = met.where("not in_main").withColumn("other", F.explode(F.sequence(F.lit(0), blocks("outer") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    among = among.withColumn("grp", F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", side).select(*columns)
    return across.unionByName(among)


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of *docs*: doc_id, n_shingles, component_id, kept.

    *id_col* must be an integer. The column is called doc_id in the result.
    """
    spark = docs.sparkSession
    folder = work_dir(spark)
    with small_batches(spark):
        sketches = stored(sketch(docs, text_col, id_col), f"{folder}/sketches")
    real = sketches.where("n_shingles > 0 and id is not null")
    # Classes of equal sets, known by their digest, each with the text that stands for it:
    # an id may have texts of several classes.
    classes = real.groupBy("key_a", "key_b").agg(F.min(F.struct("id", "mark")).alias("least"))
    classes = stored(classes.select("key_a", "key_b", F.col("least.id").alias("rep"), F.col("least.mark").alias("mark")), f"{folder}/classes")
    heads = real.join(classes, (real["key_a"] == classes["key_a"]) & (real["key_b"] == classes["key_b"]) & (real["id"] == classes["rep"]), "left_semi")
    heads = stored(heads.select(F.col("key_a").alias("id"), "bands", "planes").dropDuplicates(["id"]), f"{folder}/heads")
    rows = heads.select("id", F.explode("bands").alias("band"))
    # Two leaders for each bucket of at least two classes: the smallest id, and the
    # smallest by a hash that differs from band to band.
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min_by("id", F.xxhash64("band", "id")).alias("second")).where("n > 1")
    members = stored(rows.join(buckets, "band"), f"{folder}/members")
    stars = members.select("id", F.explode(F.array_distinct(F.array("first", "second"))).alias("leader")).where("id <> leader").distinct()
    planes = heads.select("id", "planes")
    stars = stars.join(planes, "id").join(planes.select(F.col("id").alias("leader"), F.col("planes").alias("own")), "leader")
    stars = stars.withColumn("agree", agreement(F.col("planes"), F.col("own"))).where(F.col("agree") >= NEEDED)
    best = stars.groupBy("id").agg(F.max_by("leader", F.struct("agree", "leader")).alias("leader"))
    pairs = stored(best.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), f"{folder}/stars")
    # Texts of all classes that share a bucket; nothing else is looked at again.
    involved = classes.select(F.col("key_a").alias("id"), "rep", "mark").join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.select(docs[id_col].alias("rep"), F.xxhash64(docs[text_col]).alias("mark"), docs[text_col].alias("text"))
    texts = texts.join(involved, ["rep", "mark"]).select("id", "text").dropDuplicates(["id"])
    texts = stored(texts, f"{folder}/texts")
    release(spark)
    with small_batches(spark):
        links = stored(_linked(pairs, texts), f"{folder}/links1")
    found = stored(components(links, f"{folder}/components1"), f"{folder}/found1")

    # What is left: pairs of different components in one bucket.
    placed = members.select("id", "band", "n").join(found, members["id"] == found["node"], "left").select("id", "band", "n", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    left = placed.join(open_, "band").join(heads, "id").select("id", "band", "n", "component", "planes", "bands")
    small = left.where(F.col("n") <= BUCKET_ROWS).select(F.col("band").alias("grp"), "band", F.lit(0).alias("side"), "id", "component", "planes", "bands")
    # Large buckets: blocks of rows meet in pairs, so no task holds more than two.
    split = _blocks(left.where(F.col("n") > BUCKET_ROWS))
    rest = stored(small.unionByName(split), f"{folder}/rest")
    with small_batches(spark):
        more = stored(_across(rest, texts), f"{folder}/links2")
    if not more.isEmpty():
        found = stored(components(links.unionByName(more), f"{folder}/components2"), f"{folder}/found2")

    # A component goes by the smallest id of its classes.
    named = classes.join(found, classes["key_a"] == found["node"], "left").select("key_a", "key_b", "rep", F.coalesce("component", "key_a").alias("component"))
    names = named.groupBy("component").agg(F.min("rep").alias("name"))
    named = stored(named.join(names, "component").select("key_a", "key_b", "name"), f"{folder}/names")
    result = sketches.select("id", "n_shingles", "key_a", "key_b").join(named, ["key_a", "key_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("name", "id")).otherwise(F.col("id"))
    result = result.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
