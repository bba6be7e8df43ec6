"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``ANCHOR`` words.
A run of at least ``2 * ANCHOR - 1`` words contains a whole block wherever it
begins, so a repeat of ``WINDOW = 2 * ANCHOR`` words has a block of the earlier
document that equals some rolling window of the later one.

1. *Probe.* The hashes of all rolling windows of ANCHOR words, a bit telling which
   of them are reference blocks, meet by hash. Each batch of documents sends a
   hash once, in four bytes. Those hashes that are a block somewhere and occur in
   more than one document are anchors and go back to the batches that have them.
   Hashes of many buckets travel together and are parted on arrival, so the number
   of rows sent grows with the input and not with batches times buckets.
2. *Extend.* Around its anchors a batch extends to the windows of WINDOW words. These
   meet by their bucket and 80 bits of two hashes, each with its smallest document id; adjoining
   windows make up the maximal exact repeats. A batch gets back the hashes that
   also start in a smaller document than one of its own.
3. *Remove.* Words that such a window covers go.

A passage that very many documents share costs one entry per batch, not per pair
of documents, and no group of rows gathers anywhere: the parts that meet hold
hashes of a bounded share of the hash space. Rows equal in id and text are worked
on once where there are many, and counted.

Edge cases: windows are judged on the input, so all copies but those in the
smallest document go; repeats inside one document stay, and so do rows of equal
id; a null text has no words; rows with a null id lose nothing and remove nothing;
texts shorter than a window stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, release, shuffle_parts, stored, window_hashes, word_hashes, work_dir

ANCHOR = 25
WINDOW = 2 * ANCHOR
#: Text that a task holds at once, and window hashes that meet in one task.
BATCH_BYTES = 12 << 20
MEET_HASHES = 4_000_000
#: Buckets up to which a batch sends a row to each; beyond it, rows to so many groups of buckets.
GROUPS = 1024
#: Values of a group that are parted by bucket at once.
PART_VALUES = 16_000_000
#: Rows equal in id and text that are worked on one by one.
COPIES = 16
_LOW = np.uint64((1 << 30) - 1)


class _Words:
    """The word hashes of a batch's documents, one after the other."""

    def __init__(self, texts: list[str], skip: np.ndarray):
        raw = [b"" if s else t.encode("utf-8", "surrogatepass") for t, s in zip(texts, skip, strict=True)]
        self.hashes, self.counts = word_hashes(raw, lower=False)
        self.ends = np.cumsum(self.counts)
        self.doc = np.repeat(np.arange(len(raw)), self.counts)
        self.starts = self.ends - self.counts

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and which of them lie within one document."""
        found = window_hashes(self.hashes, width)
        at = np.arange(len(found))
        return found, at + width <= self.ends[self.doc[: len(found)]]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(34)) % np.uint64(buckets)


def _first_of_each(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _first_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)


def _by_bucket(bucket: np.ndarray, batch: int, *columns: np.ndarray) -> pd.DataFrame:
    """One row per bucket; *bucket* ascending; columns as bytes."""
    cuts = np.append(_first_of_each(bucket), len(bucket))
    rows = [(int(bucket[a]), batch, *(c[a:b].tobytes() for c in columns)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame(rows, columns=["bucket", "batch", *"wxyz"[: len(columns)]])


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def _probe(buckets: int, per_group: int):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        words = _Words(docs["text"].tolist(), docs["none"].to_numpy())
        found, inside = words.windows(ANCHOR)
        at = np.flatnonzero(inside)
        hashes, doc = found[at], words.doc[at]
        block = (at - words.starts[doc]) % ANCHOR == 0
        order = np.lexsort((hashes, _bucket(hashes, buckets)))
        hashes, doc, block = hashes[order], docs["id"].to_numpy()[doc[order]], block[order]
        first = _first_of_each(hashes)
        if not first.size:
            return _by_bucket(first, 0, first, first)
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        value = ((hashes[first] & _LOW) << np.uint64(2)) | (np.logical_or.reduceat(block, first).astype(np.uint64) << np.uint64(1)) | several
        group, place = np.divmod(_bucket(hashes[first], buckets), np.uint64(per_group))
        return _by_bucket(group, int(key[0]), value.astype("<u4"), place.astype("<u2")[: len(place) if per_group > 1 else 0])

    return run


def _one_batch(sent: DataFrame) -> DataFrame:
    """Rows of a batch and a bucket, in the form of those that hold several batches."""
    length = (F.octet_length("w") / 4).cast("long")
    return sent.select("bucket", F.array("batch").alias("batches"), F.array(length).alias("lengths"), "w")


def _parted(per_group: int):
    """Rows of groups of buckets, many at a time, to a row for each bucket that they hold."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        value, place = _joined(rows["w"], "<u4"), _joined(rows["x"], "<u2")
        length = rows["w"].str.len().to_numpy() // 4
        bucket = np.repeat(rows["bucket"].to_numpy(), length) * per_group + place
        batch = np.repeat(rows["batch"].to_numpy(), length)
        order = np.argsort(bucket, kind="stable")
        bucket, batch, value = bucket[order], batch[order], value[order]
        out = []
        cuts = np.append(_first_of_each(bucket), len(bucket))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            runs = np.concatenate([[0], np.flatnonzero(np.diff(batch[a:b])) + 1, [b - a]])
            out.append((int(bucket[a]), batch[a:b][runs[:-1]], np.diff(runs), value[a:b].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "batches", "lengths", "w"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for rows in batches:
            held.append(rows)
            size += int(rows["w"].str.len().sum()) // 4
            if size >= PART_VALUES:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _anchors(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
    value = _joined(sent["w"], "<u4")
    batch = np.repeat(np.concatenate(sent["batches"].to_list()), np.concatenate(sent["lengths"].to_list()))
    order = np.argsort(value >> 2, kind="stable")
    value, batch = value[order], batch[order]
    first = _first_of_each(value >> 2)
    length = np.diff(np.append(first, len(value)))
    flags = np.bitwise_or.reduceat(value & 3, first)
    anchor = np.repeat((flags >= 2) & ((flags & 1 == 1) | (length > 1)), length)
    value, batch = value[anchor] >> 2, batch[anchor]
    order = np.argsort(batch, kind="stable")
    out = _by_bucket(batch[order], 0, value[order])
    return pd.DataFrame({"bucket": int(key[0]), "batch": out["bucket"].to_numpy(np.int64), "w": out["w"]})


_LOW_48 = np.uint64((1 << 48) - 1)


def _known_as(found: np.ndarray, blocks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the windows of WINDOW words at *at* are known by besides their bucket: 80 bits.

    48 are of the window's own hash (the rest of it chose the bucket), 32 of its halves' hashes.
    """
    halves = mix64(blocks[at] * np.uint64(3) + blocks[at + ANCHOR]) >> np.uint64(32)
    return ((found[at] & _LOW_48) | (halves << np.uint64(48))).astype("<u8"), (halves >> np.uint64(16)).astype("<u2")


def _packed(numbers: np.ndarray) -> bytes:
    """Integers by the least one, the bytes each that their range needs, and these bytes' planes."""
    least = int(numbers.min())
    above = (numbers.astype(np.uint64) - np.uint64(least % (1 << 64))) if len(numbers) else numbers
    width = next(w for w in (1, 2, 4, 8) if int(above.max()) < 1 << (8 * w))
    planes = above.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return struct.pack("<qB", least, width) + planes.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    least, width = struct.unpack_from("<qB", raw)
    above = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=9).reshape(width, -1).T).view(f"<u{width}").ravel()
    return (above.astype(np.uint64) + np.uint64(least % (1 << 64))).view(np.int64)


def _extend(buckets: int):
    def run(key: tuple, docs: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(anchors):
            return _by_bucket(np.empty(0, np.int64), 0, *[np.empty(0)] * 4)
        known = [np.frombuffer(x, "<u4").astype(np.uint64) | (np.uint64(b) << np.uint64(30)) for b, x in zip(anchors["bucket"], anchors["w"], strict=True)]
        known = np.unique(np.concatenate(known))
        words = _Words(docs["text"].tolist(), docs["none"].to_numpy())
        blocks, inside = words.windows(ANCHOR)
        at = np.flatnonzero(inside)
        own = (blocks[at] & _LOW) | (_bucket(blocks[at], buckets) << np.uint64(30))
        at = at[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own]
        # All windows of WINDOW words around an anchor.
        found, inside = words.windows(WINDOW)
        cover = np.zeros(len(found) + WINDOW + 1, np.int32)
        np.add.at(cover, np.maximum(at - (WINDOW - ANCHOR), 0), 1)
        np.add.at(cover, at + 1, -1)
        at = np.flatnonzero(inside & (np.cumsum(cover)[: len(found)] > 0))
        bucket, (hashes, more), doc = _bucket(found[at], buckets), _known_as(found, blocks, at), docs["id"].to_numpy()[words.doc[at]]
        order = np.lexsort((more, hashes, bucket))
        bucket, hashes, more, doc = bucket[order], hashes[order], more[order], doc[order]
        first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])))[: len(hashes)]
        if not first.size:
            return _by_bucket(first, 0, *[first] * 4)
        least = np.minimum.reduceat(doc, first)
        several = least != np.maximum.reduceat(doc, first)
        out = _by_bucket(bucket[first], int(key[0]), hashes[first], more[first], least.astype("<i8"), several.astype(np.uint8))
        return out.assign(y=[_packed(np.frombuffer(y, "<i8")) for y in out["y"]], z=[np.packbits(np.frombuffer(z, "u1")).tobytes() for z in out["z"]])

    return run


def _resolve(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
    length = [len(x) // 8 for x in sent["w"]]
    hashes, more = _joined(sent["w"], "<u8"), _joined(sent["x"], "<u2")
    least = np.concatenate([_unpacked(y) for y in sent["y"]])
    several = np.concatenate([np.unpackbits(np.frombuffer(z, "u1"), count=n) for z, n in zip(sent["z"], length, strict=True)])
    source = np.repeat(np.arange(len(sent)), length)
    order = np.lexsort((more, hashes))
    hashes, more, least, several, source = hashes[order], more[order], least[order], several[order], source[order]
    first = _first_of_pairs(hashes, more)
    smallest = np.repeat(np.minimum.reduceat(least, first), np.diff(np.append(first, len(hashes))))
    repeat = (smallest < least) | (several == 1)
    hashes, more, smallest, source = hashes[repeat], more[repeat], smallest[repeat], source[repeat]
    order = np.argsort(source, kind="stable")
    out = _by_bucket(source[order], 0, hashes[order], more[order], smallest[order])
    return pd.DataFrame({"batch": sent["batch"].to_numpy()[out["bucket"].to_numpy(np.int64)], "w": out["w"], "x": out["x"], "y": [_packed(np.frombuffer(y, "<i8")) for y in out["y"]]})


def _remove(key: tuple, docs: pd.DataFrame, repeats: pd.DataFrame) -> pd.DataFrame:
    texts, skip, ids = docs["text"].tolist(), docs["none"].to_numpy(), docs["id"].to_numpy()
    gone = None
    if len(docs) and len(repeats):
        known, second, smallest = _joined(repeats["w"], "<u8"), _joined(repeats["x"], "<u2"), np.concatenate([_unpacked(y) for y in repeats["y"]])
        order = np.lexsort((second, known))
        known, second, smallest = known[order], second[order], smallest[order]
        words = _Words(texts, skip)
        found, inside = words.windows(WINDOW)
        at = np.flatnonzero(inside)
        found, more = _known_as(found, window_hashes(words.hashes, ANCHOR), at)
        place = np.searchsorted(known, found)
        maybe = known[np.minimum(place, len(known) - 1)] == found
        at, place, found, more = at[maybe], place[maybe], found[maybe], more[maybe]
        own = ids[words.doc[at]]
        hit = np.zeros(len(at), bool)
        while True:  # further on only where windows differ in the second hash alone
            same = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == found)
            place = np.minimum(place, len(known) - 1)
            hit |= same & (second[place] == more) & (smallest[place] < own)
            if not (same & (second[place] < more)).any():
                break
            place = place + 1
        hit = at[hit]
        cover = np.zeros(len(words.hashes) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        gone = np.cumsum(cover[:-1]) > 0
    rows = []
    for i, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").split()
        cut = gone[words.starts[i] : words.ends[i]] if gone is not None and not skip[i] else None
        spans = []
        if cut is not None and cut.any():
            edges = np.flatnonzero(np.diff(cut.astype(np.int8), prepend=0, append=0))
            spans = [f"{a}:{b}" for a, b in zip(edges[::2], edges[1::2], strict=True)]
            kept = [own[j] for j in np.flatnonzero(~cut)]
        else:
            kept = own
        rows.append((len(own), len(own) - len(kept), ",".join(spans), b" ".join(kept).decode("utf-8", "surrogatepass")))
    out = pd.DataFrame(rows, columns=["n_words", "n_removed", "spans", "kept_text"])
    return out.assign(id=ids, none=skip, copies=docs["copies"].to_numpy())


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of *docs*: its id, n_words, n_removed, spans (removed words, ``start:end``
    joined by commas) and kept_text (the kept words, joined by one space)."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    key = docs[id_col].cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("none"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    same = rows.groupBy(F.xxhash64("id", "none", "text").alias("key")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    size, most = same.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    rows = rows.withColumn("copies", F.lit(1).cast("long"))
    if most > COPIES:
        keyed = rows.withColumn("key", F.xxhash64("id", "none", "text"))
        several = stored(same.where(F.col("n") > COPIES).select("key"), f"{folder}/several")
        once = keyed.join(several, "key", "left_semi").groupBy("id", "none", "text").agg(F.count("*").alias("copies"))
        rows = keyed.join(several, "key", "left_anti").select("id", "none", "text", "copies").unionByName(once)
    parts = 2 * shuffle_parts(spark)
    batches, buckets = max(parts, -(-size // BATCH_BYTES)), max(parts, -(-size // 6 // MEET_HASHES))
    per_group = 1 if buckets <= GROUPS else -(-buckets // GROUPS)
    buckets = -(-buckets // per_group) * per_group
    rows = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(batches)).alias("batch"), "id", "none", "text", "copies").repartition("batch")
    probes = rows.groupBy("batch").applyInPandas(_probe(buckets, per_group), "bucket long, batch long, w binary, x binary")
    if per_group > 1:
        sent = probes.repartition("bucket").mapInPandas(_parted(per_group), "bucket long, batches array<long>, lengths array<long>, w binary")
    else:
        sent = _one_batch(probes)
    anchors = sent.groupBy("bucket").applyInPandas(_anchors, "bucket long, batch long, w binary")
    extended = rows.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInPandas(_extend(buckets), "bucket long, batch long, w binary, x binary, y binary, z binary")
    extended = stored(extended, f"{folder}/windows")
    release(spark)
    repeats = stored(extended.groupBy("bucket").applyInPandas(_resolve, "batch long, w binary, x binary, y binary"), f"{folder}/repeats")
    release(spark, f"{folder}/windows")
    done = rows.groupBy("batch").cogroup(repeats.groupBy("batch")).applyInPandas(_remove, "id long, none boolean, copies long, n_words long, n_removed long, spans string, kept_text string")
    if most > COPIES:
        done = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kind = docs.schema[id_col].dataType
    return done.select(F.when(~F.col("none"), F.col("id")).cast(kind).alias(id_col), "n_words", "n_removed", "spans", "kept_text")
