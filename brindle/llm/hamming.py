"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of about log2(number of codes) bits. A code within
distance d of a query must agree with it in some segment up to a small radius, so
each segment is searched with growing radii, beginning at zero. Once segment s is
searched up to radius r_s, a code not yet met differs by at least r_s + 1 in every
segment, hence by sum(r_s + 1) in all: a query is finished as soon as its k-th
verified distance lies below that sum. Only then is its answer taken; the result is
exact. From the k-th verified distance on, what lies beyond it isn't passed on.

Before the segments, codes that differ from a query in at most one bit are looked up
whole, which finishes queries amid many near codes. Bits are dealt to the segments by
how evenly they split the codes, so that bits which hardly differ don't meet in one.

A segment value that more than ``BUCKET_CODES`` codes share is split by the other
segments: within it a code is looked up by a further segment's value, in a radius
that keeps the sum above true. No query meets all codes of such a bucket at once.

Equal codes are one entry that keeps its k + 1 smallest ids, so a vector that fills
much of the table is one candidate.

Answers are ordered by (distance, id); items of the query's own id are left out.
Edge cases: a null vector has no code and is neither found nor answered; missing
or null elements are zero bits; repeated (id, vector) rows count once; an id with
several vectors is answered once, at its nearest one; queries get fewer than k
answers where the table has fewer items.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, work_dir


def sign_code(vector: Column, bits: int = 64) -> Column:
    """A long whose bits, highest first, tell which elements are above zero."""
    if not 0 < bits <= 64:
        raise ValueError("codes have 1 to 64 bits")

    def step(acc: Column, i: Column) -> Column:
        bit = F.when(F.coalesce(F.get(vector, i) > 0, F.lit(False)), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.shiftleft(acc, 1).bitwiseOR(bit)

    code = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), step)
    return F.when(vector.isNotNull(), code)


def segments(bits: int, n: int) -> list[tuple[int, int]]:
    """(shift, width) of segments of about log2(n) bits, 16 at most."""
    m = max(math.ceil(bits / 16), min(bits // 4, int(bits // max(1.0, math.log2(max(n, 2))))))
    bounds = [round(i * bits / m) for i in range(m + 1)]
    return [(bits - b, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def masks(width: int, low: int, high: int) -> Column:
    """An array literal of all values of *width* bits with low to high bits set."""
    values = [sum(1 << i for i in c) for r in range(max(low, 0), min(high, width) + 1) for c in combinations(range(width), r)]
    if not values:
        return F.array().cast("array<long>")
    return F.split(F.lit(",".join(str(v - (1 << 64) if v >> 63 else v) for v in values)), ",").cast("array<long>")


def _piece(code: Column, segment: tuple[int, int]) -> Column:
    shift, width = segment
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1).cast("long"))


#: Probes per query and segment up to which a radius is searched in all segments at once.
CHEAP_PROBES = 1000
#: Codes that share a segment's value before they are split by the other segments.
BUCKET_CODES = 2048


def _plan(cut: list[tuple[int, int]]) -> list[dict[int, int]]:
    """The radii to reach, step by step: whole rounds while they are cheap, then segment by segment."""
    steps = []
    for radius in range(max(w for _, w in cut) + 1):
        wide = [s for s in range(len(cut)) if cut[s][1] >= radius]
        if max(math.comb(cut[s][1], radius) for s in wide) <= CHEAP_PROBES:
            steps.append(dict.fromkeys(wide, radius))
        else:
            steps += [{s: radius} for s in wide]
    return steps


def _dealt(codes: DataFrame, bits: int, parts: int) -> list[int]:
    """Which bit of a code becomes which, lowest first: the evenest bits are dealt to the segments in turn."""
    shares = codes.agg(*[F.avg(F.getbit("code", F.lit(i)).cast("double")).alias(f"b{i}") for i in range(bits)]).first()
    even = sorted(range(bits), key=lambda i: (abs((shares[i] if shares[i] is not None else 0.5) - 0.5), i))
    return [i for part in range(parts) for i in even[part::parts]]


def _rearranged(code: Column, order: list[int]) -> Column:
    return reduce(Column.bitwiseOR, [F.shiftleft(F.getbit(code, F.lit(i)).cast("long"), place) for place, i in enumerate(order)])


class _Index:
    """The codes by the values of their segments."""

    def __init__(self, codes: DataFrame, cut: list[tuple[int, int]], folder: str):
        self.codes, self.cut = codes, cut
        pieces = F.array(*[F.struct(F.lit(s).alias("segment"), _piece(F.col("other"), segment).alias("piece")) for s, segment in enumerate(cut)])
        every = stored(codes.select(F.inline(pieces), "other", "ids"), f"{folder}/index")
        heavy = every.groupBy("segment", "piece").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_CODES).select("segment", "piece")
        self.light, self.heavy, self.nested = every, stored(heavy, f"{folder}/heavy"), None
        if len(cut) > 1 and not self.heavy.isEmpty():
            self.light = every.join(self.heavy, ["segment", "piece"], "left_anti")
            split = every.join(self.heavy, ["segment", "piece"]).select(F.col("segment").alias("outer"), F.col("piece").alias("outer_piece"), F.inline(pieces), "other", "ids")
            self.nested = stored(split.where("segment <> outer"), f"{folder}/nested")

    def probes(self, active: DataFrame, low: list[int], high: list[int]) -> DataFrame | None:
        """code, bound, segment, piece: what lies *low* to *high* bits from a query in each segment."""
        parts = []
        for s, segment in enumerate(self.cut):
            if max(low[s], 0) <= high[s]:
                probe = active.select("code", "bound", F.lit(s).alias("segment"), F.explode(masks(segment[1], low[s], high[s])).alias("mask"))
                parts.append(probe.select("code", "bound", "segment", _piece(F.col("code"), segment).bitwiseXOR(F.col("mask")).alias("piece")))
        return reduce(DataFrame.unionAll, parts) if parts else None

    def nested_probes(self, active: DataFrame, low: list[int], high: list[int], inner: tuple[int, int]) -> DataFrame | None:
        """Of those probes that meet a heavy bucket: what lies *inner* bits from the query in a further segment."""
        outer = self.probes(active, low, high)
        if outer is None or inner[0] > inner[1]:
            return None
        outer = outer.join(self.heavy, ["segment", "piece"]).withColumnsRenamed({"segment": "outer", "piece": "outer_piece"})
        parts = []
        for s, segment in enumerate(self.cut):
            probe = outer.where(F.col("outer") != s).withColumn("segment", F.lit(s)).withColumn("mask", F.explode(masks(segment[1], *inner)))
            parts.append(probe.withColumn("piece", _piece(F.col("code"), segment).bitwiseXOR(F.col("mask"))).drop("mask"))
        return reduce(DataFrame.unionAll, parts)


def _met(probes: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """code, other's ids and distance, as far as they can still enter the query's top k."""
    distance = F.bit_count(F.col("code").bitwiseXOR(F.col("other")))
    equal = reduce(Column.__and__, [F.col(f"p.{k}") == F.col(f"i.{k}") for k in keys])
    # Spark takes the probes for as few as the queries and would broadcast them.
    met = probes.alias("p").hint("merge").join(index.alias("i"), equal & (distance <= F.col("bound")))
    return met.select("code", "ids", distance.alias("distance"))


def top_k(items: DataFrame, queries: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """query_id, rank, id, distance. Both inputs have columns ``id`` and ``code``."""
    spark = items.sparkSession
    folder = work_dir(spark)
    need = k + 1  # ids that surely hold k besides the query's own
    items = items.where("code is not null and id is not null").select("id", "code").distinct()
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    codes = items.withColumn("place", place).where(F.col("place") <= need).groupBy("code").agg(F.collect_list("id").alias("ids"))
    codes = stored(codes, f"{folder}/codes")
    cut = segments(bits, codes.count())
    order = _dealt(codes, bits, len(cut))
    # Distances don't depend on the order of the bits.
    rearranged = _rearranged(F.col("code"), order)
    queries = stored(queries.where("code is not null and id is not null").select("id", rearranged.alias("code")).distinct(), f"{folder}/queries")
    index = _Index(stored(codes.select(rearranged.alias("other"), "ids"), f"{folder}/rearranged"), cut, folder)

    active = queries.select("code").distinct().withColumn("bound", F.lit(bits))
    whole = active.select("code", "bound", F.explode(masks(bits, 0, 1)).alias("mask")).withColumn("key", F.col("code").bitwiseXOR(F.col("mask")))
    met = [_met(whole, index.codes.withColumn("key", F.col("other")), ["key"])]
    covered, reached, inner = 2, [-1] * len(cut), -1
    best = None
    finished: list[DataFrame] = []
    plan = _plan(cut)
    for number in range(len(plan) + 1):
        if number:
            before = list(reached)
            for s, radius in plan[number - 1].items():
                reached[s] = radius
            met = [_met(index.probes(active, [r + 1 for r in before], reached), index.light, ["segment", "piece"])]
            covered = max(2, sum(r + 1 for r in reached))
            if index.nested is not None:
                # A code of a heavy bucket that isn't met differs by inner + 1 in each further segment.
                deeper = -(-covered // (len(cut) - 1)) - 1
                nested = [index.nested_probes(active, [0] * len(cut), before, (inner + 1, deeper)), index.nested_probes(active, [r + 1 for r in before], reached, (0, deeper))]
                met += [_met(p, index.nested, ["outer", "outer_piece", "segment", "piece"]) for p in nested if p is not None]
                inner = deeper
        # A pair may be met in several segments; each (query, id) counts once, at its nearest.
        found = reduce(DataFrame.unionAll, met).select("code", F.explode("ids").alias("id"), "distance")
        found = found if best is None else found.unionByName(best)
        found = found.groupBy("code", "id").agg(F.min("distance").alias("distance"))
        kept = found.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("distance", "id"))).where(F.col("place") <= need)
        everyone = Window.partitionBy("code")
        kept = kept.withColumn("have", F.max("place").over(everyone)).withColumn("last", F.max("distance").over(everyone))
        kept = kept.withColumn("done", (F.col("have") >= need) & (F.col("last") < covered)).withColumn("bound", F.when(F.col("have") >= need, F.col("last")).otherwise(bits))
        kept = stored(kept.select("code", "id", "distance", "bound", "done"), f"{folder}/best{number}")
        finished.append(kept.where("done").select("code", "id", "distance"))
        best = kept.where("not done").select("code", "id", "distance")
        bounds = kept.select("code", "bound", "done").distinct()
        active = stored(active.select("code").join(bounds, "code", "left").where("done is null or not done").select("code", F.coalesce("bound", F.lit(bits)).alias("bound")), f"{folder}/active{number}")
        if covered > bits or all(r >= w for r, (_, w) in zip(reached, cut, strict=True)) or active.isEmpty():
            finished.append(best)
            break
    nearest = reduce(DataFrame.unionAll, finished)
    answers = queries.withColumnRenamed("id", "query_id").join(nearest, "code").where("id <> query_id")
    # A query id with several vectors is answered by the nearest of any.
    answers = answers.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
