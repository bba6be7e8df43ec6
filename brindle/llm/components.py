"""Connected components of a graph of links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of *links* (columns a, b): its smallest reachable node.

    Alternating large-star and small-star steps: each node's larger, then its
    smaller neighbours are hung below the smallest one known. The edges never
    become more than they were, minima are pre-aggregated before the shuffle, and
    the number of rounds grows with the logarithm of the graph's diameter.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, f"{folder}/edges")
    number, before = 0, None
    while True:
        # Large star: from both ends, hang larger neighbours below the smallest one.
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: hang a node and its smaller neighbours below the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(small, f"{folder}/round{number}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, number = now, number + 1
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
