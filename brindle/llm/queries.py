"""The queries of the text operators: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hamming, langid, minhash, mixing, pii, secret_scan, substring, tokenstore, urlfilter
from .common import read_table
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by sign codes, of every vector whose id is divisible by 20."""
    vectors = read_table(spark, sf_dir, "embeddings")
    items = vectors.select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    found = hamming.top_k(items, items.where("id % 20 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read_table(spark, sf_dir, "documents"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = tokenstore.new_folder(spark)
    manifest = tokenstore.write(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenstore.documents(manifest, folder)


def op4_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("times")


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages; the text model is fitted on labelled documents."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    model = langid.fit(docs)
    none = F.lit(None).cast("long")
    records = langid.document_records(docs, {"doc_id": F.col("doc_id"), "page_id": none})
    records = records.unionByName(langid.page_records(pages, {"doc_id": none, "page_id": F.col("page_id")}))
    return langid.identify(records, model, ["doc_id", "page_id"])


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

LISTED_DOMAINS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, then a table of domains: known names under each of the top domains in use."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "domain string")
    return urlfilter.filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op10_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_pii_anchors": op2_pii_anchors,
    "op3_token_planes": op3_token_planes,
    "op4_secret_entropy": op4_secret_entropy,
    "op5_simhash_windows": op5_simhash_windows,
    "op6_cube_mix": op6_cube_mix,
    "op7_minhash_bbit": op7_minhash_bbit,
    "op8_language_fusion": op8_language_fusion,
    "op9_url_cascade": op9_url_cascade,
    "op10_block_anchors": op10_block_anchors,
}
