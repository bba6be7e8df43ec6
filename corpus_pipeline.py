"""From documents to token files: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it
is written as Parquet and read back, so a stage that loses executors starts from
files. All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontam, langid, minhash, mixing, tokenstore
from brindle.llm.common import columns_of, read_table, row_key, scratch, stored, unused, work_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key that rows share only if they are equal in every column, and the key's name."""
    key = unused(docs.columns, "__key")
    return docs.withColumn(key, row_key(docs)), key


def _without(keyed: DataFrame, key: str, gone: DataFrame, docs: DataFrame) -> DataFrame:
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the rest go."""
    keyed, key = _keyed(docs)
    records = langid.document_records(keyed, {key: F.col(key)})
    judged = langid.identify(records, langid.fit(docs), [key])
    rejected = stored(judged.where("not kept").select(key).distinct(), f"{work_dir(spark)}/rejected")
    return _without(keyed, key, rejected, docs)


def _one_version(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of the rows that share an id the first one by text, then by the other columns."""
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return docs
    folder = work_dir(spark)
    repeated = stored(repeated, f"{folder}/repeated")
    several = docs.join(repeated, "doc_id", "left_semi")
    order = [several["text"], *columns_of(several)]
    parts = [x.alias(f"{kind}{i}") for i, c in enumerate(order) for kind, x in (("none", c.isNull()), ("value", c))]
    least = several.groupBy("doc_id").agg(F.min(F.struct(*parts)).alias("least"))
    first = least.select(*[F.col(f"least.value{i + 1}").alias(c) for i, c in enumerate(several.columns)]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return stored(docs.join(repeated, "doc_id", "left_anti").select(*columns_of(docs)).unionByName(first), f"{folder}/versions")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Rows that share an id are versions of one document, of which one stays and is
    judged. Rows with a null id are in no group and stay.
    """
    docs = _one_version(spark, docs)
    groups = minhash.near_duplicates(docs)
    gone = stored(groups.where("not kept").select("doc_id").distinct(), f"{work_dir(spark)}/gone")
    return docs.join(gone, "doc_id", "left_anti").select(*columns_of(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's passage."""
    keyed, key = _keyed(docs)
    hits = decontam.find(keyed, read_table(spark, sf_dir, "benchmark"), id_col=key)
    hits = stored(hits.select(key).distinct(), f"{work_dir(spark)}/hits")
    return _without(keyed, key, hits, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bit-plane files of token ids; per document what the files hold."""
    folder = tokenstore.new_folder(spark)
    manifest = tokenstore.write(docs, folder, public_tokenizers.path(TOKENIZER), END_ID)
    return tokenstore.documents(manifest, folder)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_files", token_files),
]

#: SQL can't express the classifier, the draws and the tokenizer; see tests/llm/test_mixing_and_tokens.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = work_dir(spark, keep=True)
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
