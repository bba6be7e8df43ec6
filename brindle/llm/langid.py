"""Language identification by Bayesian evidence fusion.

Three kinds of evidence meet in one posterior over the languages:

* the text: a naive Bayes likelihood over hashed byte trigrams, fitted on a bounded
  sample of labelled rows (``FIT_ROWS`` per language); its weight stops growing
  with ``EFFECTIVE`` trigrams, as neighbouring trigrams are not independent;
* the language that the markup declares: how often each declared code goes with
  each language, counted over the whole input;
* a prior by host, smoothed towards that of the address suffix, which is smoothed
  towards the prior of the whole input; all three are grouped sums of what the
  texts alone say.

``und`` (undetermined) competes with the languages: under it every trigram is as
likely as any other. A row is rejected if ``und`` wins or no language reaches
``MIN_POSTERIOR``.

Edge cases: a null, empty or blank text carries no text evidence, so markup and
priors decide, and a row without any of the three is rejected; null or malformed
declarations, hosts and suffixes carry none either (null hosts share no prior but
that of their suffix); repeated rows count as often as they occur; an empty table
gives no rows; without any labelled row only ``und`` is known and all is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, small_batches, stored, work_dir

UND = "und"
BUCKET_BITS = 16
#: The classifier is fitted on at most this many different labelled texts of each language.
FIT_ROWS = 1000
EFFECTIVE = 60
#: Pseudo-counts by which a host leans on its suffix, and a suffix on the whole.
HOST_LEAN, SUFFIX_LEAN = 20.0, 50.0
DECLARED_LEAN = 5.0
UND_PRIOR = 1e-3
MIN_POSTERIOR = 0.6
#: Joins that need no shuffle are asked for up to this many hosts.
BROADCAST_HOSTS = 50_000

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of *text*: letters lower-cased, the rest blanks."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    raw = _FOLD[raw]
    if len(raw) > 1:  # a run of blanks is one
        raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    if len(raw) < 3 or not (raw != 32).any():
        return np.empty(0, np.int64)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


class TextModel:
    """Log-likelihoods of trigram buckets by language; the last column is ``und``."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    def score(self, text: str | None) -> np.ndarray:
        found = trigrams(text)
        if not found.size:
            return np.zeros(len(self.langs))
        total = np.zeros(len(self.langs))
        for i in range(0, len(found), 1 << 16):
            total += self.table[found[i : i + (1 << 16)]].sum(axis=0)
        return total * (min(len(found), EFFECTIVE) / len(found))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> TextModel:
    """Fit on *fit_rows* different texts of each language, those whose hashes come first; whole texts.

    Texts are first cut down by a bound on their hash that follows from the number of
    rows of the language; where too few different ones lie below it, it is raised. So
    no task reads more than a few times *fit_rows* rows of a language. The table of a
    language has 2**BUCKET_BITS numbers on the driver, so languages must be few.
    """
    folder = work_dir(labelled.sparkSession)
    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1))
    number = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bounds = {lang: min(1.0, 2 * fit_rows / n) for lang, n in number.items()}
    chosen, round_ = None, 0
    while bounds:
        below = F.create_map(*[F.lit(x) for lang, share in bounds.items() for x in (lang, min(2**63 - 1, int(share * 2**63)))])
        near = rows.where(F.col("hash") <= F.element_at(below, F.col("lang"))).groupBy("lang", "hash").agg(F.first("text").alias("text"))
        near = stored(near, f"{folder}/near{round_}")
        found = {r["lang"]: r["n"] for r in near.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        enough = [lang for lang, share in bounds.items() if share >= 1 or found.get(lang, 0) >= fit_rows]
        if enough:
            ready = near.where(F.col("lang").isin(enough))
            chosen = ready if chosen is None else chosen.unionByName(ready)
        bounds = {lang: min(1.0, share * 16) for lang, share in bounds.items() if lang not in enough}
        round_ += 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                counts = seen.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                counts += np.bincount(trigrams(text), minlength=1 << BUCKET_BITS)
        for lang, counts in seen.items():
            bucket = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": counts[bucket]})

    if chosen is None:
        return TextModel([UND], np.full((1 << BUCKET_BITS, 1), -np.log(1 << BUCKET_BITS), np.float32))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = chosen.withColumn("place", first).where(F.col("place") <= fit_rows).select("lang", "text")
    counted = chosen.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.full((1 << BUCKET_BITS, len(langs) + 1), -np.log(1 << BUCKET_BITS))
    for i, lang in enumerate(langs):
        part = counted[counted["lang"] == lang]
        counts = np.full(1 << BUCKET_BITS, 0.05)
        counts[part["bucket"]] += part["n"]
        table[:, i] = np.log(counts / counts.sum())
    return TextModel([*langs, UND], table.astype(np.float32))


def host_of(url: Column) -> Column:
    return F.nullif(ascii_lower(F.regexp_extract(url, r"://([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))


def declared_language(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[A-Za-z#0-9]{1,8};", " ")


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    parts = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(parts, lambda x: x / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b))


def identify(records: DataFrame, model: TextModel, carry: list[str]) -> DataFrame:
    """*records* (text, declared, suffix, host and *carry*) with lang, posterior and kept.

    ``declared`` must be a code of two or three letters, or null, so the table of
    declared codes has a bound (18,252 codes) and is broadcast.
    """
    spark = records.sparkSession
    folder = work_dir(spark)
    langs, n = model.langs, len(model.langs)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts])

    with small_batches(spark):
        scored = stored(records.select(*carry, "declared", "suffix", "host", score("text").alias("logs")), f"{folder}/scored")
    # What the texts alone say; rows without text say nothing.
    said = scored.where(F.exists("logs", lambda x: x != 0.0)).withColumn("p", _softmax(F.col("logs")))

    def sums(by: str | None) -> DataFrame:
        grouped = said.where(F.col(by).isNotNull()).groupBy(by) if by else said
        return grouped.agg(F.array(*[F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)) for i in range(n)]).alias("s"))

    def lean(own: Column, towards: Column, weight: float) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(own, towards, lambda a, b: (a + b * weight) / (total + weight))

    whole = sums(None).first()["s"]
    total = sum(whole)
    start = [UND_PRIOR if lang == UND else (1 - UND_PRIOR) * (whole[i] + 1) / (total - whole[-1] + n - 1) for i, lang in enumerate(langs)]
    base = F.array(*[F.lit(float(x)) for x in start])
    by_suffix = sums("suffix").select("suffix", lean(F.col("s"), base, SUFFIX_LEAN).alias("suffix_prior"))
    host_suffix = said.where("host is not null").groupBy("host").agg(F.min("suffix").alias("suffix"))
    hosts = sums("host").join(host_suffix, "host").join(by_suffix, "suffix", "left")
    hosts = hosts.select("host", lean(F.col("s"), F.coalesce("suffix_prior", base), HOST_LEAN).alias("host_prior"))
    hosts = stored(hosts, f"{folder}/hosts")
    suffixes = stored(by_suffix, f"{folder}/suffixes")
    # P(declared | language), smoothed towards how often the code is declared at all.
    declared = sums("declared")
    share = F.aggregate("s", F.lit(0.0), lambda a, b: a + b)
    everything = declared.agg(F.coalesce(F.sum(share), F.lit(0.0)), *[F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0.0)) for i in range(n)]).first()
    totals = F.array(*[F.lit(float(x)) for x in everything[1:]])
    frequency = share / F.lit(max(everything[0], 1e-9))
    declared = declared.select("declared", F.zip_with("s", totals, lambda a, b: F.log((a + frequency * DECLARED_LEAN) / (b + DECLARED_LEAN) + 1e-12)).alias("declared_logs"))

    few = hosts.count() <= BROADCAST_HOSTS
    fused = scored.join(F.broadcast(declared), "declared", "left")
    fused = fused.join(F.broadcast(suffixes) if few else suffixes, "suffix", "left").join(F.broadcast(hosts) if few else hosts, "host", "left")
    prior = F.coalesce("host_prior", "suffix_prior", base)
    nothing = F.array(*[F.lit(0.0)] * n)
    logs = F.zip_with(F.col("logs"), F.transform(prior, lambda p: F.log(p + 1e-12)), lambda a, b: a + b)
    logs = F.zip_with(logs, F.coalesce("declared_logs", nothing), lambda a, b: a + b)
    posterior = fused.withColumn("posteriors", _softmax(logs)).withColumn("best", F.array_max("posteriors"))
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("posteriors", F.col("best")).cast("int"))
    evidence = F.exists("logs", lambda x: x != 0.0) | F.col("declared_logs").isNotNull() | F.col("host_prior").isNotNull() | F.col("suffix_prior").isNotNull()
    lang = F.when(evidence, lang).otherwise(F.lit(UND))
    out = posterior.select(*carry, "declared", "suffix", "host", lang.alias("lang"), F.col("best").alias("posterior"))
    return out.withColumn("kept", (F.col("lang") != UND) & (F.col("posterior") >= MIN_POSTERIOR))


def document_records(docs: DataFrame, carry: dict[str, Column], text_col: str = "text", host_col: str | None = "source") -> DataFrame:
    """Records of plain documents: no markup, no address; the source stands for the host."""
    none = F.lit(None).cast("string")
    host = docs[host_col].cast("string") if host_col else none
    return docs.select(*[c.alias(k) for k, c in carry.items()], docs[text_col].alias("text"), none.alias("declared"), none.alias("suffix"), host.alias("host"))


def page_records(pages: DataFrame, carry: dict[str, Column], url_col: str = "url", html_col: str = "html") -> DataFrame:
    host = host_of(pages[url_col])
    return pages.select(*[c.alias(k) for k, c in carry.items()], visible_text(pages[html_col]).alias("text"), declared_language(pages[html_col]).alias("declared"), suffix_of(host).alias("suffix"), host.alias("host"))
