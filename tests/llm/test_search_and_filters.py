"""Top-k search, url filters and language identification."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brindle.llm import hamming, langid, urlfilter
from brindle.llm.common import work_dir
from pyspark.sql import functions as F


@pytest.mark.parametrize("bits,n,bucket", [(64, 300, 2048), (64, 3000, 2048), (24, 500, 2048), (64, 1500, 20), (24, 500, 5)])
def test_top_k_is_exact(spark, monkeypatch, bits, n, bucket):
    monkeypatch.setattr(hamming, "BUCKET_CODES", bucket)
    rng = np.random.default_rng(n)
    vectors = rng.normal(size=(n, bits)).astype(float)
    vectors[:, : bits // 3] += 1.5 if bucket < 2048 else 0  # bits that hardly differ
    vectors[: n // 3] = vectors[0]  # one vector fills a third
    vectors[n // 3 : n // 2] = vectors[0] * np.where(rng.random((n // 2 - n // 3, bits)) < 0.05, -1, 1)
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(vectors)] + [(n + 1, None, 0), (0, vectors[0].tolist(), 0), (None, vectors[1].tolist(), 0)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, code long")
    items = df.select("id", hamming.sign_code(F.col("vector"), bits).alias("code"))
    out = hamming.top_k(items, items.where("id % 20 = 0"), k=7, bits=bits).collect()
    signs = vectors > 0
    for q in range(0, n, 20):
        distance = (signs != signs[q]).sum(axis=1)
        want = sorted((int(d), i) for i, d in enumerate(distance) if i != q)[:7]
        assert sorted((r["rank"], r.distance, r.id) for r in out if r.query_id == q) == [(k + 1, *w) for k, w in enumerate(want)]


@pytest.mark.parametrize("k", [1, 4, 10])
def test_top_k_of_interleaved_copies(spark, k):
    """Codes at one distance whose copies' ids interleave, and ids with several vectors."""
    rng = random.Random(k)
    cases = [[(i, 1 << i) for i in range(1, 9)] + [(1000 + i, 1 << i) for i in range(1, 9)]]
    cases.append([(i, 1) for i in range(0, 900, 3)] + [(i, 2) for i in range(1, 60, 7)] + [(i, 12) for i in range(2, 40, 5)])
    cases.append([(rng.randrange(60), rng.choice([1, 2, 4, 3, 6, 7])) for _ in range(200)])
    for rows in cases:
        items = spark.createDataFrame(rows, "id long, code long")
        out = hamming.top_k(items, spark.createDataFrame([(5000, 0), (3, 1)], "id long, code long"), k=k).collect()
        for query, code in [(5000, 0), (3, 1)]:
            nearest: dict[int, int] = {}
            for i, c in rows:
                if i != query:
                    nearest[i] = min(nearest.get(i, 64), (c ^ code).bit_count())
            want = sorted((d, i) for i, d in nearest.items())[:k]
            assert sorted((r["rank"], r.distance, r.id) for r in out if r.query_id == query) == [(n + 1, *w) for n, w in enumerate(want)]


def test_top_k_small_tables(spark):
    items = spark.createDataFrame([(0, 5), (20, 5), (3, None)], "id long, code long")
    out = hamming.top_k(items, items, k=10).collect()
    assert sorted(tuple(r) for r in out) == [(0, 1, 20, 0), (20, 1, 0, 0)]
    assert hamming.top_k(items.where("false"), items.where("false"), k=3).collect() == []
    short = spark.createDataFrame([(1, [1.0, None, -1.0])], "id long, v array<double>")
    assert short.select(hamming.sign_code(F.col("v"), 8)).first()[0] == 0b10000000


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


LISTED = ["free-bets.example.com", "Adult-X.example.com", "kasino.example", "spam.co.uk", "a", None, "", "spam.co.uk", ".".join(["x"] * 300)]


def judged(url):
    """Host, path, rule and verdict by the letter of the contract."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        best = max(fits, key=lambda r: len(r[1] + r[2]))
        return host, path, best[1] + best[2], best[0]
    names = {d.lower() for d in LISTED if d and d.count(".") < 127}
    listed = any(host == d or host.endswith("." + d) for d in names)
    return host, path, None, "block" if listed else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "://A.NET/x", "http://a.net", "http://net/?q", "https://X.Example.NET/en/1#t", "http://example.net/en", "http://www.example.com/de/", "http://badexample.com/de/", "http://m.org/fr/x?y://z", "http://free-bets.example.com/en/1", "http://adult-x.example.com/de/1", "http://Kasino.example/?x", "a://b#c/d", "http://h?x/y", "http://ÄRGER.org/fr/"]
    urls += [f"http://host{i}.example.com/p" for i in range(300)] + [f"http://c{i}.free-bets.example.com/p" for i in range(100)]
    urls += ["http://spam.co.uk", "http://www.Spam.co.uk/x", "http://notspam.co.uk", "http://co.uk", "http://.a", "http://a.b", "http://b..a/", "http://" + "y." * 50_000 + "spam.co.uk/", "http://" + "z" * 50_000]
    rows = [(i, u, "old", "old") for i, u in enumerate(urls)]
    df = spark.createDataFrame([*rows, rows[7]], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([(d,) for d in LISTED], "domain string")
    for shard_bits in (urlfilter.SHARD_BITS, 8):
        out = urlfilter.filter_urls(df, RULES, listed, shard_bits=shard_bits).select("page_id", "host", "path", "rule", "verdict").collect()
        assert len(out) == len(urls) + 1
        for r in out:
            assert tuple(r)[1:] == judged(urls[r.page_id]), urls[r.page_id]
    assert urlfilter.filter_urls(df.where("false"), RULES, listed).collect() == []
    assert {r.verdict for r in urlfilter.filter_urls(df.where("page_id in (6, 18)"), RULES, listed.where("false")).collect()} == {"block", "allow"}


@pytest.mark.parametrize("shard_bits", [urlfilter.SHARD_BITS, 2000])
def test_cascade_is_exact_on_its_universe(spark, shard_bits):
    """Listed by chance, so that no expression on the key can tell."""
    rng = random.Random(5)
    rows = [(i, rng.random() < 0.03) for i in range(30_000)]
    keys = urlfilter.hashed_keys(spark.createDataFrame(rows, "id long, listed boolean").select(F.col("id").cast("string").alias("key"), "listed"))
    cascade = urlfilter.build_cascade(keys, work_dir(spark), shard_bits)
    rows = keys.toPandas()
    got = cascade.contains(rows["h1"].to_numpy().view(np.uint64), rows["h2"].to_numpy().view(np.uint64))
    assert (got == rows["listed"].to_numpy()).all() and len(cascade.shards[0]) > 2
    assert (len(cascade.shards) > 3) == (shard_bits == 2000)
    assert cascade.bits < 20 * rows["listed"].sum()


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_language_of_held_out_documents(spark, labelled):
    train, test = labelled.where("doc_id % 2 = 0"), labelled.where("doc_id % 2 = 1")
    out = langid.identify(langid.document_records(test, {"doc_id": F.col("doc_id"), "truth": F.col("lang")}), langid.fit(train), ["doc_id", "truth"]).toPandas()
    assert (out["lang"] == out["truth"]).mean() > 0.97 and out["kept"].mean() > 0.97


def test_evidence(spark, labelled):
    model = langid.fit(labelled)
    sample = {r.lang: r.text for r in labelled.dropDuplicates(["lang"]).collect()}
    rng = random.Random(2)
    noise = "".join(rng.choice("qxzjkvw") for _ in range(3000))
    rows = [(i, sample["de"], "de", "com", "h1") for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", None, None, "h1"), (102, "!!! 123", "de", None, None), (103, noise, None, None, None), (104, "", None, "com", "new"), (105, sample["fr"], "de", "com", "h1")]
    records = spark.createDataFrame([(*r, "x") for r in [*rows, rows[-1]]], "id long, text string, declared string, suffix string, host string, lang string")
    out = {r.id: r for r in langid.identify(records, model, ["id"]).collect()}
    assert len(out) == len(rows)
    assert out[100].lang == "und" and not out[100].kept
    assert out[101].lang == "de" and out[101].kept
    assert out[102].lang == "de"
    assert out[103].lang == "und" and not out[103].kept
    assert out[104].lang == "de"
    assert out[105].lang == "fr"
    nothing = langid.fit(labelled.where("false"))
    assert nothing.langs == ["und"] and not any(r.kept for r in langid.identify(records, nothing, ["id"]).collect())
    assert langid.identify(records.where("false"), model, ["id"]).collect() == []


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def posteriors(rows, model):
    """By the docstring, row by row: text likelihood, declared code, host leaning on suffix leaning on the whole."""
    n = len(model.langs)
    logs = [model.score(r["text"]).astype(float) for r in rows]
    said = [softmax(x) if x.any() else np.zeros(n) for x in logs]
    whole = sum(said, np.zeros(n))
    spoken = whole[:-1].sum()
    base = np.array([(1 - langid.UND_PRIOR) * (w + 1) / (spoken + n - 1) for w in whole[:-1]] + [langid.UND_PRIOR])

    def total(field, value):
        return sum((s for r, s in zip(rows, said, strict=True) if r[field] == value), np.zeros(n))

    def heard(field, value):
        return value is not None and any(r[field] == value and x.any() for r, x in zip(rows, logs, strict=True))

    def lean(own, towards, weight):
        return (own + towards * weight) / (own.sum() + weight)

    every = sum((s for r, s in zip(rows, said, strict=True) if r["declared"] is not None), np.zeros(n))
    out = []
    for r, x in zip(rows, logs, strict=True):
        suffix = lean(total("suffix", r["suffix"]), base, langid.SUFFIX_LEAN) if heard("suffix", r["suffix"]) else None
        prior = base if suffix is None else suffix
        if heard("host", r["host"]):
            prior = lean(total("host", r["host"]), prior, langid.HOST_LEAN)
        x = x + np.log(prior + 1e-12)
        if heard("declared", r["declared"]):
            own = total("declared", r["declared"])
            x = x + np.log((own + own.sum() / every.sum() * langid.DECLARED_LEAN) / (every + langid.DECLARED_LEAN) + 1e-12)
        out.append(softmax(x))
    return out


def test_posteriors_against_brute_force(spark, labelled):
    """Each host has one suffix, as hosts do."""
    model = langid.fit(labelled, fit_rows=20)
    rng = random.Random(12)
    texts = [r.text for r in labelled.limit(80).collect()]
    rows = []
    for i in range(200):
        text = rng.choice([None, "", "la", rng.choice(texts)[: rng.choice([4, 12, 40, 2000])]])
        host = rng.choice([None, *(f"h{k}" for k in range(8))])
        suffix = None if host is None else ["com", "de", None][int(host[1]) % 3]
        rows.append({"id": i, "text": text, "declared": rng.choice([None, "en", "de", "zz"]), "suffix": suffix, "host": host})
    records = spark.createDataFrame([tuple(r.values()) for r in rows], "id long, text string, declared string, suffix string, host string")
    got = {r.id: r for r in langid.identify(records, model, ["id"]).collect()}
    for r, p in zip(rows, posteriors(rows, model), strict=True):
        assert abs(got[r["id"]].posterior - p.max()) < 1e-6
        lang = got[r["id"]].lang  # und also where there is no evidence at all
        assert abs(p[model.langs.index(lang)] - p.max()) < 1e-9 or (lang == langid.UND and not model.score(r["text"]).any())


def test_fitting_takes_different_texts_of_each_language(spark):
    """Copies count once, a rare language whole, however many rows another has."""
    rows = [("x", f"text number {i}") for i in range(300)] + [("y", "the same words again")] * 3000 + [("y", f"tok{i} und so weiter") for i in range(5)] + [(None, "none"), ("z", None), ("w", "")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    model = langid.fit(df, fit_rows=20)
    assert model.langs == ["x", "y", "und"]
    few = spark.createDataFrame([("y", "the same words again")] + [("y", f"tok{i} und so weiter") for i in range(5)], "lang string, text string")
    assert np.allclose(model.table[:, 1], langid.fit(few).table[:, 0])


def test_markup(spark):
    pages = spark.createDataFrame([(1, "https://A.Example.DE:80/x", "<!doctype html><html class=x lang='DE-at'><script>var t='</p>';</script><p>Hallo &amp; Welt<br>"), (2, None, None), (3, "http://10.0.0.1/", "<html>no")], "page_id long, url string, html string")
    out = {r.page_id: r for r in langid.page_records(pages, {"page_id": F.col("page_id")}).collect()}
    assert (out[1].declared, out[1].suffix, out[1].host) == ("de", "de", "a.example.de") and out[1].text.split() == ["Hallo", "Welt"]
    assert tuple(out[2])[1:] == (None,) * 4 and out[3].suffix is None and out[3].declared is None
