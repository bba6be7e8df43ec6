"""Mixing sources, token files, and the pipeline."""

from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from brindle.llm import common, decontam, minhash, mixing, tokenstore
from brindle.llm.common import read_table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

from .brute import contamination, near_groups, shingle_set, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def targets(sizes, weights=(1, 2, 3), cap=3.0):
    """source -> target by the letter: share, stop, reshare the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got = dict.fromkeys(names, 0.0)
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        spare = 0.0
        for s in list(open_):
            got[s] += left * weight[s] / total
        for s in list(open_):
            if got[s] >= cap * sizes[s]:
                spare += got[s] - cap * sizes[s]
                got[s] = cap * sizes[s]
                open_.discard(s)
        left = spare
    return got


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_mix(spark, block_rows):
    rng = random.Random(8)
    rows = []
    for s, n in (("b", 400), ("a", 90), ("é", 60), ("Z", 3), (None, 40), ("empty", 5)):
        for _ in range(n):
            size = 0 if s == "empty" else int(rng.lognormvariate(4, 1)) + 1
            rows.append((len(rows), s, "w \t" * size, 1.0))
    rows += [(9000, "a", None, 1.0), (9001, "a", "", 1.0), (None, "a", "x y z", 1.0), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars double")
    out = mixing.mix(docs, block_rows=block_rows)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = {sizes[s]: t for s, t in targets(sizes).items()}
    taken = {}
    for r in got:
        assert r.taken == r.times * r.size and 0 <= r.times <= 3
        assert abs(r.target - want[r.source_size]) < 1e-6 * max(1, r.target)
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for size, t in want.items():
        assert abs(taken[size] - t) <= max(0.01 * t, 30), (size, t, taken[size])
    assert sorted(map(str, mixing.mix(docs.repartition(7), block_rows=block_rows).collect())) == sorted(map(str, got))
    assert mixing.mix(docs.where("false")).collect() == []


def test_mix_of_many_equal_rows(spark, monkeypatch):
    """Equal rows are units of their own, wherever they lie, and no block holds them all."""
    monkeypatch.setattr(common, "CHUNK_COPIES", 7)
    rows = [(None, "a", "one two three")] * 300 + [(5, "a", "x " * 9)] * 50 + [(i, "b", "w " * (i % 40)) for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, block_rows=16).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 300 and sum(r.doc_id == 5 for r in got) == 50
    for total in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == total]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.01 * own[0].target, 10)
    assert sorted(map(str, mixing.mix(docs.repartition(7), block_rows=16).collect())) == sorted(map(str, got))
    taken = mixing.take(docs.withColumns({"__key": F.lit(1), "Chunk": F.lit(2), "a.b": F.lit(3)}), block_rows=16)
    assert taken.columns == ["doc_id", "source", "text", "__key", "Chunk", "a.b"]
    assert abs(sum(len(words(r.text)) for r in taken.collect() if r.source == "a") - next(r.target for r in got if r.doc_id == 5)) < 20


def test_row_keys_tell_rows_apart(spark):
    rows = [("a", None), (None, "a"), ("a", "a"), (None, None), ("", None), ("ab", ""), ("a", "b")]
    df = spark.createDataFrame([*rows, rows[0]], "x string, y string")
    assert df.select(common.row_key(df)).distinct().count() == len(rows)
    assert common.unused(["__Key", "__key_"], "__key") == "__key__"


def test_scratch_folders_go(spark):
    with common.scratch(spark):
        inside, kept = common.work_dir(spark), common.work_dir(spark, keep=True)
        for folder in (inside, kept):
            common.stored(spark.range(3), folder)
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(inside)


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    sizes = [float(rng.randrange(1, 5000)) for _ in range(2000)]
    chances = [rng.random() for _ in sizes]
    count, total = sum(chances), sum(s * c for s, c in zip(sizes, chances, strict=True))
    mixing.flight(sizes, chances, rng)
    assert sum(c not in (0.0, 1.0) for c in chances) <= 2
    assert abs(sum(chances) - count) < 1e-6 and abs(sum(s * c for s, c in zip(sizes, chances, strict=True)) - total) < 1e-2


def test_inclusion_is_fair():
    sizes = [float(3 + i * i % 17) for i in range(40)]
    hits = np.zeros(40)
    for seed in range(600):
        chances = [0.3] * 40
        mixing.flight(sizes, chances, random.Random(seed))
        hits += np.array(chances)
    assert abs(hits / 600 - 0.3).max() < 0.09


def test_take_repeats_rows(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (1 + i % 7), i) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[4], rows[4], rows[4]], "doc_id long, source string, text string, size long")
    mixed = mixing.mix(docs.drop("size")).groupBy("doc_id").sum("times").collect()
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert abs(sum(counts.values()) - sum(r[1] for r in mixed)) <= 3 and mixing.take(docs.where("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, unit):
    a = np.array(ids, np.uint32)
    assert (tokenstore.from_planes(tokenstore.to_planes(a, unit), len(a), unit) == a).all()


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_shards_round_trip(tmp_path, monkeypatch, unit):
    monkeypatch.setattr(tokenstore, "BLOCK_IDS", 64)
    rng = np.random.default_rng(0)
    docs = [(None, rng.integers(0, 50_000, 10)), (3, rng.integers(0, 50_000, 700)), (4, np.zeros(0)), (2**60, rng.integers(0, 2**20, 64)), (9, np.zeros(130))]
    writer = tokenstore.ShardWriter(str(tmp_path), unit)
    for i, ids in docs:
        writer.add(i, ids.astype(np.uint32))
    made = writer.close()
    reader = tokenstore.ShardReader(str(tmp_path), made["name"])
    every = np.concatenate([ids for _, ids in docs]).astype(np.uint32)
    assert made["n_ids"] == reader.n_ids == len(every) and made["n_docs"] == 5
    for a, b in ((0, len(every)), (0, 0), (63, 65), (100, 400), (len(every) - 1, len(every))):
        assert (reader.ids(a, b) == every[a:b]).all()
    ids, lengths, null = reader.documents()
    assert [None if x else int(i) for i, x in zip(ids, null, strict=True)] == [i for i, _ in docs] and lengths.tolist() == [len(x) for _, x in docs]


TEXTS = [None, "", "Plain words, twice: plain words.", "É é ́x H̱x. H̱. IT'S don't ‘q’. ?! x?! 😀 12,5", "<|endoftext|> <|ENDOFTEXT|>. a", "\x85\u2003 odd\x1cspace", "long " * 30_000, "Plain words, twice: plain words."]


def test_word_encoder_equals_whole_texts(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    for limit, size in ((300_000, 3 << 20), (4, 3 << 20), (4, 20)):
        monkeypatch.setattr(tokenstore, "CACHE_WORDS", limit)
        monkeypatch.setattr(tokenstore, "BATCH_BYTES", size)
        monkeypatch.setattr(common, "CHUNK_BYTES", size)
        encoder = tokenstore.WordEncoder(PATH)
        for _ in range(2):
            every = encoder.encode(TEXTS[1:])
            for text, ids in zip(TEXTS[1:], every, strict=True):
                assert ids.tolist() == encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_cut_wrongly_are_encoded_alone(monkeypatch):
    """Ends of words that are miscounted in opposite directions within one text."""
    encoder = tokenstore.WordEncoder(PATH)
    plain = ["alpha", "beta", "gamma", "delta,", "epsilon"]
    ids = encoder.tokenizer.encode("alpha", add_special_tokens=False).ids
    encoder.ends_word[ids[-1]] = False  # as if alpha had no end, and its end fell to another word
    inner = encoder.tokenizer.encode("epsilon", add_special_tokens=False).ids
    if len(inner) > 1:
        encoder.ends_word[inner[0]] = True
    tokenizer = Tokenizer.from_file(PATH)
    assert encoder.encode([" ".join(plain)])[0].tolist() == tokenizer.encode(" ".join(plain), add_special_tokens=False).ids


PIECES = ["a", "The", "é", "E\u0301", "h", "H", "\u0331", "=", "\u0338", "<", "'", "'s", "'LL", "’", "“", ".", "...", "12", "٣", "ẞ", "İ", "K", "Σ", "ς", "\0", "\x1c", "\x85", " ", "\n", "漢字", "😀", "_", "-", "$", "x" * 15, "y" * 16, "ab" * 9, "<|", "|>", "<|endoftext|>", "<|EndOfText|>", "startoftext"]


@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=14).map("".join), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_whole_texts(texts):
    """Cuts beside ASCII letters, lower case and added tokens change no id."""
    encoder = tokenstore.encoder(PATH)  # keeps the pieces of the texts before
    for size in (1 << 17, 3):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tokenstore, "PIECES", size)
            for text, ids in zip(texts, encoder.encode(texts), strict=True):
                assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def learnt(encoder, monkeypatch):
    """The pieces that go to the tokenizer."""
    found, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (found.extend(words), learn(words))[1])
    return found


def test_a_piece_is_encoded_once(monkeypatch):
    encoder = tokenstore.WordEncoder(PATH)
    found = learnt(encoder, monkeypatch)
    encoder.encode(["Plain plain, (PLAIN) plain. plain's"])
    assert sorted(w.decode().lower() for w in found) == ["'s", "(", ")", ",", ".", "plain"]
    found.clear()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters]  # more than a dictionary had room for
    text = " ".join(words)
    first = encoder.encode([text])[0]
    assert len(found) == len(words) == 26**4
    assert (encoder.encode([text.title()])[0] == first).all() and len(found) == len(words)


def test_table_keeps_what_was_met_again(monkeypatch):
    monkeypatch.setattr(tokenstore, "CACHE_WORDS", 100)
    encoder = tokenstore.WordEncoder(PATH)
    often, rng = [f"{c}ften" for c in "abcdefghij"], random.Random(3)
    for _ in range(60):
        text = " ".join(often + ["".join(rng.choices("abcdefgh", k=rng.randint(1, 20))) for _ in range(30)])
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.table.n <= 100 + 40
    found = learnt(encoder, monkeypatch)
    encoder.encode([" ".join(often)])
    assert not found


def test_tokenizers_that_see_more_than_words_are_refused():
    others = [p for p in public_tokenizers.__path__ for p in sorted(Path(p).glob("*.json"))]
    refused = 0
    for path in others:
        try:
            encoder = tokenstore.WordEncoder(str(path))
        except Exception:
            refused += 1
            continue
        for text in ("Plain words, twice: plain  words.", "x 12 é"):
            assert encoder.encode([text])[0].tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
    assert len(others) > 1 and 0 < refused < len(others)


def test_token_files(spark):
    rows = [(i * 7 % 50, t, "old") for i, t in enumerate(TEXTS * 3)] + [(None, "null id", "old"), (-5, "negative", "old"), (2**60 + 1, "large", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = tokenstore.new_folder(spark)
    manifest = tokenstore.write(docs, folder, PATH, 2)
    out = tokenstore.documents(manifest, folder).collect()
    tokenizer = Tokenizer.from_file(PATH)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest(r[1] or "", 42)).astype(np.int64)))
    want, start = [], 0
    for i, text, _ in order:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    first = tokenstore.tokens(manifest, folder).where("doc_id = -5").first()
    assert first.ids == [*tokenizer.encode("negative", add_special_tokens=False).ids, 2]
    none = tokenstore.new_folder(spark)
    assert tokenstore.documents(tokenstore.write(docs.where("false"), none, PATH, 2), none).collect() == []


def test_pipeline_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "token_files"]
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        path = f"{corpus_pipeline.work_dir(spark)}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in kept.items()}
    everything = read_table(spark, sf_dir, "documents").count()
    assert len(ids["language_id"]) > 0.95 * everything
    groups = minhash.near_duplicates(kept["language_id"]).where("kept").select("doc_id").collect()
    assert sorted(ids["near_dedup"]) == sorted(r.doc_id for r in groups)
    hits = {r.doc_id for r in decontam.find(kept["near_dedup"], read_table(spark, sf_dir, "benchmark")).collect()}
    assert hits and sorted(ids["decontaminate"]) == sorted(set(ids["near_dedup"]) - hits)
    assert set(ids["mix"]) <= set(ids["decontaminate"]) and max(ids["mix"].count(i) for i in set(ids["mix"])) <= 3


def test_pipeline_edges(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "src1", 0), (10_000, "12 !!", None, None, 5), (10_001, docs.first().text, "en", "src1", 9)], docs.schema)
    docs = docs.unionByName(odd).unionByName(odd).unionByName(docs.limit(3))
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, sf_dir), stage(spark, empty, sf_dir)
        docs, empty = (corpus_pipeline.stored(d, f"{corpus_pipeline.work_dir(spark)}/x") for d in (docs, empty))
        assert empty.count() == 0
    assert docs.count() > 20


def test_pipeline_keeps_columns_of_clashing_names(spark, sf_dir):
    """Columns called as the stages' own stay as they are; one version of an id stays and is judged."""
    text = read_table(spark, sf_dir, "documents").where("lang = 'en' and length(text) > 800").first().text
    other = read_table(spark, sf_dir, "documents").where("lang = 'de' and length(text) > 800").first().text
    rows = [(1, text, "en", "s", 1), (5, text, "en", "s", 2), (5, other, "de", "s", 3), (9, other, "de", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"__key": F.lit("mine"), "__version": F.lit(7), "declared": F.lit("xx"), "component_id": F.col("n_chars")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = sorted(tuple(r) for r in out.select("doc_id", "n_chars", "__key", "__version", "declared").collect())
        if name == "near_dedup":
            first = 2 if text < other else 3
            want = {1, 4} if first == 2 else {1, 3}
            assert {r[1] for r in got} == want
        elif name != "mix":
            assert [r[1] for r in got] == [1, 2, 3, 4]
        assert all(r[2:] == ("mine", 7, "xx") for r in got)


def test_pipeline_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas().sort_values("start")
    assert (out["start"].to_numpy() == np.concatenate([[0], out["n_tokens"].cumsum()[:-1]])).all() and out["doc_id"].is_monotonic_increasing


def test_pipeline_rows_against_brute_force(spark, sf_dir):
    """run()'s rows from plain versions of the stages; only the classifier's verdicts and the draws are taken over."""
    docs = read_table(spark, sf_dir, "documents")
    spoken = [(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, sf_dir).collect()]
    groups, _ = near_groups(spoken)
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    item_shingles = {i: shingle_set(t) for i, t in items}
    clean = {}
    for i, text in spoken:
        if groups[i] == i:
            shingles = shingle_set(text)
            near = [item for item in items if shingles & item_shingles[item[0]]]  # others have similarity zero
            if not contamination([(i, text)], near):
                clean[i] = text
    assert 0 < len(clean) < len(spoken)
    taken = mixing.take(docs.where(docs["doc_id"].isin(list(clean)))).select("doc_id").collect()
    tokenizer = Tokenizer.from_file(PATH)
    want, start = [], 0
    for i in sorted(r.doc_id for r in taken):
        ids = np.array([*tokenizer.encode(clean[i] or "", add_special_tokens=False).ids, corpus_pipeline.END_ID], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=lambda r: r[1]) == want
