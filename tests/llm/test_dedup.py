"""Near duplicates, repeated passages, decontamination and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brindle.llm import common, decontam, minhash, substring
from brindle.llm.common import window_hashes, word_hashes, work_dir
from brindle.llm.components import components

from .brute import contamination, near_groups, shingle_set, without_repeats, words

VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    passage = prose(rng, 70)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One  two"), (5, "one"), (6, "a b c d e"), (7, "A B c d\te")]
    for g in range(12):
        base = prose(rng, rng.choice([6, 30, 120, 300]))
        out += [(100 + 20 * g + k, edited(rng, base, k * max(1, len(base) // 300))) for k in range(7)]
    out += [(1000 + k, prose(rng, 20) + " " + passage + " " + prose(rng, rng.randrange(1, 40))) for k in range(30)]
    out += [(2000 + k, passage.upper() if k % 2 else passage) for k in range(6)]
    out += [(3000, passage[: len(passage) // 2] + " " + prose(rng, 5000) + " " + passage), (3001, " ".join(["same"] * 300)), (3002, " ".join(["same"] * 120))]
    rng.shuffle(out)
    return out


def frame(spark, rows):
    """With columns that have the results' names, a null id and a repeated row."""
    full = [(i, t, 0, True, 7) for i, t in rows] + [(None, rows[0][1] or "x", 0, True, 7), (*rows[3], 0, True, 7)]
    return spark.createDataFrame(full, "doc_id long, text string, component_id long, kept boolean, n_words long").repartition(5)


def test_near_duplicates(spark, docs):
    groups, sizes = near_groups(docs)
    out = minhash.near_duplicates(frame(spark, docs)).collect()
    assert len(out) == len(docs) + 2
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (groups[r.doc_id], sizes[r.doc_id], groups[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(frame(spark, docs).where("false")).collect() == []


@pytest.mark.parametrize("bucket_rows", [2048, 3])
def test_near_duplicates_of_ids_with_several_texts(spark, monkeypatch, bucket_rows):
    """Every row by its own text: as if each had an id of its own, but named by the ids there are."""
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(8)
    bases = [prose(rng, 120) for _ in range(6)]
    rows = [(i, edited(rng, base, k % 2)) for i, base in enumerate(bases) for k in range(2)]
    rows += [(0, edited(rng, base, 1)) for base in bases] + [(rng.randrange(6), edited(rng, rng.choice(bases), 1)) for _ in range(20)]
    rows += [(2, prose(rng, 50)), (2, ""), (3, prose(rng, 50)), (9, bases[4]), (9, prose(rng, 9)), (-4, bases[5])]
    groups, _ = near_groups(list(enumerate(t for _, t in rows)))
    smallest: dict[int, int] = {}
    for n, (i, _) in enumerate(rows):
        smallest[groups[n]] = min(i, smallest.get(groups[n], i))
    want = sorted((i, len(shingle_set(t)), smallest[groups[n]], smallest[groups[n]] == i) for n, (i, t) in enumerate(rows))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()) == want


@pytest.mark.parametrize("bucket_rows", [1, 3, 8])
def test_large_buckets_are_split(spark, docs, monkeypatch, bucket_rows):
    """Pairs around the threshold: of one template, of different lengths, at exactly 75 per cent."""
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(3)
    template = [f"t{i}" for i in range(60)]
    docs = docs + [(5000 + k, " ".join(template + [f"{k // 2}u{i}" for i in range(9 + k % 9)])) for k in range(60)]
    docs += [(6000 + k, " ".join(template[: 20 + k])) for k in range(40)] + [(7000 + k, edited(rng, " ".join(template), k % 3)) for k in range(20)]
    docs += [(8000, " ".join(f"e{i}" for i in range(7 + 4))), (8001, " ".join([*(f"e{i}" for i in range(6 + 4)), "f"])), (8002, " ".join(f"e{i}" for i in range(28 + 4)))]
    groups, _ = near_groups(docs)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, docs)).collect() if r.doc_id is not None} == groups


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    errors = []
    for _ in range(40):
        a = prose(rng, 200)
        b = edited(rng, a, rng.randrange(0, 8))
        x, y = (minhash.shingle_sets([t])[0] for t in (a, b))
        true = len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
        p, q = (minhash.signature(minhash.minima(s)).view(np.uint64).reshape(minhash.BITS, -1) for s in (x, y))
        agreeing = minhash.HASHES - int(np.bitwise_count(np.bitwise_or.reduce(p ^ q, axis=0)).sum())
        errors.append(minhash.estimate(agreeing) - true)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < minhash.SLACK


def test_word_and_window_hashes():
    texts = ["a b  c", "", "\n", "b c a b", "é b"]
    h, n = word_hashes([t.encode() for t in texts], lower=False)
    assert n.tolist() == [3, 0, 0, 4, 2] and len(h) == 9
    own = [w for t in texts for w in words(t)]
    assert len({(w, int(x)) for w, x in zip(own, h, strict=True)}) == len(set(own))
    for width in (2, 5, 9, 25):
        w = np.tile(h, 10)
        found = window_hashes(w, width)
        tuples = list(zip(*[(own * 10)[k:] for k in range(width)], strict=False))
        assert len(found) == len(w) - width + 1 == len(tuples)
        assert len(set(zip(tuples, found.tolist(), strict=True))) == len(set(tuples)) == len(set(found.tolist()))


def test_components(spark):
    rng = random.Random(3)
    nodes = list(range(200))
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.choice(nodes[150:]), rng.choice(nodes[150:])) for _ in range(40)]
    rng.shuffle(links)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    folder = work_dir(spark)
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), folder).collect()}
    assert out == {n: find(n) for n in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long"), f"{folder}/none").collect() == []


def test_repeats(spark, docs):
    want = without_repeats(docs)
    out = substring.remove_repeats(frame(spark, docs)).collect()
    assert len(out) == len(docs) + 2
    for r in out:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            own, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_text) == (len(own), len(own) - len(kept), " ".join(kept))
            gone = [j for s in r.spans.split(",") if s for j in range(*map(int, s.split(":")))]
            assert [x for j, x in enumerate(own) if j not in set(gone)] == kept
    assert sum(r.n_removed for r in out) > 1000
    assert substring.remove_repeats(frame(spark, docs).where("false")).collect() == []


@pytest.mark.parametrize("length", [49, 50, 51, 74, 75])
def test_repeats_at_every_offset(spark, length):
    passage = " ".join(f"p{i}" for i in range(length))
    rows = [(i, " ".join([*(f"l{i}x{k}" for k in range(i)), passage, f"r{i}"])) for i in range(60)]
    want = without_repeats(rows)
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept_text for r in out} == {i: " ".join(k) for i, (_, k) in want.items()}
    assert (sum(r.n_removed for r in out) > 0) == (length >= 50)


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([5, 12, 30, 45]))) for i in range(25)] + [(50, None), (51, ""), (52, "too short"), (53, " ".join(["la"] * 20)), (54, " ".join(["la"] * 20))]
    rows = [(1, None), (2, ""), (3, "short one"), (4, prose(rng, 6000))]
    for i, text in items[:25]:
        for edits in range(3):
            rows.append((100 + 10 * i + edits, prose(rng, rng.randrange(0, 30)) + "  " + edited(rng, text, edits).upper() + "\n" + prose(rng, rng.randrange(0, 30))))
    cut = items[7][1].split(" ")
    rows += [(900, " ".join(cut[: len(cut) // 2]) + " " + prose(rng, 50)), (901, " ".join([*cut[:6], "extra", *cut[6:]])), (902, " ".join(["la"] * 90)), (903, items[3][1] + " " + items[3][1] + " " + items[4][1])]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in [*rows, rows[-1]]], "doc_id long, text string, similarity double, item_id long")
    benchmark = spark.createDataFrame([(*r, 1) for r in [*items, items[2]]], "item_id long, text string, doc_id long")
    out = decontam.find(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in out}
    assert len(got) == len(out)
    want = contamination(rows, [(i, t) for i, t in items])
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert decontam.find(docs.where("false"), benchmark).collect() == [] and decontam.find(docs, benchmark.where("false")).collect() == []


def test_decontamination_of_rotated_items(spark):
    """The item's parts exchanged, at the beginning, within and at the end of a text; the best window's place."""
    rng = random.Random(4)
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in (5, 20, 40, 41, 60)] + [(99, [f"i40x{k}" for k in range(40)][::-1])]
    rows = []
    for n, item in items:
        for cut in {n // 2, n // 5, n - 6}:
            for left, right in [(60, 60), (0, 9), (9, 0), (0, 0), (2, 2)]:
                moved = edited(rng, " ".join(item[cut:] + item[:cut]), rng.randrange(2))
                rows.append((len(rows), " ".join([prose(rng, left), moved, prose(rng, right)]).strip()))
        rows += [(len(rows) + j, " ".join([*item[j:], prose(rng, j + 3)])) for j in range(4)]
        rows += [(len(rows) + j, " ".join([prose(rng, 8), *item[: n // 2], *["new"] * j, *item[n // 2 :]])) for j in range(4)]
    texts = [(i, " ".join(t)) for i, t in items]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find(docs, spark.createDataFrame(texts, "item_id long, text string")).collect()}
    want = contamination(rows, texts)
    assert set(got) == set(want) and len(want) > 60
    for (d, i), r in got.items():
        assert abs(r.similarity - want[d, i]) < 1e-9
        w, n = words(rows[d][1], True), dict(items)[i]
        alone = [contamination([(0, " ".join(w[k : k + len(n)]))], [(0, " ".join(n))]).get((0, 0), 0) for k in range(max(1, len(w) - len(n) + 1))]
        assert r["at"] == alone.index(max(alone))


def test_decontamination_by_items_without_an_id(spark):
    a, b, c = (" ".join(f"{i}x{k}" for k in range(12)) for i in range(3))
    docs = spark.createDataFrame([(1, f"before {a} after"), (2, b), (3, c), (4, f"{a} {b}"), (5, "nothing of them at all here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, a), (None, b), (None, b), (7, b), (8, c)], "item_id long, text string")
    out = decontam.find(docs, items).collect()
    assert sorted((r.doc_id, r.item_id or -1, r["at"], r.similarity) for r in out) == [(1, -1, 1, 1.0), (2, -1, 0, 1.0), (2, 7, 0, 1.0), (3, 8, 0, 1.0), (4, -1, 0, 1.0), (4, 7, 12, 1.0)]


def test_decontamination_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_SHINGLES", 7)
    items = [(i, " ".join(f"{i}x{k}" for k in range(12))) for i in range(4)]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in items], "doc_id long, text string")
    out = decontam.find(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r["at"], r.shared, r.total) for r in out) == [(i, i, 1, 8, 8) for i in range(4)]


@pytest.mark.parametrize("groups", [3, 1024])
def test_repeats_in_groups_of_buckets_and_of_many_equal_rows(spark, docs, monkeypatch, groups):
    """More buckets than groups, parts of few values, and rows equal in id and text."""
    monkeypatch.setattr(substring, "GROUPS", groups)
    monkeypatch.setattr(substring, "PART_VALUES", 1000)
    monkeypatch.setattr(substring, "COPIES", 3)
    want = without_repeats(docs)
    copied = [next(r for r in docs if r[0] == i) for i in (1005, 2003, 0)] + [(None, docs[0][1])]
    rows = spark.createDataFrame([*docs, *(copied * 9)], "doc_id long, text string").repartition(3)
    out = substring.remove_repeats(rows).collect()
    assert len(out) == len(docs) + 36 and sum(r.doc_id == 1005 for r in out) == 10
    for r in out:
        if r.doc_id is not None:
            own, kept = want[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_text) == (len(own), len(own) - len(kept), " ".join(kept))


def test_long_texts_are_hashed_piece_by_piece(monkeypatch):
    texts = [b"a bb  ccc " * 50, b"", b" " * 300, b"x" * 200 + b" y", b"one two"]
    whole = word_hashes(texts, lower=False)
    monkeypatch.setattr(common, "CHUNK_BYTES", 16)
    pieces = word_hashes(texts, lower=False)
    assert (whole[0] == pieces[0]).all() and whole[1].tolist() == pieces[1].tolist() == [150, 0, 0, 2, 2]
    assert [b"".join(common.cut_at_blanks(t)) for t in texts] == texts


def test_long_words_of_equal_power_sums_differ():
    """Thue-Morse words of 1024 letters and their complements, alone and in windows."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    for size in (1024, 2048, 4096):
        a = bytes(97 + b for b in bits[:size])
        b = bytes(98 - b for b in bits[:size])
        h, _ = word_hashes([a, b], lower=False)
        assert h[0] != h[1]


@pytest.mark.parametrize("numbers", [[5], [-(1 << 63), (1 << 63) - 1, 0], [7, 7 + 255], [7, 7 + 256], [-3, -70000], [1 << 62, (1 << 62) + (1 << 40)]])
def test_packed_numbers(numbers):
    assert substring._unpacked(substring._packed(np.array(numbers, np.int64))).tolist() == numbers
