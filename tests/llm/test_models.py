import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import anisotropic, spotsigs, toxicity


def words(rng, n):
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "tu", "re")) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_toxicity_learns_stems_and_misspellings(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        text = words(rng, 60)
        if bad:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(("Wretched", "vermin", "filthy")))
            text = " ".join(parts)
        docs.append((i, text, "x", 0.5, 3))
        labels.append((i, 0, int(bad)))
    tests = [(1000, words(rng, 60), "x", 0.5, 3), (1001, words(rng, 30) + " wretchd vermiin filthyy wretched " + words(rng, 20), "x", 0.5, 3), (1002, None, "x", 0.5, 3), (1003, "", "x", 0.5, 3), (None, "ka lo", "x", 0.5, 3), (1004, words(rng, 30000), "x", 0.5, 3)]
    schema = "doc_id long, text string, lang string, score double, predicted int"
    df = spark.createDataFrame(docs + tests + tests[:1], schema)
    lab = spark.createDataFrame(labels + [(5, 0, None), (None, 0, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(docs) + 7
    by = {r.doc_id: r for r in got}
    assert by[1000].predicted == 0 and by[1001].predicted == 1 and by[1004].predicted == 0
    assert by[1002].score == by[1003].score and 0 <= by[1002].score < 0.7
    assert sum(by[i].predicted == labels[i][2] for i in range(400)) >= 390
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert toxicity.score(df.limit(0), model).collect() == []
    none = toxicity.train(df, lab.limit(0))
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}


def plain_score(model, text):
    """A score in plain Python: every n-gram's bucket by itself, the mean over them and the prior."""
    c = [0] + [ord(x) if ord(x) >= 1 << 16 or x.isalnum() else 0 for x in text.lower()] + [0]
    total, n = 0.0, 0
    for at in range(len(c)):
        h = (c[at] * 0x9E3779B1 + (c[at + 1] if at + 1 < len(c) else 0)) % 2**32
        for k in (3, 4, 5):
            if at + k > len(c):
                break
            h = (h * 0x85EBCA6B + c[at + k - 1] + k) % 2**32
            if all(c[at + 1 : at + k - 1]):
                x = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                total, n = total + float(model.parts[x >> 32 - toxicity.BITS]), n + 1
    return 1 / (1 + math.exp(-(total / (n + model.prior) + model.bias)))


def test_scores_against_plain_python(spark):
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 9, 1 << toxicity.BITS).astype(np.float32), 0.3, 20)
    texts = ["", " ", "a", "ab", "Hello wörld, hello", "日本 x", "😀😀 ok", "a\0b", words(random.Random(2), 300), "x" * 5000, ".. !!"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model, t), abs=1e-9)
        ids, times = np.unique(toxicity.buckets([t])[0], return_counts=True)
        assert model.of_row(ids, times) == pytest.approx(got[i], abs=1e-9)


def test_a_score_at_the_threshold_is_predicted(spark):
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.4)
    at = float(model.scores(["x"])[0])
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(df, model, threshold=at).collect()] == [1, 1, 1]
    assert toxicity.without_toxic(df, model, threshold=at).count() == 0
    assert [r.predicted for r in toxicity.score(df, model, threshold=at + 1e-9).collect()] == [0, 0, 0]


def test_settings_are_chosen_without_held_out_rows(spark):
    rng = random.Random(6)
    docs = [(i, words(rng, 40) + (" vermin filthy" if i % 2 else "")) for i in range(240)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int")
    rows = toxicity.labelled(df, lab.where(~toxicity.held_out()))
    assert {zlib.crc32(str(r[0]).encode()) % 3 for r in rows} == {0, 2}
    settings = [{"prior": 30, "rate": 40.0, "epochs": 20}, {"prior": 1e9, "rate": 0.001, "epochs": 1}]
    found = toxicity.compared(rows, settings)
    assert [x[3] for x in found] == settings and found[0][0] < found[1][0] and found == toxicity.compared(rows, settings)


def test_the_driver_gets_the_model_and_not_the_rows_it_is_fitted_on(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"{rng.randrange(10**9)}" for _ in range(150)) for _ in range(160)] + [None, ""]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "again"), (None, "x")]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, i % 2) for i in range(162)], "doc_id long, toxic int")
    rows = toxicity.labelled(df, lab)
    want = toxicity.fit([r[1:] for r in rows])
    assert len(rows) == 164 and sum(r[1].nbytes + r[2].nbytes for r in rows) > 3 * want.parts.nbytes
    plain, got = type(df).collect, []
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(plain(self)) or got[-1])
    model = toxicity.train(df, lab)
    assert 0 < sum(len(x) for found in got for r in found for x in r if isinstance(x, (bytes, bytearray))) <= want.parts.nbytes
    assert np.allclose(model.parts, want.parts, atol=1e-5) and model.bias == pytest.approx(want.bias) and model.prior == want.prior


def test_buckets_are_those_of_single_texts():
    texts = ["", "a", "Hello wörld", "日本 x", "😀😀 ok", "a\0b", "abc def"]
    ids, n = toxicity.buckets(texts)
    assert [ids[e - k : e].tolist() for e, k in zip(np.cumsum(n), n)] == [toxicity.buckets([t])[0].tolist() for t in texts]


def test_edited_likeness(spark):
    rng = random.Random(2)
    texts = [None, "", " .. ", "one", "The house of a man", "日本 語"] + [" ".join(rng.choice(("the", "of", "and", "house", "tree", "river", "Stone")) for _ in range(rng.randrange(80))) for _ in range(40)] + ["the cat " * 9000]
    rows = [(i * 3, t, "x", 1, 1.0) for i, t in enumerate(texts)] + [(500, "same of the tree", "x", 1, 1.0), (503, "same of the tree", "x", 1, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range string, guest int, near_next double").repartition(3)
    got = {r.doc_id: r for r in spotsigs.edited_likeness(df).collect()}
    sign = spotsigs.Signatures()
    assert len(got) == len(rows)
    for i, (doc, text, *_) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        a, b, c = set(sign(text).tolist()), set(sign(edited).tolist()), set(sign(nxt).tolist())
        j = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        r = got[doc]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), j(a, b), j(a, c))
        assert r.fingerprint == "".join(f"{x:08x}" for x in sorted(a))
    assert got[500].fingerprint == got[503].fingerprint and got[500].near_next == 1.0
    assert spotsigs.edited_likeness(df.limit(0)).collect() == []
    alone = spotsigs.edited_likeness(df.where("doc_id = 500")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    odd = spark.createDataFrame([(None, "a of the b c"), (1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    assert spotsigs.edited_likeness(odd).count() == 4


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_spotsigs_near_duplicates(spark, least):
    rng = random.Random(3)
    sets = []
    for i in range(80):
        base = [rng.randrange(60) for _ in range(rng.randrange(0, 25))]
        sets += [base, [x for x in base if rng.random() < 0.9], base + [rng.randrange(60)]]
    sets = [sorted(set(s)) for s in sets]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, signatures array<long>")
    members, links = spotsigs.near_duplicates(df, least)
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[tuple(s)] for i, s in enumerate(sets)}
    want = {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and a and b and len({*a} & {*b}) / len({*a} | {*b}) >= least}
    assert {(r.a, r.b) for r in links.collect()} == want


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(anisotropic, "SLICE", 300)
    monkeypatch.setattr(anisotropic, "BLOCK", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 17)).astype(np.float32)
    x[100:300] = x[7]  # a large group of equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5020, [0.0] * 17, 1), (5040, [float("nan")] * 17, 1), (5060, [float("inf")] + [1.0] * 16, 1), (None, x[0].tolist(), 1), (0, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = anisotropic.search(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    for q, found in by.items():
        s = x.astype(float) @ x[q].astype(float)
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += len({*want} & {r.vec_id for r in found})
    assert hits / (20 * len(by)) >= 0.9
    assert anisotropic.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    huge = spark.createDataFrame([(i, [float(1 + i) * 10.0**150, 1.0, -(10.0**150)]) for i in range(30)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in anisotropic.search(huge, F.col("vec_id") == 20, 5).orderBy("rank").collect()] == [29, 28, 27, 26, 25]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in anisotropic.search(twice, F.col("vec_id") == 0).orderBy("rank", F.col("score").desc()).collect()] == [(1, 1, 2.0), (1, 1, 1.0), (2, 0, 0.0), (2, 0, 0.0)]
    few = df.where("vec_id in (20, 21, 22)")
    assert [(r.query_id, r["rank"]) for r in anisotropic.search(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(20, 1), (20, 2)]


def test_queries_whose_id_repeats_get_all_their_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(259, 8))
    ids = [0] * 60 + list(range(1, 200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    found = {}
    for r in anisotropic.search(df, F.col("vec_id") == 0, rerank=100).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    want = []
    for q in range(60):
        s = x @ x[q]
        want += [(n, ids[i], round(s[i], 9)) for n, i in enumerate(sorted((i for i in range(259) if i != q), key=lambda i: (-s[i], ids[i]))[:20], 1)]
    assert sorted(found[0]) == sorted(want) and len(want) == 1200


def test_search_finds_all_of_the_nearest_in_groups_and_among_unequal_lengths(spark):
    rng = np.random.default_rng(1)
    groups = rng.normal(size=(4, 16))[rng.integers(0, 4, 2400)] + 0.03 * rng.normal(size=(2400, 16))
    lengths = rng.normal(size=(2400, 16)) * np.exp(1.5 * rng.normal(size=(2400, 1)))
    for x in (groups, lengths):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in anisotropic.search(df, F.col("vec_id") % 60 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for q in range(0, 2400, 60):
            s = np.einsum("nd,d->n", x, x[q])
            s[q] = -np.inf
            assert got[q] == np.lexsort((np.arange(2400), -s))[:20].tolist()
