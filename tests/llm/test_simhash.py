import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import simhash as S

SCHEMA = "doc_id long, text string, fp string, root int, component_id int"


def brute_fingerprint(text):
    words, cur = [], ""
    for ch in text or "":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch in " \t\n\x0b\x0c\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += ch
    words += [cur] if cur else []
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids, default=None)))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in S.simhash_groups(df, **kw).collect()), key=key)


@pytest.mark.parametrize("form", ["single", "pairs"])
def test_groups_match_brute_force(spark, form):
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "été", "日本", "d-e", "x", "YY", "zé"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        rows.append((i, " ".join(words)))
        if i % 4 == 0 and words:
            words[rng.randrange(len(words))] = "edit"
            rows.append((1000 - i, "\n".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (None, "alpha Beta"), (5, "one"), (5, "one"), (2003, "ab " * 30000)]
    assert run(spark, rows, form=form) == sorted(brute_groups(rows), key=key)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("pairs", [False, True])
def test_anchors_join_everything_within_four_bits(pairs):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y[i] ^= np.uint64(1 << int(b))
    home, guest = {}, {}
    for row, key_, is_home in zip(*(a.tolist() for a in S.anchored(x, pairs))):
        if is_home:
            home.setdefault(row, set()).add(key_)
    for row, key_, is_home in zip(*(a.tolist() for a in S.anchored(y, pairs))):
        if not is_home:
            guest.setdefault(row, set()).add(key_)
    assert all(home[i] & guest[i] for i in range(len(x)))


def test_large_group_gives_few_links(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 100)
    fps = sorted({0} | {1 << a | 1 << b for a in range(64) for b in range(a)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], T.StructType([T.StructField("fp", T.LongType())]))
    links = S.hamming_links(df)
    assert links.count() < 40 * len(fps)
    from lodestone.llm.components import connected_components
    roots = connected_components(links)
    assert roots.count() == len(fps) and roots.select("root").distinct().count() == 1


def test_components(spark):
    from lodestone.llm.components import connected_components
    path = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (200, 200), (101, 100), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200}


def test_crowded_anchors_are_cut_both_ways(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 50)
    monkeypatch.setattr(S, "GUESTS", 1000)
    guests, homes = 100_000, 200
    rows = spark.range(guests).selectExpr("cast(7 as long) anchor", "id fp", "false home").unionByName(spark.range(homes).selectExpr("cast(7 as long) anchor", "id + 1000000 fp", "true home"))
    rows = rows.unionByName(spark.createDataFrame([(8, 1, False), (9, 2, True), (9, 3, False)], "anchor long, fp long, home boolean"))
    out = S.dealt(rows)
    by = {r.key: (r.h, r.g) for r in out.groupBy("key").agg(F.count(F.when(F.col("home"), 1)).alias("h"), F.count(F.when(~F.col("home"), 1)).alias("g")).collect()}
    hot = [v for k, v in by.items() if k >> 34 == 7]
    assert len(hot) == 4 * 100 and max(h for h, _ in hot) < 100 and max(g for _, g in hot) < 1300
    assert sum(h for h, _ in hot) == homes * 100 and sum(g for _, g in hot) == guests * 4
    assert by[9 << 34] == (1, 1)
