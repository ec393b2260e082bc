import random

import numpy as np
import pytest

from lodestone.llm import minhash as M

SCHEMA = "doc_id long, text string, n long, sig string, node int, component_id int"


def brute_set(text):
    words, cur = [], ""
    for ch in text or "":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch in " \t\n\x0b\x0c\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += ch
    words += [cur] if cur else []
    return {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows, percent=80):
    sets = [brute_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = min(ids, default=None)
        out.append((d, len(sets[i]), low, d == low))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in M.minhash_groups(df, **kw).collect()), key=key)


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        i = rng.randrange(len(out))
        out[i : i + rng.randint(0, 2)] = [f"new{rng.randrange(10**6)}"]
    return out


def corpus(rng):
    """Groups whose members lie on either side of the threshold, chains, shared passages, copies."""
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(12):
        base = [f"w{g}_{rng.randrange(10**6)}" for _ in range(rng.choice((6, 40, 150, 400)))]
        chain = base
        for _ in range(rng.randint(2, 25)):
            chain = edited(rng, chain if g % 3 == 0 else base, rng.randint(0, max(1, len(base) // 40)))
            rows.append(" ".join(passage[: rng.choice((0, 60))] + chain))
    rows += rng.choices(rows, k=30) + [t.upper() for t in rng.choices(rows, k=5)] + [" ".join(rng.choices("abcd", k=30)) for _ in range(40)]
    rng.shuffle(rows)
    return [(1000 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,slice_", [(1, 1024), (2, 3)])
def test_groups_match_brute_force(spark, monkeypatch, seed, slice_):
    monkeypatch.setattr(M, "SLICE", slice_)
    monkeypatch.setattr(M, "AT_ONCE", 50)
    rows = corpus(random.Random(seed))
    assert run(spark, rows) == sorted(brute(rows), key=key)


def test_odd_texts(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c"), (None, "a  B\tc"), (5, "a b"), (5, "a b"), (6, "x"), (7, "X"), (None, "lonely words here now"), (8, "e\xa0f g h\x1ci j"), (9, long), (10, long + " end"), (11, long[: len(long) // 2]), (4, "a b c")]
    assert run(spark, rows) == sorted(brute(rows), key=key)
    assert run(spark, []) == []
    assert run(spark, rows, percent=50) == sorted(brute(rows, 50), key=key)


def test_pairs_at_the_threshold_survive_and_strangers_are_dropped():
    rng = np.random.default_rng(3)
    for share, want in ((0.8, 1.0), (0.85, 1.0), (0.3, 0.0)):
        kept = 0
        for _ in range(60):
            both, rest = rng.integers(0, 1 << 63, 400, np.uint64), rng.integers(0, 1 << 63, 800, np.uint64)
            n = int(400 / share) - 400
            a, b = (M.signature(np.unique(np.concatenate((both, x)))) for x in (rest[: n // 2], rest[n // 2 : n]))
            assert share < 0.8 or (M.band_keys(a) == M.band_keys(b)).any()
            kept += len(M.surviving(a.astype(np.uint8)[None], b.astype(np.uint8)[None], 0.8))
        assert kept == 60 * want


def test_miss_probability():
    """At the threshold the steps together lose a pair about as seldom as the posterior bound says, and no band in common is as rare."""
    p, ways, at = 0.8 + 0.2 / 256, np.zeros(241), 0
    ways[0] = 1.0
    lost = 0.0
    for k, need in enumerate(M.needed(0.8)):
        for _ in range(M.STEP):
            ways = ways * (1 - p) + np.concatenate(([0.0], ways[:-1])) * p
            at += 1
        lost += ways[:need].sum()
        ways[:need] = 0
    assert at == 240 and lost < 20 * M.MISS
    assert (1 - 0.8**M.BAND) ** M.BANDS < 1e-8


def test_sizes_alone_can_rule_out():
    a = np.arange(10, dtype=np.uint64)
    assert M.alike(a, a[:8], 80) and not M.alike(a, a[:7], 80) and not M.alike(a[:0], a[:0], 80)
