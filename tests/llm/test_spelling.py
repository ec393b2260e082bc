import random
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, id int, root long"
LATIN = "".join(map(chr, range(0xC0, 0x100)))


def edits(a, b):
    """Whether two different strings are one edit apart, by definition."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, least=6, often=5, one_in=199):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= often}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and edits(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, n, len(near[w]), form.get(w), words.get(form.get(w)), root))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    got = S.spelling_variants(df, **kw).select("word", "n", "n_near", "form", "form_n", "root")
    return sorted(tuple(r) for r in got.collect())


def test_matches_brute_force(spark):
    rng = random.Random(1)
    letters = "abcàéÿ×÷"
    base = ["".join(rng.choices(letters, k=rng.randint(5, 8))) for _ in range(40)]
    vocab = list(base)
    for w in base:
        for _ in range(6):
            i = rng.randrange(len(w))
            vocab.append(rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :])))
    weights = [rng.choice((1, 5, 25, 125)) for _ in vocab]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(vocab, weights, k=120)) + "Ā") for i in range(120)]
    rows += [(None, " ".join(base) * 2), (3, None), (4, ""), (5, "ſſ K —"), (6, rows[0][1]), (6, rows[0][1])]
    want = brute(rows)
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] > 3 for r in want)
    assert run(spark, rows) == want


def test_every_kind_of_edit_ties_and_runs_of_equal_letters(spark):
    words = {"aaaaaa": 1000, "aaaaaaa": 30, "aaaaab": 30, "baaaaa": 30, "abaaaa": 6, "bbbbbb": 5, "ababab": 50, "bababa": 50, "abababa": 7, "aaaabb": 150, "ÿaaaaa": 5, "áaaaaa": 5, "aabbbb": 5, "zzzzzz": 5}
    rows = [(None, " ".join([w] * n)) for w, n in words.items()]
    got = run(spark, rows)
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by["abaaaa"][5] == "aaaaaa" and by["zzzzzz"][2:5] == (0, None, None)


def test_long_words_share_hashed_keys(spark):
    rng = random.Random(2)
    words = []
    for n in (63, 64, 65, 66, 67, 300, 4000):
        w = "".join(rng.choices("abcé", k=n))
        i = rng.randrange(n)
        words += [w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[:i] + "xy" + w[i:], w + w[-1]]
    words += ["a" * n for n in (64, 65, 66, 2000, 2001)]
    rows = [(None, " ".join([w] * (5 + 30 * (k % 3)))) for k, w in enumerate(dict.fromkeys(words))]
    assert run(spark, rows) == brute(rows)
    for w in ("abca" * 30, "é" * 80):
        first, _ = S.deletions(w)
        assert S.hashed_keys(w, first) == [S.hashed_keys(w[:i] + w[i + 1 :], None)[0] for i in first.tolist()]


def test_empty_table_and_no_words(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "a b c")]) == []
    rows = [(i, "planes planet plants " * 3) for i in range(9)]
    assert run(spark, rows, one_in=0) == [("planes", 27, 2, None, None, "planes"), ("planet", 27, 1, None, None, "planet"), ("plants", 27, 1, None, None, "plants")]
    with pytest.raises(ValueError):
        S.spelling_variants(spark.createDataFrame([], SCHEMA), ratio=1)


def test_forms_are_followed_to_the_end(spark):
    forms = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100 + i, 0) for i in range(50)], "id long, form long")
    assert {tuple(r) for r in S.followed(forms).collect()} == {(i, 20) for i in range(20)} | {(100 + i, 20) for i in range(50)}
