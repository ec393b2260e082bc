import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment as A
from lodestone.llm import piecewise

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pair string, pairs int, dictionary int, n_a long"


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    code = {c: b for b, c in piecewise.byte_chars().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)

    def of_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(code[c] for c in a.id_to_token(i))) for i in ids]

    def of_b(text):
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]

    return of_a, of_b


def brute(rows, sides):
    """Whole texts through the libraries, groups by a walk over offsets, links one by one."""
    of_a, of_b = sides
    docs, holds = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(rows):
        want = (" " + text).encode() if text else b""
        a, b = (of_a(text), of_b(text)) if text else ([], [])
        groups = []
        if text and b"".join(x for _, x in a) == want and b"".join(x for _, x in b) == want:
            ends = [set(np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)]
            cuts = sorted(ends[0] & ends[1])
            for side, tokens in enumerate((a, b)):
                at, g = 0, 0
                for i, x in tokens:
                    at += len(x)
                    while len(groups) <= g:
                        groups.append(([], []))
                    groups[g][side].append(i)
                    g += at >= cuts[g]
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        for link in links:
            holds[link].add(k)
        docs.append((doc_id, groups, links))
    count = {p: len(d) for p, d in holds.items()}
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, groups, links in docs:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), hashlib.sha256(written.encode()).hexdigest() if groups else "", sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in A.aligned(df, A_PATH, B_PATH, **kw).collect()), key=key)


ODD = [None, "", " ", "   ", "\n", "a▁b", "<|endoftext|> <s> </s> <unk>", " x", "x ", "x  y", "x \n y\n", "a\r\nb\t c", "\x00\x1c \x1d", "　 \xa0 \x85x", "été ça va, l'été! it's they'll", "中文 テスト 😀👍🏽 é", "aaaa" * 50, "1234567890 12 3", "​ ﻿"]


def test_matches_the_libraries_over_whole_texts(spark, sides):
    rng = random.Random(5)
    words = ["the", "straße", "été", "naïve", "don't", "x=1;", "中文", "😀", "  ", "\n", "unbelievable", "http://a.b/c?d=e", "\t", "a▁", "Ω", "1999"]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(words[:13] + words[14:], k=rng.randint(1, 40)))) for i in range(60)]
    rows += [(7, "the the"), (7, "the the"), (None, "again été")]
    want = sorted(brute(rows, sides), key=key)
    assert run(spark, rows) == want
    assert run(spark, rows, block=50, most=3) == want  # many blocks and dictionaries


def test_long_texts_and_empty_tables(spark, sides):
    rng = random.Random(6)
    rows = [(1, "".join(rng.choices("abc é中", k=60_000))), (2, "ab" * 30_000), (3, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(5000)))]
    assert run(spark, rows) == sorted(brute(rows, sides), key=key)
    assert run(spark, []) == []


def test_union_find_gives_the_components_of_the_overlap_graph():
    rng = np.random.default_rng(7)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.choice(np.arange(1, n + 1), rng.integers(1, n + 1)), n)) for _ in range(2))
        ga, gb = A.components(a, b)
        cuts = np.intersect1d(a, b)
        assert ga.tolist() == np.searchsorted(cuts, a).tolist() and gb.tolist() == np.searchsorted(cuts, b).tolist()


def test_links_of_a_large_group_are_expanded_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 5, 3000), rng.integers(0, 7, 2000)
    ga, gb = np.sort(rng.integers(0, 3, 3000)), np.sort(rng.integers(0, 3, 2000))
    want = Counter()
    for g in range(3):
        for x, n in Counter(a[ga == g].tolist()).items():
            for y, m in Counter(b[gb == g].tolist()).items():
                want[(g // 2, x << 32 | y)] += n * m
    for at_once in (4, 1 << 21):
        monkeypatch.setattr(A, "LINKS_AT_ONCE", at_once)
        owner, pair, times = A.expanded(a, b, ga, gb, np.array([0, 0, 1]))
        assert dict(zip(zip(owner.tolist(), pair.tolist()), times.tolist())) == want
