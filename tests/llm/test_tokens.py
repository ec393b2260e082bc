import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from lodestone.llm import bpe, piecewise, simple8b, token_counts, token_files
from lodestone.plans.storage import fresh_path

SCHEMA = "doc_id long, text string, ids string, start int, shard int, row int"
ODD = [None, "", " ", "a  b", " x ", "\n\n", "don't stop", "é" * 300, "日本語 テキスト", "<|endoftext|> tail", "a\x1cb", "ΣΑΣ", "²½ ١٢", "😀 ok", "x" * 9000, " " * 9000 + "y"]


def texts(n=60):
    rng = random.Random(2)
    parts = ["alpha", "Beta,", "été.", " ", "\n", "12", "don't", "ß", "\t", "x.y", "日本", "!!!"]
    return ODD + [" ".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(n)]


def table(spark, values):
    return spark.createDataFrame([(i // 2 if i % 7 else None, t, "x", 1, 2, 3) for i, t in enumerate(values)], SCHEMA)


@pytest.mark.parametrize("chunk,overlap,spread", [(bpe.CHUNK, bpe.OVERLAP, bpe.SPREAD), (64, 16, 1), (50, 7, 3), (64, 20, 1000)])
def test_bpe_matches_tiktoken(spark, chunk, overlap, spread):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    df = table(spark, texts())
    got = bpe.encode_with(df, path, P.PATTERN, bpe.digest, bpe.DIGEST, chunk=chunk, overlap=overlap, spread=spread).collect()
    want = []
    for i, t in enumerate(texts()):
        ids = enc.encode_ordinary(t or "")
        want.append((i // 2 if i % 7 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (50, 9), (40, 20)])
def test_chunks_of_random_texts_meet(chunk, overlap):
    rng = random.Random(5)
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ids = bpe.Pieces(enc)
    parts = ["alpha", "Beta,", "'re", "'", "'r", "e", " ", "  ", "\n", "\n \n", "12", "don't", "ß", "\t", "日本", "!!!", " " * 40, "ab" * 30, "\u3000", "\x1c", "\u0558", "\U000323e7"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(200)))
        assert ids(t, bpe.pre_tokens(t, P.PATTERN, chunk, overlap)) == enc.encode_ordinary(t)


def test_long_runs_are_gone_through_a_few_times(monkeypatch):
    gone = []
    find = bpe.chunk_ends
    monkeypatch.setattr(bpe, "chunk_ends", lambda text, at, pattern: gone.append(len(text)) or find(text, at, pattern))
    for run in ("ab" * 2_500_000, " " * 5_000_000 + "x", "a 1" * 300_000):
        gone.clear()
        ends = bpe.pre_tokens(run, P.PATTERN)
        assert ends[-1] == len(run) and sum(gone) < 6 * len(run)


def test_pieces_forget(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 1000)
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ids = bpe.Pieces(enc)
    for t in texts():
        assert ids(t or "", bpe.pre_tokens(t or "", P.PATTERN)) == enc.encode_ordinary(t or "")
        assert ids.held <= 1000 and len(ids.seen) <= 5


def test_bpe_round_trip_and_empty(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    back = bpe.decode(bpe.encode(df, path, P.PATTERN, chunk=70, overlap=9), path, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == {i: t or "" for i, t in enumerate(texts())}
    assert bpe.encode(df.limit(0), path, P.PATTERN).collect() == []


@pytest.mark.parametrize("bits", [1, 7, 16, 31, 60, 64])
def test_simple8b_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 255, 256, 257, 5000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64)
        ids[rng.random(n) < 0.3] = 0
        words, offsets = simple8b.encode(ids)
        assert np.array_equal(simple8b.decode(words, offsets, n), ids)
        k = len(offsets) // 2
        if n > 600:  # a block can be read alone
            part = simple8b.decode(words[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]), 256)
            assert np.array_equal(part, ids[k * 256 : k * 256 + 256])


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PAGE_IDS", 500)
    path = P.path("byte_bpe_50k.json")
    tok = piecewise.tokenizer(path)
    df, out = table(spark, texts()), fresh_path(spark, "t")
    token_files.write_token_files(df, out, path)
    got = token_files.read_token_files(spark, out, token_files.crc32, "ids_crc32 long").orderBy("start").collect()
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts()]
    want = [(i // 2 if i % 7 else None, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in got))) == sorted(map(str, want))
    at, last = 0, -1
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id
    assert {tuple(r.ids) for r in token_files.read_token_files(spark, out).collect()} == {tuple(x) for x in ids}


def test_token_files_empty(spark):
    out = fresh_path(spark, "t")
    token_files.write_token_files(table(spark, ["a"]).limit(0), out, P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, out).collect() == []


@pytest.mark.parametrize("block,most,salted", [(token_counts.BLOCK, token_counts.DICTIONARY, token_counts.SALTED), (300, 40, 7), (1, 1, 1)])
def test_token_counts(spark, block, most, salted):
    path = P.path("word_bpe_49k.json")
    tok = piecewise.tokenizer(path)
    values = [*texts(), "a<|endoftext|>b<|startoftext|> <|ENDOFTEXT|> c\x1dd", "<|endoftext|>" * 3, "x" * 70_000]
    got = token_counts.token_counts(table(spark, values), path, limit=50, block=block, most=most, salted=salted).collect()
    want = []
    for i, t in enumerate(values):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i // 2 if i % 7 else None, len((t or "").encode()), n, n > 50))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.token_counts(table(spark, ["a"]).limit(0), path).collect() == []
    none = token_counts.token_counts(spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string"), path).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, False), (2, 1, 0, False)]


def test_pre_tokens_are_counted_once(spark):
    path = P.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, "one two two don't") for i in range(50)], "doc_id long, text string").repartition(3)
    blocks = token_counts.frequencies(docs, path, block=60).collect()
    assert [r.pre for r in blocks if r.pre] == [["one", "two", "don", "'t"]] * 3 and sum(len(r.doc_ids) for r in blocks) == 50
    assert len({r.dictionary for r in token_counts.frequencies(docs, path, block=60, most=4).collect()}) > 5


def test_piecewise_looks_each_part_up_once():
    class Counted(dict):
        n = 0

        def get(self, *a):
            Counted.n += 1
            return super().get(*a)

        def __getitem__(self, k):
            Counted.n += 1
            return super().__getitem__(k)

        def __contains__(self, k):
            Counted.n += 1
            return super().__contains__(k)

    path = P.path("byte_bpe_50k.json")
    ids, tok = piecewise.ByteLevelIds(path), piecewise.tokenizer(path)
    texts = ["One " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} Größe{i}, (x{i})." for i in range(300)), "", "  odd  ones\n here", "a b c"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for again in range(2):  # new parts, then known ones
        got, sizes = ids(texts)
        assert [x.tolist() for x in np.split(got, np.cumsum(sizes)[:-1])] == want
        ids.at = Counted(ids.at)
    ids(texts)
    assert Counted.n // 2 <= len(set(" ".join(texts).split(" "))) + len(texts)  # of two calls


def test_piecewise_forgets(monkeypatch):
    monkeypatch.setattr(piecewise, "KEPT", 5)
    ids = piecewise.ByteLevelIds(P.path("byte_bpe_50k.json"))
    values = [t or "" for t in texts()]
    for _ in range(2):
        flat, sizes = ids(values)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [ids.tok.encode(t, add_special_tokens=False).ids for t in values]
