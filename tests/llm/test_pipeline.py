import public_tokenizers as P

import corpus_pipeline
from lodestone.llm import bpe, toxicity
from lodestone.llm.simhash import simhash_groups


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "bpe_encoding"]
    outs, now = [], docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        outs.append(now)
    for out in outs[:-1]:
        assert out.columns == docs.columns
    clean, single, blotted, mixed, encoded = (o.collect() for o in outs)
    assert 0 < len(clean) <= docs.count()
    groups = simhash_groups(outs[0]).collect()
    assert sorted(r.doc_id for r in single) == sorted({r.component_id for r in groups})
    assert sorted(r.doc_id for r in blotted) == sorted(r.doc_id for r in single)
    assert all(r.n_chars == len(r.text) for r in blotted)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in blotted}
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in mixed)
    assert sorted((r.doc_id, list(r.ids)) for r in encoded) == want


def write(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_rows_without_values(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows: exact rows after each stage."""
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    secret = "x token=abcdefgh12 y"
    rows = [(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "src1", 0), (3, words("a"), None, "odd", 3), (3, words("a"), None, "odd", 3), (4, words("b"), "en", None, None), (5, secret, "de", "src2", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sf = write(spark, tmp_path, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, sf).collect(), docs.schema) if name != "bpe_encoding" else stage(spark, now, sf)
        counts.append(sorted(((r[0], r[1] if name != "bpe_encoding" else list(r.ids)) for r in now.collect()), key=str))
    plain = sorted(((r[0], r[1]) for r in rows), key=str)
    assert counts[0] == plain  # no labels: nothing is toxic
    kept = [(1, None), (3, words("a")), (4, words("b")), (5, secret)]
    assert counts[1] == sorted(kept, key=str)
    blotted = [(1, None), (3, words("a")), (4, words("b")), (5, "x [secret] y")]
    assert counts[2] == sorted(blotted, key=str)
    assert {r for r in counts[3]} <= {*blotted} and (1, None) in counts[3]
    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert counts[4] == sorted(((i, enc.encode_ordinary(t or "")) for i, t in counts[3]), key=str)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    sf = write(spark, tmp_path, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_further_columns_stay(spark, tmp_path):
    clash = ["key", "_key", "row", "base", "spans", "runs", "epoch", "domain", "level0", "c0", "tokens", "order", "bucket", "full", "fp", "component_id", "score"]
    docs = spark.createDataFrame([(i, f"text number {i} " * 5, "en", f"src{i}", 9, *range(len(clash))) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash))
    sf = write(spark, tmp_path, docs, spark.createDataFrame([(i, 0, i % 2) for i in range(6)], "doc_id long, quality int, toxic int"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        assert {tuple(r)[5:] for r in now.collect()} == {tuple(range(len(clash)))}


def test_near_dedup_of_null_and_repeated_ids(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(None, words("a")), (None, words("a")), (7, words("a")), (None, words("b")), (None, words("b")), (8, words("c")), (8, words("d")), (8, words("e")), (9, words("e"))]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], schema)
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = [(7, words("a")), (None, words("b")), (8, words("c")), (8, words("d")), (8, words("e"))]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
