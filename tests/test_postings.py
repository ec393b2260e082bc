import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone.operators import exact, hybrid, postings
from lodestone.operators.postings import PostingsIndex, doc_terms
from oracle import connect, difference


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of which every one has one common word, some without a vector or words; vectors without a document."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = [(i, "the the " + " ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.randint(0, 30)))) for i in range(400)]
    texts += [(400, None), (401, "  x y "), (None, "the"), (402, "rare")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rng_ = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng_.normal(size=5).tolist()) for i in range(420) if i % 7], "id long, vector array<double>")
    asked = spark.createDataFrame([(q, w, float(rng.randint(1, 3))) for q in range(12) for w in {"the", *rng.sample(words, 5)}] + [(20, "nowhere", 1.0), (21, "rare", 1.0)], "query_id long, term string, qweight double")
    queries = vectors.where("id in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 20)").withColumnRenamed("id", "query_id").unionByName(vectors.where("id = 1").select(F.lit(21).cast("long").alias("query_id"), "vector"))
    return docs, vectors, asked, queries


def tidy(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


def brute_sparse(docs, asked, k, gone=()):
    weights = {}
    for r in asked.collect():
        weights.setdefault(r.query_id, {})[r.term] = r.qweight
    out = []
    for q, w in weights.items():
        found = []
        for r in docs.collect():
            if r.id is not None and r.id not in gone:
                dot = sum(w[t] * x for t, x in zip(r.terms, r.weights) if t in w)
                if dot:
                    found.append((-dot, r.id))
        out += [(q, n, i, d) for n, (d, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_sparse_search_scores_only_what_can_be_among_the_best(spark, corpus, tmp_path):
    docs, _, asked, _ = corpus
    index = PostingsIndex.build(doc_terms(docs), str(tmp_path / "p"), block=20)
    count = spark.sparkContext.accumulator(0)
    want = brute_sparse(doc_terms(docs), asked, 5)
    assert tidy(index.sparse(asked, 5, count)) == want
    assert 0 < count.value < 0.6 * 12 * 400  # all but a few documents share a word with each query
    assert tidy(PostingsIndex.load(spark, index.path).sparse(asked, 1000)) == brute_sparse(doc_terms(docs), asked, 1000)


def test_hybrid_search_gives_the_rows_of_the_plain_joins(spark, corpus, tmp_path, monkeypatch):
    docs, vectors, asked, queries = corpus
    terms = hybrid.term_weights(docs).where("id is not null")
    index = PostingsIndex.build(doc_terms(docs), str(tmp_path / "h"), vectors, block=30)
    want = tidy(hybrid.hybrid_search(vectors, terms, queries, asked, 7))
    assert {r[0] for r in want} == {1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 20, 21} and len(want) == 11 * 7 + 1
    assert tidy(index.hybrid(queries, asked, 7)) == want
    monkeypatch.setattr(exact, "BROADCAST_CELLS", 40)  # several blocks of queries
    assert tidy(index.hybrid(queries, asked, 7)) == want


def test_changes_equal_a_rebuild(spark, corpus, tmp_path):
    docs, vectors, asked, queries = corpus
    first = doc_terms(docs)
    index = PostingsIndex.build(first, str(tmp_path / "c"), vectors, block=50)
    index = index.delete(spark.createDataFrame([(i,) for i in (1, 5, 9, 9999, None)], "id long"))
    new = first.where("id % 10 = 0").withColumn("id", F.col("id") + 5)
    moved = vectors.where("id % 10 = 1").withColumns({"id": F.col("id") + 4, "vector": F.transform("vector", lambda x: -x)})
    index = index.upsert(new, moved).delete(spark.createDataFrame([(15,), (16,)], "id long"))
    index = PostingsIndex.load(spark, index.path)
    ids = {r.id for r in new.select("id").collect()} | {r.id for r in moved.select("id").collect()}
    out = F.col("id").isin([1, 5, 9, *ids])
    live_docs = first.where(~out).unionByName(new).where("id not in (15, 16)")
    live_vectors = vectors.where(~out).unionByName(moved).where("id not in (15, 16)")
    again = PostingsIndex.build(live_docs, str(tmp_path / "r"), live_vectors, block=50)
    for found in (index, index.compact()):
        assert tidy(found.sparse(asked, 9)) == tidy(again.sparse(asked, 9)) and tidy(found.hybrid(queries, asked, 9)) == tidy(again.hybrid(queries, asked, 9))
    assert PostingsIndex.load(spark, index.path).segments == (4,)


def test_empty_tables(spark, corpus, tmp_path):
    docs, vectors, asked, queries = corpus
    empty = PostingsIndex.build(doc_terms(docs.limit(0)), str(tmp_path / "e"))
    assert empty.sparse(asked, 3).collect() == [] and empty.hybrid(queries, asked, 3).collect() == []
    index = PostingsIndex.build(doc_terms(docs), str(tmp_path / "n"))
    assert index.sparse(asked.limit(0), 3).collect() == [] and index.hybrid(queries.limit(0), asked, 3).collect() == []
    with pytest.raises(ValueError):
        index.sparse(asked, 0)


@pytest.mark.parametrize("name", ["hybrid_search", "sparse_search", "postings_changes"])
def test_matches_sql(spark, sf_dir, name):
    assert difference(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.ORACLE_SQL[name]) == ""


def test_products_of_all_that_share_a_word_need_no_shuffle(spark, corpus, monkeypatch):
    docs, _, asked, _ = corpus
    monkeypatch.setattr(postings, "MET", 300)
    monkeypatch.setattr(exact, "BROADCAST_CELLS", 40)  # several blocks of queries
    mixed = asked.withColumn("qweight", F.when(F.col("term") == "w3", 0.0).otherwise(F.col("qweight")))
    for of in (asked, mixed):
        got = postings.products(doc_terms(docs, named=False), of)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = hybrid.sparse_products(hybrid.term_weights(docs), of)
        assert sorted(map(str, got.select("query_id", "id", "dot").collect())) == sorted(map(str, want.collect()))
    again = docs.where("doc_id < 9").unionByName(docs.where("doc_id < 9").selectExpr("doc_id", "concat('rare ', text) AS text"))
    split = lambda df: sorted((r.id, *p) for r in df.collect() for p in zip(r.terms, r.weights))
    assert split(doc_terms(postings.merged_texts(again))) == sorted(map(tuple, hybrid.term_weights(again).collect()))


@pytest.mark.parametrize("most", [100_000, 1])
def test_texts_are_shuffled_only_where_an_id_repeats(spark, corpus, monkeypatch, most):
    docs, _, asked, _ = corpus
    alone = postings.merged_texts(docs)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in postings.products(doc_terms(alone, named=False), asked)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(postings, "REPEATED", most)
    again = docs.unionByName(docs.where("doc_id is null or doc_id < 3 or doc_id > 399").selectExpr("doc_id", "concat('rare ', text) AS text"))
    split = lambda df: sorted((str(r.id), *p) for r in df.collect() for p in zip(r.terms, r.weights))
    assert split(doc_terms(postings.merged_texts(again), named=False)) == sorted((str(r.id), r.term, r.weight) for r in hybrid.term_weights(again).collect())


def test_words_are_held_once_and_counted_a_few_texts_at_a_time():
    texts = pa.record_batch([pa.array(range(1000)), pa.array([f"a b{i} a" for i in range(1000)])], ["id", "text"])
    parts = list(postings._counted(iter([texts])))
    assert max(p.num_rows for p in parts) <= postings.TEXTS and sum(p.num_rows for p in parts) == 1000
    assert parts[-1].to_pylist()[-1] == {"id": 999, "terms": ["a", "b999"], "weights": [2.0, 1.0]}
    words = [f"word number {i}" for i in range(50)]
    table = pa.table({"query_id": pa.array(range(2000)), "terms": pa.array([words] * 1999 + [None]), "qweights": pa.array([[1.0] * 50] * 1999 + [None])})
    asked = postings.Asked.of(table)
    assert len(asked.words) == 50 and len(pickle.dumps(asked)) < 13 * 50 * 2000  # a code and a weight for each
    block = postings.Block(np.arange(2), np.ones(2, bool), np.zeros((2, 0)), {"other": 0, words[7]: 1}, np.array([1, 2]), np.array([0, 1]), np.ones(2), np.ones(2))
    met = list(asked.met(block))
    assert [m[0] for m in met] == list(range(2000)) and met[3][1].tolist() == [1] and met[3][2].tolist() == [1.0] and met[-1][1].tolist() == []
