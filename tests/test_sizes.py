"""What has to stay small, or exact, as tables grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone.functions import vectors as V
from lodestone.operators import clustering, exact, graph, hashing, lists
from lodestone.operators.shortlist import _before, rounded_distances, shortlisted
from lodestone.sources import vectors as S
from oracle import connect, difference
from test_operators import asked, frame


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def tidy(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


def test_all_distances_of_any_number_of_queries(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(5, 4)), rng.normal(size=(1100, 4))
    data = frame(spark, list(enumerate(x)))
    books = clustering.pq_train(data, 2, 3, 0, x[:3].tolist())
    coded = {r.id: np.concatenate([books[s][c] for s, c in enumerate(r.codes)]) for r in clustering.pq_encode(data, books).collect()}
    got = {(r.query_id, r.id): r.distance for r in clustering.pq_distances(clustering.pq_encode(data, books), asked(spark, *q), books).collect()}
    assert len(got) == 5500 and all(abs(d - ((q[a] - coded[b]) ** 2).sum()) < 1e-9 for (a, b), d in got.items())


def test_places_in_the_rough_order_count_ties_by_id():
    rng = np.random.default_rng(3)
    d, ids = rng.integers(0, 6, 80).astype(float), rng.permutation(80)
    order = np.lexsort((ids, d))
    some = order[[0, 3, 20, 21, 22, 79]]
    assert _before(d, ids, d[some], ids[some]).tolist() == [0, 3, 20, 21, 22, 79]


def brute_shortlist(ids, x, y, q, small, k, most):
    out = []
    for i, (v, s) in enumerate(zip(q, small)):
        near = np.lexsort((ids, np.round(np.linalg.norm(y - s, axis=1), 9)))[:most]
        d = np.linalg.norm(x[near] - v, axis=1)
        out += [(i, n, int(ids[near[j]]), round(d[j], 9)) for n, j in enumerate(np.lexsort((ids[near], d))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [4_000_000, 30])
def test_shortlists_are_ranked_without_being_listed(spark, monkeypatch, cells):
    monkeypatch.setattr(exact, "BROADCAST_CELLS", cells)
    rng = np.random.default_rng(4)
    x, ids = np.round(rng.normal(size=(500, 3)), 1), rng.permutation(500)
    y = -x[:, :1]  # those that are near by the one are as often as not far by the other
    y[::2] = np.round(rng.normal(size=(250, 1)), 1)
    rows = spark.createDataFrame([(int(i), a.tolist(), b.tolist()) for i, a, b in zip(ids, x, y)], "id long, vector array<double>, small array<double>")
    q = rng.normal(size=(6, 3))
    queries = asked(spark, *q).withColumn("small", F.slice("vector", 1, 1))
    for most in (3, 40, 400, 1000):
        assert tidy(shortlisted(rows, queries, 5, most, rounded_distances)) == brute_shortlist(ids, x, y, q, q[:, :1], 5, most)


def test_searches_of_large_shortlists_list_none(spark, monkeypatch):
    def listed(*_, **__):
        raise AssertionError("the shortlist was listed")

    monkeypatch.setattr(graph, "knn", listed)
    monkeypatch.setattr(clustering, "knn", listed)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    data, queries = frame(spark, list(enumerate(x))), asked(spark, *x[:4])
    assert graph.nexus_rerank(data, queries, [[1.0, 0, 0, 0]], 3, share=0.8).count() == 12
    assert clustering.pq_rerank(data, queries, 3, 2, 8, 2, share=0.8).count() == 12
    found = hashing.seer_search(data, queries, [[1.0, 0, 0, 0], [0, 1.0, 0, 0]], [0.5, 0.5], 3, 0.8, 5, n_probes=4)
    assert found.count() == 12 and "zip_with" not in plan(found)


def test_a_recall_of_one_is_a_scan(spark):
    sf = "/root/testdata/sf0.1"
    assert difference(Q.QUERIES["universal_search"](spark, sf), connect(sf), Q.ORACLE_SQL["universal_search"]) == ""


def test_probes_in_order_send_only_the_best_of_each(spark):
    data, queries = S.generate_uniform(spark, 8, 400), S.generate_queries(spark, 8, 10)
    planes = S.rows(3, 8, 5, -1, 1, True)
    got = hashing.fusion_search(data, queries, planes, 5, 8, factor=1000.0)
    assert "zip_with" not in plan(got) and tidy(got) == tidy(exact.knn(data, queries, 5))


def test_fusion_search_leaves_out_no_bucket(spark):
    x = [(i, (3.0, 0.1)) for i in range(40)] + [(i, (0.1 * i, -0.1)) for i in range(40, 45)]  # copies in the query's own bucket, nearer ones in the next
    data, one = frame(spark, x), asked(spark, (4.2, 0.05))
    got = tidy(hashing.fusion_search(data, one, [[0.0, 1.0], [1.0, 0.0]], 3, 4))
    assert got == tidy(exact.knn(data, one, 3)) and {r[2] for r in got} <= set(range(40, 45))
    sf = "/root/testdata/sf0.001"
    assert tidy(Q.QUERIES["fusion_search"](spark, sf)) == tidy(Q.QUERIES["knn_batch"](spark, sf))
    for name in ("fusion_search", "fusion_search_four_probes"):
        assert difference(Q.QUERIES[name](spark, sf), connect(sf), Q.ORACLE_SQL[name]) == ""


def test_first_ids_of_buckets(spark):
    data, queries = S.generate_uniform(spark, 8, 400), S.generate_uniform(spark, 8, 400).where("id < 30").withColumnRenamed("id", "query_id")
    planes = S.rows(3, 8, 5, -1, 1, True)
    met = hashing.probes(queries, planes, 4).join(hashing.bucketed(data, planes), "bucket").where("id != query_id").select("query_id", "id", "probe").collect()
    want = sorted((q, i, n) for q in range(30) for n, (_, i) in enumerate(sorted((r.probe, r.id) for r in met if r.query_id == q)[:60], 1))
    got = hashing.lsh_neighbors(data, queries, planes, 4, 60)
    assert sorted(map(tuple, got.collect())) == want
    assert "windowspecdefinition(bucket" in plan(got)  # lists are cut before they meet the queries


def test_many_buckets_are_merged_as_they_come(spark):
    data, queries = S.generate_uniform(spark, 8, 900), S.generate_queries(spark, 8, 40)
    planes = S.rows(6, 8, 5, -1, 1, True)
    assert tidy(hashing.swift_search(data, queries, planes, 2, 64)) == tidy(exact.knn(data, queries, 2))
    some = lists._merged([exact._best(exact.Metric.EUCLIDEAN, np.arange(3), np.zeros((3, 1)), np.arange(4), np.arange(4.0)[:, None], 3)], 2)
    assert lists._last(some, np.array([2, 0, 7]), 2).tolist() == [1.0, 1.0, np.inf]


def test_a_join_of_all_with_all_copies_vectors_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_CELLS", 1)
    many = spark.range(40_000).select("id", F.array(F.col("id").cast("double")).alias("vector"))
    text = plan(exact.knn(many, many.withColumnRenamed("id", "query_id"), 2))
    assert "sequence(0, 7" in text  # each row goes to eight blocks of queries, not to forty


def test_parts_of_many_rows_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(900, 3)), 1)  # many ties
    x[100:400] = x[5]
    q, ids, scale = x[:150], rng.permutation(900), np.round(rng.uniform(1, 2, 900), 1)
    want = [exact._best(m, np.arange(150), q, ids, x + 3.0, 5, s).to_pylist() for m in exact.Metric for s in (None, scale)]
    monkeypatch.setattr(exact, "PART", 64)
    got = [exact._best(m, np.arange(150), q, ids, x + 3.0, 5, s).to_pylist() for m in exact.Metric for s in (None, scale)]
    assert [[(r["query_id"], r["id"], round(r["distance"], 9)) for r in t] for t in got] == [[(r["query_id"], r["id"], round(r["distance"], 9)) for r in t] for t in want]


def test_many_documents_make_larger_blocks_and_versions_of_one_are_joined(spark, tmp_path):
    from lodestone.operators.postings import PostingsIndex, _blocks

    docs = spark.range(40_000).select("id", F.array(F.lit("a"), F.concat(F.lit("w"), F.col("id") % 7)).alias("terms"), F.array(F.lit(1.0), F.lit(2.0)).alias("weights"))
    index = PostingsIndex.build(docs, str(tmp_path / "p"))
    assert index.n_blocks == 64  # not 80
    index = PostingsIndex.build(docs.where("id < 50"), str(tmp_path / "q")).delete(spark.range(5, 9)).upsert(docs.where("id in (3, 60)"))
    (block,) = (b for blocks in _blocks(iter(index.rows().toArrow().to_batches())) for b in blocks)
    assert sorted(block.ids.tolist()) == [*range(5), *range(9, 50), 60] and block.live.all() and (np.diff(block.ends, prepend=0) > 0).all()
