import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone.functions.vectors import Metric
from lodestone.operators import exact, hybrid
from lodestone.operators import routing as R
from lodestone.operators.exact import knn, recall_at_k, recall_summary
from lodestone.operators.lists import ListIndex
from lodestone.plans.storage import saved
from lodestone.sources.vectors import generate_clustered
from oracle import connect, difference


def test_ten_thousand_centroids_are_routed_over_a_graph():
    rng = np.random.default_rng(1)
    c = np.concatenate([m + 0.3 * rng.normal(size=(100, 16)) for m in rng.uniform(-1, 1, (100, 16))])
    x = c[rng.integers(0, len(c), 300)] + 0.1 * rng.normal(size=(300, 16))
    graph = R.CentroidGraph(c)
    true = np.argsort(np.linalg.norm(x[:, None] - c[None], axis=2), 1)[:, :10]
    found, d = graph.route(x, 10, 8)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found.tolist(), true.tolist())]) >= 0.9
    assert (found[:, 0] == true[:, 0]).mean() >= 0.95 and (np.diff(d, axis=1) >= 0).all()
    read = np.mean([sum(len(graph.below[t]) for t in graph._near(row[None], graph.tops, 8)[0]) for row in x])
    assert len(graph.tops) <= 100 and read + len(graph.tops) < len(c) / 3
    everything, _ = graph.route(x, 10, len(graph.tops))
    assert everything.tolist() == true.tolist()


def test_few_centroids_ties_and_cosine():
    graph = R.CentroidGraph([[0.0, 1.0], [0.0, 1.0], [1.0, 0.0]], Metric.COSINE)
    best, d = graph.route(np.array([[0.0, 2.0], [3.0, 0.1]]), 5, 2)
    assert best[0].tolist() == [0, 1, 2] and best[1].tolist() == [2, 0, 1] and d[0, 0] == 0


def test_index_over_a_graph_of_centroids(spark, tmp_path):
    data = saved(generate_clustered(spark, 12, 12_000, 300, 0.2))
    queries = saved(generate_clustered(spark, 12, 60, 300, 0.2, first=1_000_000).withColumnRenamed("id", "query_id"))
    index = ListIndex.build(data, str(tmp_path / "v"), 600, 2, beam=3)
    assert len(index.centroids) == 600 and index.rows().count() == 12_000
    found = ListIndex.load(spark, index.path).search(queries, 10, 12)
    assert recall_summary(recall_at_k(found, knn(data, queries, 10), 10)).first().avg_recall >= 0.9


def test_terms_move_towards_each_batch(spark):
    terms = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 2.0), (3, "c", 1.0), (4, "a", 4.0), (9, "z", 1.0)], "id long, term string, weight double")
    where = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 1)], "id long, cluster_id int")
    one, two = (R.term_clusters(terms.where(F.col("id").isin(ids)), where) for ids in ([1, 2, 9], [3, 4]))
    first = R.learned_terms(None, one)
    tidy = lambda df: {(r.term, r.cluster_id): round(r.w, 9) for r in df.collect()}
    assert tidy(first) == {("a", 0): 0.5, ("a", 1): 0.5, ("b", 0): 1.0}
    after = R.learned_terms(first, two, 0.5)
    assert tidy(after) == {("a", 0): 0.25, ("a", 1): 0.75, ("b", 0): 1.0, ("c", 1): 1.0}
    both = R.merged_batches([one, two])
    assert {(r.term, r.cluster_id): (r.hits, r.mass) for r in both.collect()} == {(r.term, r.cluster_id): (r.hits, r.mass) for r in R.term_clusters(terms, where).collect()}
    asked = spark.createDataFrame([(7, "a", 1.0), (7, "nowhere", 5.0), (8, "nowhere", 1.0)], "query_id long, term string, qweight double")
    p = {(r.query_id, r.cluster_id): r.p for r in R.sparse_route(asked, after, 3).collect()}
    e = np.exp([0.25, 0.75, 0.0])
    assert all(abs(p[7, i] - e[i] / e.sum()) < 1e-12 and abs(p[8, i] - 1 / 3) < 1e-12 for i in range(3)) and len(p) == 6


def test_only_modalities_that_a_query_has_are_weighed(spark):
    part = lambda rows: spark.createDataFrame(rows, "query_id long, cluster_id int, p double")
    a, b = part([(1, 0, 0.9), (1, 1, 0.1), (2, 0, 0.5), (2, 1, 0.5)]), part([(1, 0, 0.2), (1, 1, 0.8), (3, 1, 1.0)])
    got = {(r.query_id, r.cluster_id): (round(r.p, 9), round(r.confidence, 9)) for r in R.fused([(a, 0.6), (b, 0.3)]).collect()}
    assert got == {(1, 0): (round(2 / 3, 9), round(2 / 3, 9)), (1, 1): (round(1 / 3, 9), round(2 / 3, 9)), (2, 0): (0.5, 0.5), (2, 1): (0.5, 0.5), (3, 1): (1.0, 1.0)}
    by_own = R.fused([(R.with_confidence(a), F.col("confidence")), (b, 0.3)])
    assert round(by_own.where("query_id = 1 and cluster_id = 0").first().p, 9) == round((0.9 * 0.9 + 0.3 * 0.2) / 1.2, 9)
    assert [(r.query_id, r.cluster_id) for r in R.best_clusters(a, 1).orderBy("query_id").collect()] == [(1, 0), (2, 0)]


@pytest.mark.parametrize("name", ["vortex_search", "sparse_route", "fused_route", "atlas_search", "apex_routed_search", "ensemble_learned_route", "atlas_hybrid"])
def test_matches_sql(spark, sf_dir, name):
    assert difference(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", ["edge_prune", "edge_prune_importance", "edge_prune_distance"])
def test_edge_strategies_match_sql(spark, sf_dir, name):
    assert difference(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.ORACLE_SQL[name]) == ""


def test_words_stay_in_their_documents_rows(spark, sf_dir):
    v, t = Q.vectors(spark, sf_dir), Q.terms(spark, sf_dir)
    q, each = Q.asked(v), Q.terms_beside_vectors(spark, sf_dir)
    near = exact.knn(v, q, 30).drop("rank")
    got = hybrid.ranked_with_terms(near, each, each.where("id % 50 = 0"), 10)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, Q.rounded(got).collect())) == sorted(map(tuple, Q.rounded(hybrid.dense_first(v, t, q, Q.asked_terms(t), 10)).collect()))
    assert {r.id for r in each.collect()} == {r.id for r in v.join(t, "id", "left_semi").collect()} | {r.id for r in each.where("size(terms) = 0").collect()}
    c, words = Q.trained(v), Q.spread_terms(each.where("id % 50 = 0"))
    tidy = lambda df: sorted((r.term, r.cluster_id, round(r.w, 9)) for r in df.join(words.select("term").distinct(), "term", "left_semi").collect())
    table = Q.learned_table(spark, sf_dir, c, each, words)
    assert tidy(table) == tidy(Q.learned_table(spark, sf_dir, c)) and table.join(words, "term", "left_anti").count() == 0
    assert difference(Q.QUERIES["atlas_search"](spark, sf_dir), connect(sf_dir), Q.ORACLE_SQL["atlas_search"]) == ""
