import numpy as np
import pytest

from lodestone import queries as Q
from lodestone.operators import clustering, exact, graph, hybrid
from lodestone.sources import vectors as S
from test_operators import asked, frame


def read(spark, sf_dir):
    rows = Q.vectors(spark, sf_dir).orderBy("id").collect()
    return np.array([r.id for r in rows]), np.array([r.vector for r in rows])


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


def recall(found, truth):
    return np.mean([len(set(found.get(q, [])) & set(t)) / len(t) for q, t in truth.items()])


def nearest(ids, x, scale=1.0, k=10):
    return {q: ids[np.lexsort((ids, np.linalg.norm(x - v, axis=1) * scale))][:k].tolist() for q, v in zip(ids.tolist(), x) if q % 50 == 0}


def test_decay_comes_before_the_cut(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    data = frame(spark, list(enumerate(x))).selectExpr("id", "vector", "-id * 3600 AS ts")
    queries = asked(spark, *x[:20])
    ages = np.arange(300) / 24
    truth = {q: np.lexsort((np.arange(300), np.linalg.norm(x - x[q], axis=1) * (2 - 2.0**-ages)))[:5].tolist() for q in range(20)}
    assert lists(hybrid.decayed_knn(data, queries, 5, 0)) == truth
    for name, value in (("BROADCAST_CELLS", 1), ("SLICE", 70), ("BLOCK", 8)):
        monkeypatch.setattr(exact, name, value)
    assert lists(hybrid.decayed_knn(data, queries, 5, 0)) == truth


def test_convergence_search_matches_brute_force(spark, sf_dir):
    ids, x = read(spark, sf_dir)
    factor = np.where(ids <= 0, 1.0, 2 - 2.0 ** (-ids / 24))
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(far, np.inf)
    ends = np.argsort(far, 1, kind="stable")[:, :2]
    lengths = np.take_along_axis(far, ends, 1)
    links = {}
    for i, (js, ds) in enumerate(zip(ends, lengths)):
        for j, d in zip(js.tolist(), ds):
            if d / max(1.0, lengths.max()) <= 0.9:
                for a, b in ((i, j), (j, i)):
                    links.setdefault(a, []).append((b, d * factor[i]))
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        d = np.linalg.norm(x - x[q], axis=1) * factor
        seeds = np.lexsort((ids, d))[:10].tolist()
        new = {}
        for a in seeds:
            for b, e in links.get(a, []):
                if b not in seeds:
                    new[b] = min(e, new.get(b, np.inf))
        every = {s: d[s] for s in seeds} | new
        want[int(ids[q])] = [int(ids[i]) for i in sorted(every, key=lambda i: (every[i], ids[i]))[:10]]
    got = lists(Q.QUERIES["convergence_search"](spark, sf_dir))
    assert got == want and recall(got, nearest(ids, x, factor)) >= 0.85


def test_trained_codes_and_exact_ranking_find_the_nearest(spark):
    ids, x = read(spark, "/root/testdata/sf0.1")
    assert recall(lists(Q.QUERIES["pq_rerank"](spark, "/root/testdata/sf0.1")), nearest(ids, x)) >= 0.9


@pytest.mark.parametrize("name", ["pq_search", "nexus_rerank", "seer_search", "bucket_topk_merge"])
@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_shortlists_hold_the_nearest(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    ids, x = read(spark, folder)
    assert recall(lists(Q.QUERIES[name](spark, folder)), nearest(ids, x)) >= 0.9


def test_decoded_codes_give_the_asymmetric_distances(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    data, q = frame(spark, list(enumerate(x))), asked(spark, *x[:4])
    books = clustering.pq_train(data, 2, 6, 5)
    codes = clustering.pq_encode(data, books)
    key = lambda df: {(r.query_id, r.id): round(r.distance, 9) for r in df.collect()}
    assert key(exact.knn(clustering.pq_decode(codes, books), q, 60)) == key(clustering.pq_search(codes, q, books, 60))


def test_quantiser_is_fitted_on_a_sample_of_all_ids(spark):
    data = frame(spark, [(i, (1.0, 1.0) if i < 50 else (9.0, 9.0)) for i in range(100)])
    words = {round(w[0]) for w in clustering.pq_train(data, 2, 8, 3, sample=30)[0]}
    assert words == {1, 9}


def test_router_sees_all_ids(spark):
    data = frame(spark, [(i, (1.0, 0.0) if i < 100 else (0.0, 1.0)) for i in range(200)]).selectExpr("id", "vector", "CAST(id >= 100 AS INT) AS cluster_id")
    router = clustering.Router.new(2, 2, 8).fit(data, epochs=20, sample=60, rate=0.05, batch=8)
    assert router.predict(np.array([[1.0, 0.0], [0.0, 1.0]])).argmax(1).tolist() == [0, 1]


def test_graph_walks_reach_the_neighbours(spark, sf_dir):
    ids, x = read(spark, sf_dir)
    truth = nearest(ids, x)
    for name in ("hnsw_search", "zenith_search"):
        assert recall(lists(Q.QUERIES[name](spark, sf_dir)), truth) >= 0.9, name


def test_graph_index_is_saved_and_searched(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    data, queries = frame(spark, list(enumerate(x))), asked(spark, *x[:8])
    graph.GraphIndex.build(data, 8, upper=40).save(str(tmp_path / "g"))
    index = graph.GraphIndex.load(spark, str(tmp_path / "g"))
    assert 0 < index.upper.count() <= 40
    found = lists(index.search(queries, 5, ef=40))
    truth = {q: np.argsort(np.linalg.norm(x - x[q], axis=1), kind="stable")[:5].tolist() for q in range(8)}
    assert recall(found, truth) >= 0.9
    one = frame(spark, [(7, x[0])])
    assert lists(graph.GraphIndex.build(one, 4).search(queries, 5)) == {q: [7] for q in range(8)}


def test_walks_on_a_chain_follow_the_edges(spark):
    data = frame(spark, [(i, [float(i), 0.0]) for i in range(30)])
    edges = spark.createDataFrame([(i, i + 1) for i in range(29)], "src long, dst long")
    queries = asked(spark, [29.0, 0.0])
    starts = spark.createDataFrame([(0, 0)], "query_id long, id long")
    assert lists(graph.walk(data, edges, queries, starts, 2, 3, rounds=40)) == {0: [29, 28]}
    assert lists(graph.walk(data, edges, queries, starts, 1, 3, rounds=4)) == {0: [4]}


def test_tiers(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1200, 8))
    for n in (300, 1200):
        data, queries = frame(spark, list(enumerate(x[:n]))), asked(spark, *x[:10])
        truth = {q: np.argsort(np.linalg.norm(x[:n] - x[q], axis=1), kind="stable")[:10].tolist() for q in range(10)}
        got = recall(lists(graph.tiered_search(data, queries, 10)), truth)
        assert got == 1.0 if n == 300 else got >= 0.9


def test_generated_vectors_lie_on_no_curve(spark):
    x = np.array(S.rows(400, 64, 42))
    apart = np.linalg.norm(x[:, None] - x[None], axis=2)[np.triu_indices(400, 1)]
    assert apart.min() > 4  # independent components give about 6.5; on a curve, neighbours are far nearer
    assert np.array_equal(x, [r.vector for r in S.generate_uniform(spark, 64, 400).orderBy("id").collect()])


def test_a_walk_finds_neighbours_among_generated_vectors(spark):
    data, queries = S.generate_uniform(spark, 16, 1500), S.generate_queries(spark, 16, 20)
    index = graph.GraphIndex.build(data, 16, upper=64)
    assert recall(lists(index.search(queries, 10, 60)), lists(exact.knn(data, queries, 10))) >= 0.95
