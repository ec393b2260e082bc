import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.vectors import Metric
from lodestone.operators import clustering, exact, graph, hashing, hybrid, state
from lodestone.plans.storage import fresh_path
from lodestone.sources import vectors as S
from lodestone.streaming import ingest


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<double>")


def asked(spark, *vs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "query_id long, vector array<double>")


def ids(df):
    return [r.id for r in df.orderBy("query_id", "rank").collect()]


def test_exact_ties_limits_and_errors(spark):
    data = frame(spark, [(0, (0, 0)), (1, (1, 0)), (2, (0, 1)), (3, (1, 0))])
    assert ids(exact.knn(data, asked(spark, (0, 0)), 3)) == [0, 1, 2]
    assert len(ids(exact.knn(data, asked(spark, (0, 0)), 99))) == 4
    assert exact.knn(data.limit(0), asked(spark, (0, 0)), 3).count() == 0
    with pytest.raises(ValueError):
        exact.knn(data, asked(spark, (0, 0)), 0)
    with pytest.raises(Exception, match="dimension"):
        exact.knn(data, asked(spark, (0, 0, 0)), 1).collect()
    with pytest.raises(Exception, match="zero vector"):
        exact.knn(data, asked(spark, (1, 0)), 1, Metric.COSINE).collect()
    same = frame(spark, [(i, (1, 1)) for i in range(200)])
    assert ids(exact.knn(same, asked(spark, (0, 0)), 5)) == [0, 1, 2, 3, 4]


def test_grid_of_blocks_gives_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data, q = frame(spark, list(enumerate(rng.normal(size=(300, 4))))), asked(spark, *rng.normal(size=(30, 4)))
    want = [tuple(r) for r in exact.knn(data, q, 4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(exact, "BROADCAST_CELLS", 1)
    monkeypatch.setattr(exact, "SLICE", 70)
    monkeypatch.setattr(exact, "BLOCK", 8)
    assert [tuple(r) for r in exact.knn(data, q, 4).orderBy("query_id", "rank").collect()] == want


def test_kernels(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(V.l2(V.literal([0, 0]), V.literal([3, 4]))) == 5
    assert get(V.cosine_distance(V.literal([1, 0]), V.literal([0, 1]))) == 1
    assert get(V.cosine_similarity_safe(V.literal([0, 0]), V.literal([0, 1]))) == 0
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    assert get(V.sparse_dot(m({"1": 1.0, "2": 2.0}), m({"1": 1.0, "3": 3.0}))) == 1
    assert get(V.sparse_norm(m({"1": 3.0, "2": 4.0}))) == 5
    assert get(V.sparse_distance(m({"1": 3.0}), m({"2": 4.0}))) == 1
    assert get(V.entropy(V.literal([1, 1, 1, 1]))) > get(V.entropy(V.literal([0.1, 0.5, 2, 5])))
    assert get(V.decay_half_life(F.lit(0.5), F.lit(0))) == 0.5 and abs(get(V.decay_half_life(F.lit(0.5), F.lit(172800))) - 0.875) < 1e-12
    assert abs(sum(get(V.softmax(V.literal([1, 2, 3])))) - 1) < 1e-12
    assert V.probe_masks(4, 3) == [0, 1, 2] and V.probe_masks(3, 9) == [0, 1, 2, 4, 3, 5, 6, 7] and V.parse_metric("L2") is Metric.EUCLIDEAN
    with pytest.raises(ValueError):
        V.parse_metric("manhattan")


def test_clusters_and_quantiser(spark):
    data = frame(spark, [(0, (0, 0)), (1, (0.1, 0.1)), (2, (10, 10)), (3, (10.1, 10.1))])
    index = clustering.IvfIndex.build(data, 2, start=[[0.0, 0.0], [10.0, 10.0]])
    assert sorted(ids(index.search(asked(spark, (0, 0)), 2, 1))) == [0, 1]
    assert sorted(r.n for r in index.sizes().collect()) == [2, 2]
    with pytest.raises(ValueError, match="divisible"):
        clustering.pq_train(frame(spark, [(0, range(10))]), 8)
    with pytest.raises(exact.EmptyIndexError):
        clustering.first_rows(data.limit(0), 2)
    books = clustering.pq_train(data, 2, 4, 5)
    assert ids(clustering.pq_search(clustering.pq_encode(data, books), asked(spark, (0, 0)), books, 1)) == [0]
    router = clustering.Router.new(64, 10)
    x, y = np.ones((1, 64)), np.array([3])
    before = router.predict(x)[0, 3]
    for _ in range(10):
        router.step(x, y)
    assert router.predict(x)[0, 3] > before and abs(router.predict(x).sum() - 1) < 1e-9


def test_hashing_finds_itself(spark):
    data = frame(spark, [(i, (i % 10 - 4.5, i // 10 - 4.5)) for i in range(100)])
    planes = S.rows(3, 2, 1, unit_length=True)
    assert ids(hashing.swift_search(data, asked(spark, (0.5, 0.5)), planes, 1)) == [55]
    assert ids(hashing.fusion_search(data, asked(spark, (0.5, 0.5)), planes, 1)) == [55]


def test_graph_rules(spark):
    p = graph.zenith_params(64, 10)
    assert (p["m"], p["ef_construction"], p["ef"]) == (12, 192, 100) and graph.zenith_params(10000, 100)["m"] == 48 and graph.zenith_params(64, 1)["ef"] == 72
    data = frame(spark, [(i, (i, math.sqrt(i))) for i in range(40)])
    e = graph.knn_graph(data, 6)
    assert e.count() == 240 and e.where("src = dst").count() == 0
    assert graph.rng_prune(e, data, 4).groupBy("src").count().where("count > 4").count() == 0


def test_hybrid_weights(spark):
    data = frame(spark, [(0, (0, 0)), (1, (10, 10))])
    terms = spark.createDataFrame([(1, t, 2.0) for t in "abc"] + [(0, "a", 0.1)], "id long, term string, weight double")
    q = spark.createDataFrame([(0, t, 1.0) for t in "abc"], "query_id long, term string, qweight double")
    for w, first in ((0.9, 0), (0.1, 1)):
        assert ids(hybrid.hybrid_search(data, terms, asked(spark, (0, 0)), q, 1, w)) == [first]


def test_changes_and_tuning(spark):
    data = frame(spark, [(0, (0, 0)), (1, (1, 0))])
    left, found = state.delete(data, spark.createDataFrame([(0,)], "id long"))
    assert found and left.count() == 1 and not state.delete(left, spark.createDataFrame([(9,)], "id long"))[1]
    new, found = state.update(data, frame(spark, [(1, (5, 5)), (7, (9, 9))]))
    assert found and {r.id: r.vector[0] for r in new.collect()} == {0: 0.0, 1: 5.0}
    assert state.upsert(data, frame(spark, [(7, (9, 9))])).count() == 3
    budget = state.EnergyBudget(10)
    assert budget.spend("FP32", 10) and not budget.spend("INT8") and budget.remaining == 0
    tuner = state.EfTuner()
    assert tuner.ef("dense") == 105 and tuner.record("dense", 0.5) == 115 and tuner.record("dense", 0.99) == 110
    assert state.AdaptiveLsh().probes() == 10 and state.adapt_threshold(0.95, False) == 1.0
    with pytest.raises(ValueError):
        state.preset("fast", ef=0)
    cache = state.ResultCache(9)
    for i in range(5):
        cache.put(i, data)
    assert cache.get(0) is None and cache.get(4) is data


def test_sources(spark):
    a, b = (S.generate_uniform(spark, 4, 50).repartition(n).orderBy("id").collect() for n in (1, 7))
    assert a == b and all(-1 <= x < 1 for r in a for x in r.vector) and a[3].vector[2] == pytest.approx(-1 + 2 * S.unit(3, 2, 42))
    path = fresh_path(spark, "index")
    S.save_index({"vectors": S.generate_uniform(spark, 4, 5)}, {"metric": "euclidean"}, path)
    tables, meta = S.load_index(spark, path)
    assert meta == {"metric": "euclidean"} and tables["vectors"].count() == 5
    S.export_testdata(S.generate_uniform(spark, 2, 3), S.generate_queries(spark, 2, 2), path + "-x", {"seed": 42})
    assert spark.read.json(path + "-x/dataset").count() == 3
    assert S.scenario("smoke", published=True).points == 1000 and json.loads(S.report(S.scenario("smoke"), 1, 0, {}))["timings"]["queries_per_second"] == float("inf")


def test_streaming(spark, tmp_path):
    S.generate_uniform(spark, 4, 64).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, vector array<double>").parquet(str(tmp_path / "in"))
    router, seen = clustering.Router.new(4, 2, 8), []
    before = router.w2.copy()
    ingest.train_router(stream, router, [[0.5] * 4, [-0.5] * 4], str(tmp_path / "ck"), then=seen.append).awaitTermination(120)
    assert seen and not np.allclose(before, router.w2)


def test_updates_with_repeated_ids_keep_one_row(spark):
    data, new = frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])]), frame(spark, [(1, [5.0, 5.0]), (1, [4.0, 9.0]), (3, [2.0, 2.0])])
    out, any_ = state.update(data, new)
    assert any_ and sorted((r.id, list(r.vector)) for r in out.collect()) == [(1, [4.0, 9.0]), (2, [1.0, 1.0])]


def test_presets_and_scenarios_hold_the_published_values():
    assert state.preset("high_recall")["n_probes"] == 12 and state.preset("high_recall")["m"] == 24 and state.preset("high_speed")["ef"] == 30
    assert S.scenario("smoke").dim == 64 and S.scenario("smoke", published=True).dim == 32


def test_streams_of_counts_and_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 3, float(m)) for m in range(0, 60, 5)] + [("2024-01-01 02:00:00", 1, 7.0)]
    spark.createDataFrame(rows, "ts string, bucket int, value double").selectExpr("cast(ts as timestamp) ts", "bucket", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, bucket int, value double").parquet(str(tmp_path / "in"))
    for name, out, mode in (("counts", ingest.running_counts(stream), "complete"), ("means", ingest.windowed_means(stream), "append")):
        out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.bucket: r.n for r in spark.table("counts").collect()} == {0: 4, 1: 5, 2: 4}
    assert [(r.mean, r.n) for r in spark.table("means").collect()][:1] == [(27.5, 12)]


def test_query_keys_agree_on_near_vectors(spark):
    df = spark.createDataFrame([([0.1234561, -3.0] + [0.5] * 10,), ([0.1234569, -9.0] + [0.5] * 6 + [1.0] * 4,), ([0.2, -3.0] + [0.5] * 10,)], "vector array<double>")
    a, b, c = [r.k for r in df.select(state.query_key(F.col("vector")).alias("k")).collect()]
    assert a == b != c


def test_plus_plus_spreads_its_centres(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.1 + 20 * i for i in range(4)])
    picked = np.array(clustering.plus_plus(frame(spark, list(enumerate(x))), 4))
    assert sorted(np.round(picked.mean(1) / 20).astype(int).tolist()) == [0, 1, 2, 3]
    index = clustering.IvfIndex.build(frame(spark, list(enumerate(x))), 4, 5)
    assert sorted(r.n for r in index.sizes().collect()) == [60] * 4
