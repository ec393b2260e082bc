import numpy as np
from pyspark.sql import functions as F

from lodestone.operators.clustering import Router
from lodestone.operators.exact import knn, recall_at_k, recall_summary
from lodestone.operators.lists import ListIndex
from lodestone.plans.storage import saved
from lodestone.sources.vectors import generate_clustered, latest_version
from lodestone.streaming import adaptation as A
from lodestone.streaming import ingest


def test_moments_merge_in_any_order_and_tell_how_far_vectors_moved(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    frame = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    parts = [A.moments(frame(a)) for a in (x[:10], x[10:45], x[45:])]
    whole = A.moments(frame(x))
    for some in (parts, parts[::-1]):
        assert all(np.allclose(A.merged(some)[p], whole[p]) for p in range(3))
    far = np.sqrt(((x + 3 - x.mean(0)) ** 2).sum(1).mean() / ((x - x.mean(0)) ** 2).sum(1).mean())
    assert abs(A.moved(whole, A.moments(frame(x + 3))) - far) < 1e-9 and abs(A.moved(whole, whole) - 1) < 1e-9
    assert A.moved({0: (1, 2.0, 0.0)}, {0: (1, 2.0, 0.0)}) == 1.0 and A.moved({0: (1, 2.0, 0.0)}, {0: (1, 3.0, 0.0)}) == float("inf")


def test_a_shift_makes_new_lists_while_old_readers_go_on(spark, tmp_path):
    first = saved(generate_clustered(spark, 8, 3000, 40, 0.2))
    later = saved(generate_clustered(spark, 8, 3000, 40, 0.2, seed=9, first=100_000).withColumn("vector", F.transform("vector", lambda v: v + 6)))
    ask = lambda data: data.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    index = ListIndex.build(first, str(tmp_path / "i"), 50, 5)
    before = index.search(ask(first), 10, 5)
    truth = knn(first, ask(first), 10)
    recall = lambda found, true: recall_summary(recall_at_k(found, true, 10)).first().avg_recall
    assert recall(before, truth) >= 0.9
    heard = []
    for data in (first, later):
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
        q = A.following(stream, index.path, str(tmp_path / "c"), iterations=4, then=lambda n, s: heard.append((n, s)))
        assert q.awaitTermination(240)
    assert heard == [(0, False), (1, True)]
    now = ListIndex.load(spark, index.path)
    assert now.version == latest_version(spark, index.path) == 3 and now.segments == () and now.rows().count() == 6000
    both = first.unionByName(later)
    assert recall(now.search(ask(later), 10, 5), knn(both, ask(later), 10)) >= 0.9
    largest = lambda i: i.sizes().agg(F.max("n")).first()[0]
    assert largest(now) < largest(ListIndex.load(spark, index.path, 2)) / 2  # the version before the rebuild has the new vectors in a few lists
    assert recall(ListIndex.load(spark, index.path, 0).search(ask(first), 10, 5), truth) >= 0.9


def test_gradients_are_summed_by_the_tasks(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    router = Router.new(4, 3, 5)
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "vector array<double>, cluster_id int").repartition(4)
    found = ingest.gradients(rows, router).collect()
    assert len(found) == 4 and np.allclose(np.sum([r.gradient for r in found], 0), router.gradient(x, y))
    loss = lambda: -np.log(router.predict(x)[np.arange(90), y]).sum()
    old = loss()
    router.move(router.gradient(x, y), 0.001)
    assert loss() < old
