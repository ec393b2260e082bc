import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone.functions.vectors import Metric
from lodestone.operators import exact
from lodestone.operators.exact import knn, recall_at_k, recall_summary
from lodestone.operators.lists import ListIndex, probed
from lodestone.plans.storage import saved
from lodestone.sources.vectors import generate_clustered, latest_version
from oracle import connect, difference


@pytest.fixture(scope="module")
def clustered(spark):
    data = saved(generate_clustered(spark, 16, 20_000, 150, 0.2))
    return data, saved(generate_clustered(spark, 16, 100, 150, 0.2, first=1_000_000).withColumnRenamed("id", "query_id"))


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    return ListIndex.build(clustered[0], str(tmp_path_factory.mktemp("lists")), iterations=8)


def same(a, b):
    tidy = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    return tidy(a) == tidy(b)


def test_a_search_reads_few_lists_and_finds_nearly_all(spark, clustered, index):
    data, queries = clustered
    assert len(index.centroids) == 142
    found = ListIndex.load(spark, index.path).search(queries, 10, 10)
    assert recall_summary(recall_at_k(found, knn(data, queries, 10), 10)).first().avg_recall >= 0.9
    one = queries.where("query_id = 1000003")
    plan = index.search(one, 10, 10)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters: [isnotnull(cluster_id" in plan
    wanted = spark.createDataFrame([(i,) for i in range(40)], "cluster_id int").where("cluster_id < 10")
    rows = index.rows(wanted)
    n = rows.count()
    assert n == data.count() - index.rows().where("cluster_id >= 10").count() and n < data.count() / 3


def test_every_list_gives_the_exact_answer(spark, clustered, index):
    data, queries = clustered
    assert same(index.search(queries, 5, 142), knn(data, queries, 5))


def test_few_queries_and_many_take_different_ways_to_the_same_rows(spark, monkeypatch, clustered):
    data, queries = clustered
    data = data.limit(3000).withColumn("bucket", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7))  # one bucket has a third of all rows
    routes = queries.select("query_id", F.explode(F.array(F.lit(0), F.col("query_id") % 7, F.lit(99))).alias("bucket")).distinct()
    few = probed(data, routes, queries, 6).collect()
    monkeypatch.setattr(exact, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(exact, "SLICE", 100)
    monkeypatch.setattr(exact, "BLOCK", 30)
    many = probed(data, routes, queries, 6).collect()
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.distance, 9))
    assert sorted(map(key, few)) == sorted(map(key, many)) and len(few) == 600
    assert probed(data.limit(0), routes, queries, 6).count() == probed(data, routes.limit(0), queries, 6).count() == probed(data, routes, queries.limit(0), 6).count() == 0


def test_changes_in_any_order_equal_a_rebuild(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = {i: rng.normal(size=4).tolist() for i in range(200)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, vector array<double>")
    queries = frame({i: rng.normal(size=4).tolist() for i in range(10)}).withColumnRenamed("id", "query_id")
    index = ListIndex.build(frame(x), str(tmp_path / "i"), 9, 3)
    opened = []
    for step in range(7):
        if step % 3 == 2:
            gone = rng.choice(260, 60, replace=False).tolist()
            index = index.delete(spark.createDataFrame([(i,) for i in [*gone, gone[0], None]], "id long"))
            x = {i: v for i, v in x.items() if i not in gone}
        elif step == 4:
            index = index.compact(retrain=True, iterations=2)
        else:
            new = {int(i): rng.normal(size=4).tolist() for i in rng.choice(260, 50, replace=False)}
            index = index.upsert(frame(new))
            x |= new
        opened.append((index.version, dict(x)))
        index = ListIndex.load(spark, index.path)
        rebuilt = ListIndex.build(frame(x), str(tmp_path / f"r{step}"), centroids=index.centroids)
        assert same(index.search(queries, 5, 3), rebuilt.search(queries, 5, 3))
    version, then = opened[2]
    assert {r.id for r in ListIndex.load(spark, index.path, version).rows().collect()} == set(then)  # a reader keeps its version
    index = index.compact()
    index.forget_before()
    assert latest_version(spark, index.path) == index.version and same(index.search(queries, 5, 9), knn(frame(x), queries, 5))
    with pytest.raises(Exception, match="already exists"):
        ListIndex.load(spark, index.path)._described()


def test_cosine_and_empty_lists(spark, tmp_path):
    data = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(20)] + [(None, [1.0, 1.0]), (99, None)], "id long, vector array<double>")
    index = ListIndex.build(data, str(tmp_path / "c"), metric=Metric.COSINE, centroids=[[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    queries = spark.createDataFrame([(1, [1.0, 0.05])], "query_id long, vector array<double>")
    assert [r.id for r in index.search(queries, 3, 1).orderBy("rank").collect()] == [1, 0, 2]
    assert ListIndex.load(spark, index.path).metric is Metric.COSINE and {r.cluster_id for r in index.sizes().collect()} == {0, 1}
    with pytest.raises(ValueError):
        index.search(queries, 0)
    with pytest.raises(ValueError):
        latest_version(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("name", ["ivf_search", "index_changes", "swift_search"])
def test_matches_sql(spark, sf_dir, name):
    assert difference(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.ORACLE_SQL[name]) == ""
