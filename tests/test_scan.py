import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as Q
from lodestone.operators import exact, hybrid, scan
from lodestone.operators.exact import recall_at_k, recall_summary
from lodestone.plans.storage import saved
from lodestone.sources.vectors import generate_clustered, unit_column
from oracle import connect, difference

MODAL = "id long, dense array<double>, sparse map<string,double>, audio array<double>"


def tidy(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())


def test_dense_and_sparse_matches_come_first(spark):
    data = spark.createDataFrame([(0, [1.0, 2.0, 3.0], {"0": 0.5, "5": 0.8}, None), (1, [10.0, 20.0, 30.0], {"10": 0.9}, None)], MODAL)
    query = spark.createDataFrame([(7, [1.0, 2.0, 3.0], {"0": 0.5, "5": 0.8}, None)], MODAL.replace("id long", "query_id long"))
    found = scan.multimodal_scan(data, query, 2, (0.6, 0.3, 0.1)).orderBy("rank").collect()
    assert [r.id for r in found] == [0, 1] and abs(found[0].distance) < 1e-9


def test_every_pattern_of_absent_modalities(spark, monkeypatch):
    rng = np.random.default_rng(1)
    word = lambda i: {f"w{j}": float(j + 1) for j in range(6) if (i >> j) & 1}
    rows = [(i, rng.normal(size=3).tolist() if i & 1 else None, word(i) if i & 2 else None, rng.normal(size=2).tolist() if i & 4 else None) for i in range(64)]
    data = spark.createDataFrame(rows, MODAL)
    queries = data.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    want = tidy(hybrid.multimodal_search(data, queries, 9))
    assert tidy(scan.multimodal_scan(data, queries, 9, hybrid.MODAL_WEIGHTS)) == want and 0 not in {r[0] for r in want}
    monkeypatch.setattr(exact, "BROADCAST_CELLS", 9)
    assert tidy(scan.multimodal_scan(data, queries, 9, hybrid.MODAL_WEIGHTS)) == want
    assert scan.multimodal_scan(data.limit(0), queries, 9, hybrid.MODAL_WEIGHTS).collect() == []


def test_clusters_in_space_and_time(spark):
    at = F.floor(unit_column(F.col("id"), F.lit(99), 5) * 1_000_000)
    data = saved(generate_clustered(spark, 8, 6000, 40, 0.3).withColumn("ts", at))
    queries = saved(generate_clustered(spark, 8, 40, 40, 0.3, first=900_000).withColumnRenamed("id", "query_id"))
    index = scan.SpaceTimeClusters(data, 50, 4, rate=1e-5)
    found, truth = index.search(queries, 10, 500_000), scan.lim_scan(data, queries, 10, 500_000, rate=1e-5)
    assert recall_summary(recall_at_k(found, truth, 10)).first().avg_recall >= 0.9
    assert same_rows(index.search(queries, 10, 500_000, 50), truth) and index.members().count() == 6000


def same_rows(a, b):
    return tidy(a) == tidy(b)


def test_no_vectors_no_range_and_nulls(spark):
    schema = "id long, vector array<double>, ts long"
    queries = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<double>")
    assert scan.lim_scan(spark.createDataFrame([], schema), queries, 3, 0).collect() == []
    one = spark.createDataFrame([(5, [3.0, 4.0], 100), (6, None, 100), (7, [1.0, 1.0], None)], schema)
    found = scan.SpaceTimeClusters(one, 3, 1).search(queries, 3, 100).collect()
    assert [(r.id, round(r.distance, 9)) for r in found] == [(5, 0.35)]


@pytest.mark.parametrize("name", ["armi_search", "multimodal_distance_w", "lim_search", "lim_clustered_search"])
def test_matches_sql(spark, sf_dir, name):
    assert difference(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.ORACLE_SQL[name]) == ""
