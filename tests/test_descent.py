import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.operators import descent, graph
from lodestone.operators.exact import knn, recall_at_k, recall_summary
from lodestone.plans.storage import saved
from lodestone.sources.vectors import generate_clustered, generate_uniform


def recall(found, truth):
    as_found = lambda df: df.select(F.col("src").alias("query_id"), "rank", F.col("dst").alias("id"))
    return recall_summary(recall_at_k(as_found(found), as_found(truth), 10)).first().avg_recall


def test_recall_and_work_at_three_sizes(spark):
    work = []
    for n in (1000, 4000, 16000):
        data = saved(generate_clustered(spark, 12, n, 40, 0.3))
        count = spark.sparkContext.accumulator(0)
        found = saved(descent.descended(data, 10, work=count))
        work.append(count.value)
        assert found.groupBy("src").count().where("count != 10").isEmpty() and found.count() == 10 * n
        assert recall(found, graph.knn_graph(data, 10)) >= 0.95
    assert work[1] < 6 * work[0] and work[2] < 6 * work[1] and work[2] < 16000**2 / 2


def test_edges_are_measured_and_ranked(spark):
    data = generate_uniform(spark, 8, 600)
    x = {r.id: np.array(r.vector) for r in data.collect()}
    for metric, d in ((Metric.EUCLIDEAN, lambda a, b: np.linalg.norm(a - b)), (Metric.COSINE, lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))):
        rows = descent.descended(data, 5, metric).collect()
        by = {}
        for r in sorted(rows, key=lambda r: (r.src, r["rank"])):
            assert r.src != r.dst and abs(r.distance - d(x[r.src], x[r.dst])) < 1e-9
            by.setdefault(r.src, []).append((r.distance, r.dst))
        assert len(by) == 600 and all(v == sorted(set(v)) and len(v) == 5 for v in by.values())


def test_few_rows_equal_vectors_and_nulls(spark):
    schema = "id long, vector array<double>"
    assert descent.descended(spark.createDataFrame([], schema), 3).collect() == []
    assert descent.descended(spark.createDataFrame([(1, [1.0])], schema), 3).collect() == []
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [5.0]), (None, [1.0]), (4, None)], schema)
    assert {(r.src, r["rank"], r.dst, r.distance) for r in descent.descended(few, 3).collect()} == {(1, 1, 2, 0.0), (1, 2, 3, 4.0), (2, 1, 1, 0.0), (2, 2, 3, 4.0), (3, 1, 1, 4.0), (3, 2, 2, 4.0)}
    same = spark.range(1500).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    assert descent.descended(same, 4).where("distance = 0").count() == 6000
    with pytest.raises(ValueError):
        descent.descended(few, 0)


def test_a_walk_over_a_descended_graph(spark):
    data, queries = saved(generate_uniform(spark, 16, 3000)), generate_uniform(spark, 16, 40, seed=7).withColumnRenamed("id", "query_id")
    index = graph.GraphIndex.build(data, 16)
    found = index.search(queries, 10)
    assert recall_summary(recall_at_k(found, knn(data, queries, 10), 10)).first().avg_recall >= 0.95


def test_a_vector_goes_once_to_each_cell(spark, monkeypatch):
    monkeypatch.setattr(descent, "CELL", 150)
    sent, measured, asked, real = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), [], descent.in_cells

    def counted(refs, by, members, data, cells, of_cell, schema):
        def run(pairs, known):
            assert len(set(known.column("id").to_pylist())) == known.num_rows
            sent.add(known.num_rows)
            measured.add(pairs.num_rows)
            return of_cell(pairs, known)

        asked.append(cells)
        return real(refs, by, members, data, cells, run, schema)

    monkeypatch.setattr(descent, "in_cells", counted)
    data = saved(generate_uniform(spark, 8, 600))
    found = saved(descent.descended(data, 10))
    assert set(asked) == {4} and 0 < sent.value <= 600 * sum(asked) < measured.value / 2
    assert recall(found, graph.knn_graph(data, 10)) >= 0.95


@pytest.mark.parametrize("held", [4_000_000, 10])
def test_finds_are_the_best_of_all_neighbourhoods(monkeypatch, held):
    monkeypatch.setattr(descent, "HELD", held)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3)).astype(np.float32)
    centre, member, fresh, worst = rng.integers(0, 8, 90), rng.integers(0, 30, 90), rng.random(90) < 0.4, rng.uniform(1, 4, 30)
    want = {}
    for c in range(8):
        new = {m: fresh[(centre == c) & (member == m)].any() for m in set(member[centre == c].tolist())}
        for a in new:
            for b in new:
                d = np.linalg.norm(x[a].astype(float) - x[b])
                if a != b and (new[a] or new[b]) and d < worst[a]:
                    want.setdefault(a, {})[b] = d
    (a, b, d), _ = descent._finds(centre, member, fresh, worst, x, 4)
    got = {}
    for i, j, e in zip(a.tolist(), b.tolist(), d):
        assert abs(e - want[i][j]) < 1e-6
        got.setdefault(i, []).append(j)
    assert got == {i: sorted(w, key=w.get)[:4] for i, w in want.items()}


def test_pruning_in_cells_is_that_of_each_list(spark):
    data = saved(generate_uniform(spark, 4, 300))
    edges = graph.knn_graph(data, 9).drop("rank").collect()
    x, lists = {r.id: np.array(r.vector) for r in data.collect()}, {}
    for e in sorted(edges, key=lambda e: (e.src, e.distance, e.dst)):
        lists.setdefault(e.src, []).append((e.dst, e.distance))
    want = set()
    for src, near in lists.items():
        chosen = []
        for dst, d in near:
            if len(chosen) < 3 and all(np.linalg.norm(x[c] - x[dst]) >= 0.95 * d for c, _ in chosen):
                chosen.append((dst, d))
        chosen += [e for e in near if e not in chosen][: 5 - len(chosen)]
        want |= {(src, dst, d) for dst, d in chosen}
    rows = spark.createDataFrame([tuple(e) for e in edges], "src long, dst long, distance double")
    assert {tuple(r) for r in graph.rng_prune(rows, data, 5).collect()} == want
    assert graph.rng_prune(rows.limit(0), data, 5).collect() == []
