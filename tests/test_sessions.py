import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.exact import knn
from lodestone.sources.vectors import generate_uniform
from lodestone.streaming import sessions as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "session long, seq long, vector array<double>, found array<long>"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def test_a_full_memory_gives_up_what_was_found_worst():
    m = S.Memory(hot=2, history=2)
    m.update(0, [1.0, 0.0], [5, 6], 10)
    m.update(1, [0.0, 1.0], [5], 10)
    m.update(2, [1.0, 1.0], [7], 10)
    assert m.hot == {5: [2, 2.0], 7: [1, 1.0]} and [h[0] for h in m.history] == [1, 2]
    assert m.related([0.0, 2.0]) == 1 and m.related([1.0, 0.0]) is None and m.ef([0.0, 1.0]) == 22
    again = S.Memory(hot=2, history=2).read(m.written())
    assert (again.hot, again.queries, again.effort) == (m.hot, 3, 30) and again.related([0.0, 2.0]) == 1


def test_a_stream_equals_a_fold_and_goes_on_after_a_restart(spark, rocks, tmp_path):
    rng = random.Random(1)
    rows = [(s, i, [rng.choice((0.0, 1.0)) for _ in range(3)], rng.sample(range(30), 5)) for i in range(40) for s in range(3)]
    want = []
    for s in range(3):
        m = S.Memory(hot=8, history=5)
        for _, i, v, f in [r for r in rows if r[0] == s]:
            related, ef, hits = m.step(i, v, f)
            want.append((s, i, related, ef, hits, len(m.hot), m.queries))
    for part, (low, high) in enumerate(((0, 15), (15, 40))):  # the second run starts from the first one's checkpoint
        some = [r for r in rows if low <= r[1] < high]
        rng.shuffle(some)
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = S.remembered(stream, hot=8, history=5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = [(r.session, r.seq, r.related, r.ef, list(r.hits), r.n_hot, r.queries) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(r[5] for r in want) == 8 and any(r[2] is not None for r in want)


def test_batches_are_searched(spark, tmp_path):
    data = generate_uniform(spark, 4, 200)
    asked = data.where("id < 6").select((F.col("id") % 2).alias("session"), F.col("id").alias("seq"), F.col("id").alias("query_id"), "vector")
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    q = S.searched_sessions(stream, lambda b: knn(data, b, 3), str(tmp_path / "c"), str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(found) == 6 and all(len(r.found) == 3 and r.found[0] == r.query_id for r in found)
