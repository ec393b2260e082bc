"""Streaming ingest: micro-batches of vectors keep bucket statistics, shift statistics and a router up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.clustering import Centroids, Router, assign
from lodestone.operators.exact import _matrix
from lodestone.plans.storage import saved, ship


def running_counts(stream: DataFrame, key: str = "bucket") -> DataFrame:
    """(key, n) over a stream, kept by Spark's own state."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def windowed_means(stream: DataFrame, ts: str = "ts", value: str = "value", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Means by event-time window, with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "mean", "n")


def train_router(stream: DataFrame, router: Router, centroids: Centroids, checkpoint: str, steps: int = 32, rate: float = 0.001, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Feeds every row (id, vector) of each micro-batch to the router, in ``steps`` parts by a hash of the id.

    A part is one step by the sum of its rows' gradients. Every task sums those of its own rows: what comes to the driver
    is one row of the router's size for each task, however many rows there are.
    """

    def learn(df: DataFrame, epoch: int) -> None:
        rows = saved(assign(df.select("id", "vector"), centroids).select("id", "vector", "cluster_id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(steps)).cast("int")))
        for part in range(steps):
            found = gradients(rows.where(F.col("part") == part), router).toArrow()
            if found.num_rows:
                router.move(np.sum(found.column(0).to_pylist(), 0), rate)
        if then:
            then(epoch)

    return stream.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gradients(rows: DataFrame, router: Router) -> DataFrame:
    """(gradient): for each task that has any of ``rows`` (vector, cluster_id), the sum of their gradients under the router as it is now, all its weights in a row."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = router.gradient(_matrix(b.column(0)), b.column(1).to_numpy())
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["gradient"])

    return rows.select(F.col("vector").cast("array<double>").alias("vector"), "cluster_id").mapInArrow(run, "gradient array<double>")
