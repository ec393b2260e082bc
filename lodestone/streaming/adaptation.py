"""Adaptation: an index that follows a stream, and is rebuilt under its readers' feet once the vectors have moved."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.lists import ListIndex
from lodestone.operators.state import shift_stats
from lodestone.plans.storage import saved

Moments = dict[int, tuple[int, float, float]]  # by position: count, mean and sum of squared deviations


def moments(data: DataFrame) -> Moments:
    """Of the vectors of ``data``; one entry for each dimension."""
    return {r.pos: (r.n, r.mean, r.m2) for r in shift_stats(data).collect()}


def merged(parts: Sequence[Moments]) -> Moments:
    """Moments of several sets of vectors as those of all of them, in whatever order."""
    out: Moments = {}
    for part in parts:
        for pos, (n, mean, m2) in part.items():
            n0, mean0, m20 = out.get(pos, (0, 0.0, 0.0))
            both, apart = n0 + n, mean - mean0
            out[pos] = (both, mean0 + apart * n / both, m20 + m2 + apart * apart * n0 * n / both)
    return out


def moved(old: Moments, new: Moments) -> float:
    """How far ``new`` vectors lie from the mean of ``old``, by how far the old ones do, both as root mean squares; 1 if nothing has moved. Without spread among the old, infinite or 1."""
    far = sum(m2 / n + (mean - old[pos][1]) ** 2 for pos, (n, mean, m2) in new.items())
    near = sum(m2 / n for n, _, m2 in old.values())
    return (far / near) ** 0.5 if near > 0 else float("inf") if far > 0 else 1.0


def _stored(spark: SparkSession, path: str, number: int, of: Moments) -> None:
    rows = [(pos, *x) for pos, x in of.items()]
    spark.createDataFrame(rows, "pos int, n long, mean double, m2 double").coalesce(1).write.mode("overwrite").parquet(f"{path}/moments-{number}")


def feed(index: ListIndex, batch: DataFrame, number: int, threshold: float = 1.5, iterations: int = 5) -> tuple[ListIndex, bool]:
    """The index with ``batch`` (id, vector) put in, and whether that made a shift.

    A batch whose ``moved`` is above ``threshold``, against all batches since the last shift, makes one: lists are
    trained anew over all that is there, as the next version. Readers of earlier versions go on with them. Moments lie beside
    the index by the batch's number, so a batch that is fed twice leaves what it would have left once.
    """
    spark = batch.sparkSession
    batch = saved(batch.where("id is not null and vector is not null").select("id", "vector"))
    own = moments(batch)
    if not own:
        return index, False
    old = {r.pos: (r.n, r.mean, r.m2) for r in spark.read.parquet(f"{index.path}/moments-{number - 1}").collect()} if number else {}
    shift = bool(old) and moved(old, own) > threshold
    index = index.upsert(batch)
    if shift:
        index = index.compact(retrain=True, iterations=iterations)
    _stored(spark, index.path, number, own if shift else merged([old, own]))
    return index, shift


def following(stream: DataFrame, path: str, checkpoint: str, threshold: float = 1.5, iterations: int = 5, then: Callable[[int, bool], None] | None = None) -> StreamingQuery:
    """Feeds every micro-batch of ``stream`` (id, vector) to the index in ``path``; ``then`` hears each batch's number and whether it made a shift. Empty batches keep the moments before them."""

    def each(batch: DataFrame, number: int) -> None:
        index = ListIndex.load(batch.sparkSession, path)
        if batch.isEmpty():
            if number:
                _stored(batch.sparkSession, path, number, {r.pos: (r.n, r.mean, r.m2) for r in batch.sparkSession.read.parquet(f"{path}/moments-{number - 1}").collect()})
            shift = False
        else:
            _, shift = feed(index, batch, number, threshold, iterations)
        if then:
            then(number, shift)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
