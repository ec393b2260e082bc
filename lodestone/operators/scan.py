"""Exact searches by a measure of their own: every task goes through its rows with the queries at hand and sends on its best."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.operators.clustering import Centroids, first_rows, means
from lodestone.operators.exact import _exact, _matrix, top_k
from lodestone.operators.postings import _Best, _dealt
from lodestone.plans.storage import saved, ship

Measure = Callable[[pa.RecordBatch], Callable[[dict], tuple[np.ndarray, np.ndarray]]]


def block_scan(data: DataFrame, queries: DataFrame, k: int, cells: Column, measure: Measure) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` rows of ``data`` (id, ...) with the smallest distance to each of ``queries`` (query_id, ...), ties to the smaller id.

    ``measure`` prepares a batch of rows and returns a function that gives, for a query, the places of the rows that
    count and their distances. ``cells`` is the size of a query, by which queries are parted into blocks that every
    task can hold; data are read once for each block.
    """
    if k <= 0:
        raise ValueError("the limit must be above 0")
    ship(data.sparkSession)
    at = data.columns.index("id")
    asked = saved(queries)
    found = None
    for table in _dealt(asked, asked.select("query_id", cells.alias("n"))):
        shared = data.sparkSession.sparkContext.broadcast(table)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows, best = shared.value.to_pylist(), _Best(k)
            for b in batches:
                if b.num_rows:
                    of, ids = measure(b), b.column(at).to_numpy()
                    for q in rows:
                        some, d = of(q)
                        if len(some):
                            best.add(q["query_id"], d, ids[some])
            yield from best.out()

        one = data.mapInArrow(scan, "query_id long, id long, distance double")
        found = one if found is None else found.unionByName(one)
    return top_k(found, k).select("query_id", "rank", "id", "distance")


# --- several modalities ----------------------------------------------------------------------------------------


def _present(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are there, and these as a matrix."""
    there = np.flatnonzero(np.asarray(column.is_valid()))
    return there, _matrix(column.take(pa.array(there))) if len(there) else np.zeros((0, 0))


def multimodal_scan(data: DataFrame, queries: DataFrame, k: int, weights: tuple[float, float, float], metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """Exact search by the weighted mean over the modalities that both sides have. ``data`` has (id, dense, sparse, audio), sparse as a map of terms to weights; queries (query_id, ...). What shares no modality isn't found.

    Sparse distance is 1 - cos, within [0, 2]; 1 if either map is empty.
    """

    def measure(b: pa.RecordBatch):
        n, names = b.num_rows, b.schema.names
        column = lambda name: b.column(names.index(name))
        parts = {name: _present(column(name)) for name in ("dense", "audio")}
        maps = column("sparse")
        sparse = np.asarray(maps.is_valid())
        owner = np.repeat(np.arange(n), np.asarray(pa.compute.list_value_length(maps.cast(pa.list_(pa.struct([("key", maps.type.key_type), ("value", maps.type.item_type)])))).fill_null(0)))
        keys, values = maps.keys.to_pylist() if len(owner) else [], np.asarray(maps.items, np.float64) if len(owner) else np.zeros(0)
        norm = np.sqrt(np.bincount(owner, values * values, n)) if len(owner) else np.zeros(n)
        held: dict[str, list[int]] = {}
        for i, key in enumerate(keys):
            held.setdefault(key, []).append(i)
        by = {key: np.array(i) for key, i in held.items()}

        def of(q: dict) -> tuple[np.ndarray, np.ndarray]:
            above, below = np.zeros(n), np.zeros(n)
            for name, w in (("dense", weights[0]), ("audio", weights[2])):
                there, x = parts[name]
                if q[name] is not None and len(there):
                    above[there] += w * _exact(metric, np.array(q[name])[None], x[None])[0]
                    below[there] += w
            if q["sparse"] is not None and sparse.any():
                terms = dict(q["sparse"])
                known = [t for t in terms if t in by]
                at = np.concatenate([by[t] for t in known]) if known else np.zeros(0, np.int64)
                dot = np.bincount(owner[at], values[at] * np.repeat([terms[t] for t in known], [len(by[t]) for t in known]), n) if known else np.zeros(n)
                both = norm * np.sqrt(sum(w * w for w in terms.values()))
                cos = np.divide(dot, both, out=np.zeros(n), where=both > 0)
                above[sparse] += weights[1] * (1 - np.clip(cos[sparse], -1, 1))
                below[sparse] += weights[1]
            some = np.flatnonzero(below > 0)
            return some, np.round(above[some] / below[some], 12)

        return of

    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    asked = queries.select("query_id", "dense", "sparse", "audio")
    return block_scan(data.select(F.col("id").cast("long").alias("id"), "dense", "sparse", "audio"), asked, k, size("dense") + size("sparse") + size("audio"), measure)


# --- space and time --------------------------------------------------------------------------------------------


def combined(d: np.ndarray, seconds: np.ndarray, low: float, high: float, weight: float, rate: float) -> np.ndarray:
    """weight * distance, scaled to [0, 1] between ``low`` and ``high`` (0.5 without a range), + (1 - weight) * (1 - exp(-|seconds| * rate))."""
    near = np.full(d.shape, 0.5) if high - low < 1e-10 else np.clip((d - low) / (high - low), 0, 1)
    return weight * near + (1 - weight) * (1 - np.exp(-np.abs(seconds) * rate))


def spread(data: DataFrame, metric: Metric = Metric.EUCLIDEAN) -> tuple[float, float]:
    """Smallest and largest distance of the vectors from their mean; (0, 0) for no vectors, which leaves combined distances without a range."""
    ship(data.sparkSession)
    rows = means(data.select(F.lit(0).alias("cluster_id"), "vector")).collect()
    if not rows:
        return 0.0, 0.0
    mean = np.array(rows[0].centroid)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _exact(metric, mean[None], _matrix(b.column(0))[None])[0]
                yield pa.record_batch([pa.array([d.min()]), pa.array([d.max()])], ["low", "high"])

    r = data.select(F.col("vector").cast("array<double>").alias("vector")).mapInArrow(ends, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    return r.low, r.high


def lim_scan(data: DataFrame, queries: DataFrame, k: int, now: int, weight: float = 0.7, rate: float = 0.01, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """Exact search by distance, scaled to the range of distances to the mean of all vectors, combined with age; ``data`` has (id, vector, ts in seconds)."""
    low, high = spread(data, metric)

    def measure(b: pa.RecordBatch):
        x, age = _matrix(b.column(1)), now - b.column(2).to_numpy()

        def of(q: dict) -> tuple[np.ndarray, np.ndarray]:
            return np.arange(len(x)), np.round(combined(_exact(metric, np.array(q["vector"])[None], x[None])[0], age, low, high, weight, rate), 12)

        return of

    rows = data.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("ts").cast("double").alias("ts"))
    return block_scan(rows, queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")), k, F.size("vector"), measure)


@dataclass(frozen=True)
class SpaceTime:
    """The combined distance between vectors with a time behind them."""

    low: float
    high: float
    weight: float = 0.7
    rate: float = 0.01
    metric: Metric = Metric.EUCLIDEAN

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of the rows of two tables."""
        d = _exact(self.metric, x[:, :-1], np.broadcast_to(to[None, :, :-1], (len(x), *to[:, :-1].shape)))
        return np.round(combined(d, x[:, -1:] - to[None, :, -1], self.low, self.high, self.weight, self.rate), 12)


class SpaceTimeClusters:
    """Clusters with a mean vector and a mean time. What is near in one and far in the other belongs elsewhere: rows and queries go by the combined distance."""

    def __init__(self, data: DataFrame, n_clusters: int = 50, iterations: int = 5, weight: float = 0.7, rate: float = 0.01, metric: Metric = Metric.EUCLIDEAN, start: Centroids | None = None) -> None:
        """``data`` has (id, vector, ts in seconds). The start is ``start`` (vectors with the time behind them) or the rows with the smallest ids; a cluster that loses all rows stays where it is. The driver holds the clusters."""
        ship(data.sparkSession)
        self.data = data.where("id is not null and vector is not null and ts is not null").select("id", F.concat(F.col("vector").cast("array<double>"), F.array(F.col("ts").cast("double"))).alias("vector"))
        self.measure = SpaceTime(*spread(self.data.select(F.slice("vector", 1, F.size("vector") - 1).alias("vector")), metric), weight, rate, metric)
        now = np.array(start if start is not None else first_rows(self.data, n_clusters))
        for _ in range(iterations):
            new = now.copy()
            for r in means(self._assigned(now)).collect():
                new[r.cluster_id] = r.centroid
            now = new
        self.centroids = now

    def _assigned(self, centroids: np.ndarray) -> DataFrame:
        measure = self.measure

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1))
                    near = np.concatenate([measure.distances(x[i : i + 256], centroids).argmin(1) for i in range(0, len(x), 256)])
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(near.astype(np.int32))], ["id", "vector", "cluster_id"])

        return self.data.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, vector array<double>, cluster_id int")

    def members(self) -> DataFrame:
        """(id, vector with the time behind it, cluster_id)."""
        return self._assigned(self.centroids)

    def search(self, queries: DataFrame, k: int, now: int, n_probe: int = 5) -> DataFrame:
        """The best ``k`` by combined distance among the rows of the ``n_probe`` clusters that are nearest by it; ties to the lowest number."""
        apart, centroids = self.measure, self.centroids

        def measure(b: pa.RecordBatch):
            x, cluster = _matrix(b.column(1)), b.column(2).to_numpy()

            def of(q: dict) -> tuple[np.ndarray, np.ndarray]:
                at = np.array([*q["vector"], now])
                probed = np.argsort(apart.distances(at[None], centroids)[0], kind="stable")[:n_probe]
                some = np.flatnonzero(np.isin(cluster, probed))
                return some, apart.distances(at[None], x[some])[0] if len(some) else np.zeros(0)

            return of

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        return block_scan(self.members(), asked, k, F.size("vector"), measure)
