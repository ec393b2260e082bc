"""Clustering, product quantisation and learned routing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.operators.exact import EmptyIndexError, _distances, _exact, _matrix, knn, top_k
from lodestone.operators.shortlist import rounded_distances, shortlisted
from lodestone.plans.storage import saved, ship

Centroids = list[list[float]]
PAIRS = 500_000  # pairs that a task holds at once, about


def first_rows(data: DataFrame, k: int) -> Centroids:
    """The vectors of the k smallest ids: a start that is the same every time."""
    rows = data.orderBy("id").limit(k).collect()
    if not rows:
        raise EmptyIndexError("no vectors to start from")
    return [list(r.vector) for r in rows]


def hashed_sample(data: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, in the order of a hash of their id."""
    return data.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def plus_plus(data: DataFrame, k: int, sample: int = 20_000, seed: int = 42, power: int = 2) -> Centroids:
    """Centroids drawn from a bounded sample, each with a probability that grows with its distance to those before."""
    rows = hashed_sample(data, sample, seed).collect()
    if not rows:
        raise EmptyIndexError("no vectors to start from")
    x, rng = np.array([r.vector for r in rows]), np.random.default_rng(seed)
    picked = [x[rng.integers(len(x))]]
    while len(picked) < min(k, len(x)):
        w = np.min([((x - c) ** 2).sum(1) for c in picked], 0) ** (power / 2)
        picked.append(x[rng.choice(len(x), p=w / w.sum())] if w.sum() > 0 else x[rng.integers(len(x))])
    return [c.tolist() for c in picked]


def assign(data: DataFrame, centroids: Centroids, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """``data`` (id, vector, ...) with cluster_id, the nearest centroid (ties to the lowest number), and its distance."""
    ship(data.sparkSession)
    c = np.array(centroids)
    at, names = data.columns.index("vector"), [*data.columns, "cluster_id", "centroid_distance"]
    schema = data.select("*", F.lit(0).alias("cluster_id"), F.lit(0.0).alias("centroid_distance")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(metric, _matrix(b.column(at)), c) if b.num_rows else np.zeros((0, len(c)))
            best = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32()), pa.array(d[np.arange(len(d)), best], pa.float64())], names=names)

    return data.mapInArrow(run, schema)


def means(assigned: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the mean of each cluster. Every task sends one sum for each of its clusters, however many vectors it has."""
    ship(assigned.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, cluster = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                total[c] = total.get(c, 0.0) + mine.sum(0)
                count[c] = count.get(c, 0) + len(mine)
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(count.values()), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["cluster_id", "n", "total"])

    parts = assigned.select(F.col("cluster_id").cast("int").alias("cluster_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(sums, "cluster_id int, n long, total array<double>")
    cells = parts.select("cluster_id", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster_id", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    return cells.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def kmeans(data: DataFrame, start: Centroids, iterations: int = 20, metric: Metric = Metric.EUCLIDEAN, tolerance: float = 1e-6, unit_length: bool = False) -> Centroids:
    """Lloyd's iterations from ``start``; an empty cluster keeps its centroid. The driver holds the centroids alone."""
    now = [list(c) for c in start]
    for _ in range(iterations):
        new = [list(c) for c in now]
        for r in means(assign(data.select("id", "vector"), now, metric)).collect():
            new[r.cluster_id] = list(r.centroid)
        if unit_length:
            new = [[x / (sum(y * y for y in c) ** 0.5 or 1.0) for x in c] for c in new]
        moved = max(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5 for a, b in zip(now, new))
        now = new
        if moved < tolerance:
            break
    return now


def as_table(spark, centroids: Centroids) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")


def route(queries: DataFrame, centroids: Centroids, n: int, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """(query_id, qv, cluster_id, probe, distance): the ``n`` nearest clusters of each query, ties to the lowest number; no shuffle, one matrix product for a batch of queries."""
    ship(queries.sparkSession)
    c = np.array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            most = min(len(c), n + 8)  # the product's rounding can swap near-ties, so a few more are measured term by term
            pick = np.sort(np.argsort(_distances(metric, x, c), 1, kind="stable")[:, :most], 1)
            exact = _exact(metric, x, c[pick])
            order = np.argsort(exact, 1, kind="stable")[:, :n]
            got, d = np.take_along_axis(pick, order, 1), np.take_along_axis(exact, order, 1)
            take = pa.array(np.repeat(np.arange(len(x)), got.shape[1]))
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(got.ravel(), pa.int32()), pa.array(np.tile(np.arange(got.shape[1]), len(x)), pa.int32()), pa.array(d.ravel())], ["query_id", "qv", "cluster_id", "probe", "distance"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "query_id long, qv array<double>, cluster_id int, probe int, distance double")


@dataclass(frozen=True)
class IvfIndex:
    """Vectors with their cluster, and the centroids."""

    data: DataFrame
    centroids: Centroids
    metric: Metric = Metric.EUCLIDEAN

    @classmethod
    def build(cls, data: DataFrame, n_clusters: int = 100, iterations: int = 20, metric: Metric = Metric.EUCLIDEAN, start: Centroids | None = None) -> IvfIndex:
        c = kmeans(data, start or plus_plus(data, n_clusters), iterations, metric, unit_length=metric is Metric.COSINE)
        return cls(assign(data, c, metric).drop("centroid_distance"), c, metric)

    def sizes(self) -> DataFrame:
        return self.data.groupBy("cluster_id").agg(F.count("*").alias("n"))

    def search(self, queries: DataFrame, k: int, n_probe: int = 10) -> DataFrame:
        """The best ``k`` among the vectors of the ``n_probe`` nearest clusters."""
        return bucket_search(self.data.withColumnRenamed("cluster_id", "bucket"), route(queries, self.centroids, n_probe, self.metric).withColumnRenamed("cluster_id", "bucket").select("query_id", "qv", "bucket", "probe"), k, self.metric)


def bucket_search(data: DataFrame, probes: DataFrame, k: int, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """(query_id, rank, id, distance): the best ``k`` of ``data`` (bucket, id, vector) in the buckets of ``probes`` (query_id, qv, bucket)."""
    from lodestone.operators.lists import probed

    routes = saved(probes.select("query_id", "qv", "bucket"))
    return probed(data, routes, routes.select("query_id", F.col("qv").alias("vector")).dropDuplicates(["query_id"]), k, metric)


# --- product quantisation -------------------------------------------------------------------------------------


def pq_split(data: DataFrame, m: int, dim: int) -> DataFrame:
    """``data`` with parts, m slices of the vector."""
    if dim % m:
        raise ValueError(f"dimension {dim} is not divisible by {m}")
    width = dim // m
    return data.withColumn("parts", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice("vector", i * width + 1, F.lit(width))))


def pq_train(data: DataFrame, m: int = 8, k: int = 256, iterations: int = 20, start: Centroids | None = None, sample: int = 20_000) -> list[Centroids]:
    """A codebook for each slice: k-means on the driver, from ``start`` (or the sample's first rows).

    Fitted on at most ``sample`` vectors, taken in the order of a hash of the id, so they are spread over all ids.
    """
    rows = hashed_sample(data, sample).collect()
    if not rows:
        raise EmptyIndexError("no vectors to train on")
    x = np.array([r.vector for r in rows])
    if x.shape[1] % m:
        raise ValueError(f"dimension {x.shape[1]} is not divisible by {m}")
    seeds = np.array(start) if start is not None else x[:k]
    books = []
    for part, c in zip(np.split(x, m, 1), np.split(seeds, m, 1)):
        c = c.copy()
        for _ in range(iterations):
            near = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
            c = np.array([part[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        books.append(c.tolist())
    return books


def pq_encode(data: DataFrame, books: list[Centroids]) -> DataFrame:
    """(id, codes array<smallint>): the nearest codeword of each slice, ties to the lowest number."""
    ship(data.sparkSession)
    c = [np.array(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                parts = np.split(_matrix(b.column(1)), len(c), 1)
                codes = np.stack([((p[:, None] - w) ** 2).sum(-1).argmin(1) for p, w in zip(parts, c)], 1).astype(np.int16)
                yield pa.record_batch([b.column(0), pa.array(list(codes), pa.list_(pa.int16()))], ["id", "codes"])

    return data.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, codes array<smallint>")


def pq_search(codes: DataFrame, queries: DataFrame, books: list[Centroids], k: int) -> DataFrame:
    """(query_id, rank, id, distance): the best ``k`` by asymmetric distance, that of the query to the codewords. Every task sends on its own best ``k``."""
    return knn(pq_decode(codes, books), queries, k)


def pq_distances(codes: DataFrame, queries: DataFrame, books: list[Centroids]) -> DataFrame:
    """(query_id, id, distance): squared asymmetric distances of all pairs, from tables of each query's distances to the words.

    Every task goes through its codes with a block of the queries at hand and gives out a few codes' distances at a time.
    """
    from lodestone.operators.postings import _dealt

    ship(codes.sparkSession)
    words = [np.array(b) for b in books]
    asked = saved(queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")))
    found = None
    for table in _dealt(asked, asked.select("query_id", F.lit(sum(map(len, words))).alias("n"))):  # a query's table is what it takes
        shared = codes.sparkSession.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_id = shared.value.column(0).to_numpy()
            if not len(q_id):
                return
            tables = [((p[None] - w[:, None]) ** 2).sum(-1) for p, w in zip(np.split(_matrix(shared.value.column(1)), len(words), 1), words)]  # words x queries
            step = max(1, PAIRS // len(q_id))
            for b in batches:
                ids, code = b.column(0), _matrix(b.column(1)).astype(int) if b.num_rows else None
                for at in range(0, b.num_rows, step):
                    c = code[at : at + step]
                    d = np.zeros((len(c), len(q_id)))
                    for s, t in enumerate(tables):
                        d += t[c[:, s]]
                    yield pa.record_batch([pa.array(np.tile(q_id, len(c))), ids.take(pa.array(np.repeat(np.arange(at, at + len(c)), len(q_id)))), pa.array(d.ravel())], ["query_id", "id", "distance"])

        one = codes.select("id", "codes").mapInArrow(run, "query_id long, id long, distance double")
        found = one if found is None else found.unionByName(one)
    return found


def pq_decode(codes: DataFrame, books: list[Centroids]) -> DataFrame:
    """(id, vector): the codewords in place of the codes. Distances to it are the asymmetric distances of ``pq_search``."""
    ship(codes.sparkSession)
    c = [np.array(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1)).astype(int)
                rows = np.concatenate([w[x[:, s]] for s, w in enumerate(c)], 1)
                yield pa.record_batch([b.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["id", "vector"])

    return codes.select("id", "codes").mapInArrow(run, "id long, vector array<double>")


def pq_rerank(data: DataFrame, queries: DataFrame, k: int, m: int = 8, words: int = 256, iterations: int = 20, least: int = 300, share: float = 0.03, books: list[Centroids] | None = None) -> DataFrame:
    """(query_id, rank, id, distance): a shortlist by codes, ranked exactly. It holds ``share`` of all vectors, and at least ``least``. Without ``books``, they are trained here."""
    books = books or pq_train(data, m, words, iterations)
    most = max(least, k, ceil(share * data.count()))
    c = [np.array(b) for b in books]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                parts = np.split(_matrix(b.column(1)), len(c), 1)
                words = np.concatenate([w[((p[:, None] - w) ** 2).sum(-1).argmin(1)] for p, w in zip(parts, c)], 1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(list(words), pa.list_(pa.float64()))], ["id", "vector", "small"])

    rows = data.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(coded, "id long, vector array<double>, small array<double>")
    return shortlisted(rows, queries.withColumn("small", F.col("vector")), k, most, rounded_distances)


# --- learned routing ------------------------------------------------------------------------------------------


@dataclass
class Router:
    """A perceptron with one hidden layer that names the cluster of a vector."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def new(cls, dim: int, clusters: int, hidden: int = 128, seed: int = 42) -> Router:
        rng = np.random.default_rng(seed)
        xavier = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        return cls(xavier(dim, hidden), np.zeros(hidden), xavier(hidden, clusters), np.zeros(clusters))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(np.atleast_2d(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient of the cross-entropy of vectors ``x`` and their clusters ``y``, summed over them, all weights in a row."""
        h = np.maximum(x @ self.w1 + self.b1, 0)
        g = self.predict(x)
        g[np.arange(len(y)), y] -= 1
        back = (g @ self.w2.T) * (h > 0)
        return np.concatenate([grad.ravel() for grad in (x.T @ back, back.sum(0), h.T @ g, g.sum(0))])

    def move(self, gradient: np.ndarray, rate: float = 0.001) -> None:
        """One step down a ``gradient``."""
        at = 0
        for p in (self.w1, self.b1, self.w2, self.b2):
            p -= rate * gradient[at : at + p.size].reshape(p.shape)
            at += p.size

    def step(self, x: np.ndarray, y: np.ndarray, rate: float = 0.001) -> None:
        """One step of gradient descent on vectors ``x`` and their clusters ``y``."""
        self.move(self.gradient(x, y), rate)

    def fit(self, assigned: DataFrame, epochs: int = 5, sample: int = 20_000, rate: float = 0.001, batch: int = 32) -> Router:
        """Trains on ``assigned`` (id, vector, cluster_id): at most ``sample`` rows, spread over all ids by a hash of the id."""
        rows = hashed_sample(assigned, sample).select("vector", "cluster_id").collect()
        x, y = np.array([r.vector for r in rows]), np.array([r.cluster_id for r in rows])
        for _ in range(epochs):
            for at in range(0, len(y), batch):
                self.step(x[at : at + batch], y[at : at + batch], rate)
        return self


def gated_route(queries: DataFrame, router: Router, centroids: Centroids, n: int = 3, confidence: float = 0.7) -> DataFrame:
    """(query_id, qv, cluster_id, probe): the router's clusters if it is sure of its first one, the nearest centroids if not."""
    ship(queries.sparkSession)
    c = np.array(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            p = router.predict(x)
            order = np.where((p.max(1) >= confidence)[:, None], np.argsort(-p, 1, kind="stable"), np.argsort(_distances(Metric.EUCLIDEAN, x, c), 1, kind="stable"))[:, :n]
            take = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(order.shape[1]), len(x)), pa.int32())], ["query_id", "qv", "cluster_id", "probe"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInArrow(run, "query_id long, qv array<double>, cluster_id int, probe int")


def ensemble_route(parts: Sequence[tuple[DataFrame, float]], n: int) -> DataFrame:
    """(query_id, rank, cluster_id, p): weighted mean of several routings (query_id, cluster_id, p), best first."""
    whole = sum(w for _, w in parts)
    union = None
    for df, w in parts:
        one = df.select("query_id", "cluster_id", (F.col("p") * (w / whole)).alias("p"))
        union = one if union is None else union.unionByName(one)
    summed = union.groupBy("query_id", "cluster_id").agg(F.sum("p").alias("p"))
    return top_k(summed, n, by=-F.round("p", 12), tie="cluster_id").select("query_id", "rank", "cluster_id", "p")
