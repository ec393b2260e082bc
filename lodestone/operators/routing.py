"""Routes to clusters: over a graph of centroids, by terms, and by several modalities at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.operators.clustering import Centroids, Router, hashed_sample, means
from lodestone.operators.exact import EmptyIndexError, _distances, _exact, _matrix, top_k
from lodestone.plans.storage import saved, ship

# --- a graph of centroids --------------------------------------------------------------------------------------


class CentroidGraph:
    """Centroids below the square root of their number of tops. Each hangs below its ``links`` nearest tops, so that what lies between two of them is found from either.

    A vector is compared with all tops and with the centroids below its ``beam`` nearest ones: for C centroids about
    (1 + links * beam) sqrt(C) comparisons. A beam of all tops compares with every centroid.
    """

    def __init__(self, centroids: Centroids | np.ndarray, metric: Metric = Metric.EUCLIDEAN, links: int = 3, rounds: int = 8, seed: int = 42) -> None:
        self.c, self.metric = np.array(centroids, np.float64), metric
        n = ceil(sqrt(len(self.c)))
        tops = self.c[np.sort(np.random.default_rng(seed).choice(len(self.c), n, replace=False))]
        for _ in range(rounds):
            near = self._near(self.c, tops, 1)[:, 0]
            tops = np.array([self.c[near == i].mean(0) if (near == i).any() else tops[i] for i in range(n)])
        below = self._near(self.c, tops, min(links, n))
        found = [np.flatnonzero((below == i).any(1)) for i in range(n)]
        self.tops, self.below = tops[[len(x) > 0 for x in found]], [x for x in found if len(x)]

    def _near(self, x: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest rows of ``to`` for each of x's, in no order. A zero mean among the tops is nobody's nearest under cosine."""
        if self.metric is Metric.COSINE:
            to = np.where(np.linalg.norm(to, axis=1, keepdims=True) == 0, np.nextafter(0, 1), to)
        d = _distances(self.metric, x, to)
        return np.argpartition(d, n - 1, 1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(x), 1))

    def route(self, x: np.ndarray, n: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the ``n`` nearest centroids found for each row, ties to the lowest number; -1 and infinity where fewer are found."""
        most = min(len(self.c), n + 8)  # products can swap near-ties, so a few more are measured term by term
        best, dist = np.full((len(x), most), -1), np.full((len(x), most), np.inf)
        asked = self._near(x, self.tops, min(beam, len(self.tops)))
        for top in np.unique(asked):
            rows, cells = np.flatnonzero((asked == top).any(1)), self.below[top]
            d = _distances(self.metric, x[rows], self.c[cells])
            both, which = np.concatenate((dist[rows], d), 1), np.concatenate((best[rows], np.tile(cells, (len(rows), 1))), 1)
            # A centroid can hang below several tops of the beam: its first place stands.
            order = np.argsort(which, 1, kind="stable")
            sorted_ = np.take_along_axis(which, order, 1)
            again = np.zeros_like(both, bool)
            np.put_along_axis(again, order[:, 1:], (sorted_[:, 1:] == sorted_[:, :-1]) & (sorted_[:, 1:] >= 0), 1)
            both[again], which[again] = np.inf, -1
            keep = np.argpartition(both, most - 1, 1)[:, :most]
            dist[rows], best[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(which, keep, 1)
        exact = np.where(best >= 0, _exact(self.metric, x, self.c[np.maximum(best, 0)]), np.inf)
        order = np.lexsort((best, exact), axis=1)[:, :n]
        return np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)


def graph_assign(data: DataFrame, graph: CentroidGraph, beam: int = 3) -> DataFrame:
    """``data`` (id, vector, ...) with cluster_id, the nearest centroid that the graph finds."""
    ship(data.sparkSession)
    at, names = data.columns.index("vector"), [*data.columns, "cluster_id"]
    schema = data.select("*", F.lit(0).alias("cluster_id")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = graph.route(_matrix(b.column(at)), 1, beam)[0][:, 0] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32))], names=names)

    return data.mapInArrow(run, schema)


def graph_route(queries: DataFrame, graph: CentroidGraph, n: int, beam: int = 8) -> DataFrame:
    """(query_id, qv, cluster_id, probe, distance): the ``n`` nearest clusters that the graph finds for each query, ties to the lowest number."""
    ship(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            best, d = graph.route(_matrix(b.column(1)), n, beam)
            row, probe = np.nonzero(best >= 0)
            take = pa.array(row)
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array(best[row, probe], pa.int32()), pa.array(probe, pa.int32()), pa.array(d[row, probe])], ["query_id", "qv", "cluster_id", "probe", "distance"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "query_id long, qv array<double>, cluster_id int, probe int, distance double")


def graph_kmeans(data: DataFrame, n_clusters: int | None = None, iterations: int = 5, metric: Metric = Metric.EUCLIDEAN, beam: int = 3, per: int = 8) -> Centroids:
    """Lloyd's rounds with ceil(sqrt(n)) clusters, or as many as are asked for, whose assignments go over the graph of centroids.

    The start comes from at most ``per`` vectors for each cluster, spread by a hash of the id: rounds over these on the
    driver, then ``iterations`` rounds over all data. The driver holds the centroids and this sample.
    """
    k = n_clusters or ceil(sqrt(max(1, data.count())))
    rows = hashed_sample(data, per * k).collect()
    if not rows:
        raise EmptyIndexError("no vectors to start from")
    x = np.array([r.vector for r in rows])
    now = x[: min(k, len(x))].copy()

    def moved(centroids: np.ndarray, mean: dict[int, np.ndarray]) -> np.ndarray:
        new = np.array([mean.get(i, c) for i, c in enumerate(centroids)])
        return new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-300) if metric is Metric.COSINE else new

    for _ in range(4):
        near = CentroidGraph(now, metric).route(x, 1, beam)[0][:, 0]
        total, count = np.zeros_like(now), np.bincount(near, minlength=len(now))
        np.add.at(total, near, x)
        now = moved(now, {i: total[i] / count[i] for i in np.flatnonzero(count)})
    for _ in range(iterations):
        now = moved(now, {r.cluster_id: np.array(r.centroid) for r in means(graph_assign(data.select("id", "vector"), CentroidGraph(now, metric), beam)).collect()})
    return now.tolist()


# --- routes by terms -------------------------------------------------------------------------------------------


def term_clusters(terms: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(term, cluster_id, hits, mass) of a batch: the weight of ``terms`` (id, term, weight) within each of ``clusters`` (id, cluster_id), and over all of them. Without ``clusters``, terms have a cluster_id.

    Sums of sums, so batches can be put together in any order.
    """
    hits = (terms if clusters is None else terms.join(clusters.select("id", "cluster_id"), "id")).groupBy("term", "cluster_id").agg(F.sum("weight").alias("hits"))
    mass = hits.groupBy("term").agg(F.sum("hits").alias("mass"))
    # The hits lie by (term, cluster_id): by another key both sides are shuffled for this join alone.
    return hits.withColumn("of", F.concat(F.lit("/"), "term")).join(mass.select(F.concat(F.lit("/"), "term").alias("of"), "mass"), "of").select("term", "cluster_id", "hits", "mass")


def merged_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Several batches of ``term_clusters`` as one."""
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    summed = every.groupBy("term", "cluster_id").agg(F.sum("hits").alias("hits"))
    mass = summed.groupBy("term").agg(F.sum("hits").alias("mass"))
    return summed.join(mass, "term").select("term", "cluster_id", "hits", "mass")


def learned_terms(table: DataFrame | None, batch: DataFrame, rate: float = 0.1) -> DataFrame:
    """(term, cluster_id, w): the table after a ``batch`` of term_clusters: for its terms each w moves by ``rate`` towards the share of the term's weight that lies in the cluster. A first table starts at those shares."""
    share = batch.select("term", "cluster_id", (F.col("hits") / F.col("mass")).alias("share"))
    if table is None:
        return share.withColumnRenamed("share", "w")
    known = batch.select("term").distinct().withColumn("known", F.lit(True))
    both = table.join(share, ["term", "cluster_id"], "full").join(known, "term", "left")
    # A term that the table doesn't know starts at the batch's shares, as in a first table.
    new = both.join(table.select("term").distinct().withColumn("old", F.lit(True)), "term", "left")
    w, s = F.coalesce("w", F.lit(0.0)), F.coalesce("share", F.lit(0.0))
    return new.select("term", "cluster_id", F.when(F.col("known").isNull(), w).when(F.col("old").isNull(), s).otherwise(w + rate * (s - w)).alias("w"))


def _softmax(scores: DataFrame, n_clusters: int) -> DataFrame:
    """(query_id, cluster_id, p) from (query_id, cluster_id, score): softmax over all clusters; where a cluster has no score, it is zero."""
    each = scores.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(n_clusters - 1))).alias("cluster_id"))
    full = each.join(scores, ["query_id", "cluster_id"], "left").withColumn("e", F.exp(F.coalesce("score", F.lit(0.0))))
    return full.select("query_id", "cluster_id", (F.col("e") / F.sum("e").over(Window.partitionBy("query_id"))).alias("p"))


def sparse_route(asked: DataFrame, table: DataFrame, n_clusters: int) -> DataFrame:
    """(query_id, cluster_id, p) of every query of ``asked`` (query_id, term, qweight): the mean of its known terms' w, then softmax; uniform if no term is known."""
    met = asked.join(table, "term").groupBy("query_id", "cluster_id").agg(F.sum(F.col("qweight") * F.col("w")).alias("s"))
    known = asked.join(table.select("term").distinct(), "term", "left_semi").groupBy("query_id").agg(F.sum("qweight").alias("total"))
    scores = met.join(known, "query_id").select("query_id", "cluster_id", (F.col("s") / F.col("total")).alias("score"))
    none = asked.select("query_id").distinct().join(known, "query_id", "left_anti").select("query_id", F.lit(0).alias("cluster_id"), F.lit(0.0).alias("score"))
    return _softmax(scores.unionByName(none), n_clusters)


# --- routes by several modalities ------------------------------------------------------------------------------


def learned_route(queries: DataFrame, router: Router) -> DataFrame:
    """(query_id, cluster_id, p): the router's probabilities for ``queries`` (query_id, vector); those without a vector have none."""
    ship(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = router.predict(_matrix(b.column(1)))
                yield pa.record_batch([b.column(0).take(pa.array(np.repeat(np.arange(len(p)), p.shape[1]))), pa.array(np.tile(np.arange(p.shape[1]), len(p)), pa.int32()), pa.array(p.ravel())], ["query_id", "cluster_id", "p"])

    asked = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    return asked.mapInArrow(run, "query_id long, cluster_id int, p double")


def fused(parts: Sequence[tuple[DataFrame, float | Column]]) -> DataFrame:
    """(query_id, cluster_id, p, confidence): the weighted mean of several routings (query_id, cluster_id, p) over those that have the query; confidence is its largest p.

    A weight is a number, or a column of the routing with one value for each query, such as its own confidence.
    """
    every = None
    for i, (df, w) in enumerate(parts):
        weight = w if isinstance(w, Column) else F.lit(float(w))
        one = df.select("query_id", "cluster_id", "p", weight.alias("w"), F.lit(i).alias("part"))
        every = one if every is None else every.unionByName(one)
    total = every.groupBy("query_id", "part").agg(F.first("w").alias("w")).groupBy("query_id").agg(F.sum("w").alias("total"))
    summed = every.groupBy("query_id", "cluster_id").agg(F.sum(F.col("w") * F.col("p")).alias("s"))
    p = summed.join(total, "query_id").select("query_id", "cluster_id", (F.col("s") / F.col("total")).alias("p"))
    return p.withColumn("confidence", F.max("p").over(Window.partitionBy("query_id")))


def with_confidence(routing: DataFrame) -> DataFrame:
    """A routing with its largest p for each query, as ``fused`` can weight it by."""
    return routing.withColumn("confidence", F.max("p").over(Window.partitionBy("query_id")))


def best_clusters(routing: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, cluster_id, p): the ``n`` likeliest clusters of each query, ties (to twelve digits) to the lowest number."""
    return top_k(routing.select("query_id", "cluster_id", "p"), n, by=-F.round("p", 12), tie="cluster_id").select("query_id", "rank", "cluster_id", "p")


def inverse_distances(near: DataFrame) -> DataFrame:
    """(query_id, cluster_id, p) from (query_id, cluster_id, distance): shares by 1 / (distance + 0.001)."""
    w = near.withColumn("w", 1 / (F.col("distance") + 0.001))
    return w.select("query_id", "cluster_id", (F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).alias("p"))


def rerouted(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Those of ``queries`` of which fewer than ``k`` rows were found: a search over all lists is due for them."""
    full = saved(found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id"))
    return queries.join(full, "query_id", "left_anti")
