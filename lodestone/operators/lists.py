"""Inverted lists on disk: a table written by cluster, changes beside it, and searches that read only the lists they probe."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.operators import exact
from lodestone.operators.clustering import Centroids, as_table, assign, kmeans, plus_plus, route
from lodestone.operators.exact import _best, _matrix, top_k
from lodestone.operators.routing import CentroidGraph, graph_assign, graph_kmeans, graph_route
from lodestone.plans.storage import discard, saved, ship
from lodestone.sources.vectors import latest_version, read_meta, write_meta

STEP = 4096  # queries that meet a bucket at once
FOUND = "query_id long, id long, distance double"


def _merged(found: list[pa.Table], k: int) -> pa.Table:
    """The best ``k`` of each query among some lists of them."""
    table = pa.concat_tables(found)
    q, ids, d = (table.column(c).to_numpy() for c in ("query_id", "id", "distance"))
    order = np.lexsort((ids, d, q))
    q = q[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1])))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return table.take(pa.array(order[place < k]))


def _last(merged: pa.Table, q_id: np.ndarray, k: int) -> np.ndarray:
    """For each query the distance of its k-th in a merged table, infinite if there are fewer."""
    q, d = merged.column(0).to_numpy(), merged.column(2).to_numpy()
    keys, first, n = np.unique(q, return_index=True, return_counts=True)
    full = dict(zip(keys[n >= k].tolist(), d[first[n >= k] + k - 1].tolist()))
    return np.array([full.get(i, np.inf) for i in q_id.tolist()])


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``most`` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def probed(data: DataFrame, routes: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """(query_id, rank, id, distance): the best ``k`` of ``data`` (bucket, id, vector) among the buckets that ``routes`` (query_id, bucket) names for each of ``queries`` (query_id, vector).

    An id that lies in several probed buckets, or several times in one, counts with its least distance only if ``data``
    has it once; ids are unique. Few queries and routes (BROADCAST_CELLS numbers) go to every task, which sends on its
    own best ``k``. Beyond that rows and queries meet by bucket, in cells of at most about SLICE rows and BLOCK queries.
    """
    if k <= 0:
        raise ValueError("the limit must be above 0")
    spark = data.sparkSession
    ship(spark)
    data = data.select(F.col("bucket").cast("long").alias("bucket"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and vector is not null")
    routes = routes.select(F.col("query_id").cast("long").alias("query_id"), F.col("bucket").cast("long").alias("bucket"))
    size = queries.agg(F.coalesce(F.sum(F.size("vector") + 1), F.lit(0)).alias("cells")).first().cells
    if size <= exact.BROADCAST_CELLS and size + 2 * routes.count() <= exact.BROADCAST_CELLS:
        known, named = queries.toArrow(), routes.distinct().toArrow()
        q_id = known.column(0).to_numpy()
        order = np.argsort(q_id, kind="stable")
        row = order[np.searchsorted(q_id[order], named.column(0).to_numpy())] if len(q_id) else np.zeros(0, np.int64)
        bucket = named.column(1).to_numpy()
        by = np.lexsort((row, bucket))
        keys, first = np.unique(bucket[by], return_index=True)
        askers = dict(zip(keys.tolist(), np.split(row[by], first[1:]))) if len(keys) else {}
        shared = spark.sparkContext.broadcast((q_id, _matrix(known.column(1)), askers))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_id, q, askers = shared.value
            held: list[pa.Table] = []
            rows = 0
            last = np.full(len(q), np.inf)  # of each query's best so far the k-th
            for b in _gathered(batches, exact.SLICE):
                if not len(q):
                    continue
                bucket, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
                order = np.argsort(bucket, kind="stable")
                keys, first = np.unique(bucket[order], return_index=True)
                for key, mine in zip(keys.tolist(), np.split(order, first[1:])):
                    if (who := askers.get(key)) is not None:
                        for at in range(0, len(who), STEP):
                            some = who[at : at + STEP]
                            near = _best(metric, some, q[some], ids[mine], x[mine], k)  # by place
                            place, d = near.column(0).to_numpy(), near.column(2).to_numpy()
                            near = near.filter(pa.array(d <= last[place])).set_column(0, "query_id", pa.array(q_id[place[d <= last[place]]]))
                            if near.num_rows:
                                held.append(near)
                                rows += near.num_rows
                            if rows > k * len(q) + 4 * k * STEP:
                                held = [_merged(held, k)]
                                rows = held[0].num_rows
                                last = _last(held[0], q_id, k)
            if held:
                yield from _merged(held, k).to_batches()

        found = data.mapInArrow(scan, FOUND)
    else:
        sizes = data.groupBy("bucket").agg(F.count("*").alias("n")).join(routes.groupBy("bucket").agg(F.count("*").alias("m")), "bucket")
        cells = saved(sizes.select(F.bitwise_not("bucket").alias("other"), F.ceil(F.col("n") / exact.SLICE).cast("int").alias("slices"), F.ceil(F.col("m") / exact.BLOCK).cast("int").alias("blocks")))
        cut = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = data.withColumn("other", F.bitwise_not("bucket")).join(cells, "other").select("bucket", cut("id", "slices").alias("slice"), every("blocks").alias("block"), "id", "vector")
        asked = routes.withColumn("other", F.bitwise_not("bucket")).join(cells, "other").select("bucket", cut("query_id", "blocks").alias("block"), every("slices").alias("slice"), "query_id").join(queries, "query_id")

        def meet(rows: pa.Table, named: pa.Table) -> pa.Table:
            if not rows.num_rows or not named.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            return _best(metric, named.column("query_id").to_numpy(), _matrix(named.column("vector")), rows.column("id").to_numpy(), _matrix(rows.column("vector")), k)

        on = ("bucket", "slice", "block")
        found = left.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(meet, FOUND)
    return top_k(found, k).select("query_id", "rank", "id", "distance")


@dataclass(frozen=True)
class ListIndex:
    """A version of an index in a folder: centroids, a base table written by cluster, and segments of later changes.

    A segment has rows that were put in (``rows``, by cluster like the base) or ids that went (``gone``); its number
    tells what came later. What an id's last change says holds. Versions are never changed: every change writes new
    tables and then the next version's description, so a reader goes on with the version it opened, and what a writer
    that died left behind is not named by any version.
    """

    spark: SparkSession
    path: str
    centroids: Centroids
    metric: Metric = Metric.EUCLIDEAN
    version: int = 0
    named: str = "centroids-0"
    base: str = "base-0"
    segments: tuple[tuple[int, str], ...] = field(default=())  # number and "rows" or "gone"
    beam: int | None = None  # of a graph of centroids that vectors and queries are routed over; None: all centroids are compared

    @classmethod
    def build(cls, data: DataFrame, path: str, n_lists: int | None = None, iterations: int = 20, metric: Metric = Metric.EUCLIDEAN, centroids: Centroids | None = None, beam: int | None = None) -> ListIndex:
        """Writes ``data`` (id, vector) by its nearest of ``centroids``; without them, ceil(sqrt(n)) or ``n_lists`` are trained. Rows without id or vector are left out. With ``beam``, training, assignment and routing go over a graph of the centroids, which many thousands of them need."""
        rows = data.where("id is not null and vector is not null").select("id", "vector")
        if centroids is None and beam:
            centroids = graph_kmeans(rows, n_lists, iterations, metric, beam)
        elif centroids is None:
            centroids = kmeans(rows, plus_plus(rows, n_lists or ceil(sqrt(max(1, rows.count())))), iterations, metric, unit_length=metric is Metric.COSINE)
        index = cls(data.sparkSession, path, centroids, metric, beam=beam)
        index._put(rows, index.base)
        as_table(index.spark, centroids).write.mode("overwrite").parquet(f"{path}/{index.named}")
        return index._described()

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> ListIndex:
        """The newest version, or the one that is named."""
        meta = read_meta(spark, path, latest_version(spark, path) if version is None else version)
        centroids = [r.centroid for r in spark.read.parquet(f"{path}/{meta['centroids']}").orderBy("cluster_id").collect()]
        return cls(spark, path, centroids, Metric(meta["metric"]), meta["version"], meta["centroids"], meta["base"], tuple((n, kind) for n, kind in meta["segments"]), meta["beam"])

    def _described(self) -> ListIndex:
        write_meta(self.spark, self.path, self.version, {"version": self.version, "centroids": self.named, "base": self.base, "metric": self.metric.value, "segments": self.segments, "beam": self.beam})
        return self

    def _put(self, rows: DataFrame, name: str) -> None:
        """Rows go to their lists' folders; a list is written by as many tasks as AQE's partition size asks for, not by all."""
        listed = graph_assign(rows, CentroidGraph(self.centroids, self.metric), self.beam) if self.beam else assign(rows, self.centroids, self.metric).drop("centroid_distance")
        listed.hint("rebalance", F.col("cluster_id")).write.mode("overwrite").partitionBy("cluster_id").parquet(f"{self.path}/{name}")

    def _read(self, name: str, number: int) -> DataFrame:
        schema = "id long, vector array<double>, cluster_id int"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").withColumn("number", F.lit(number))

    def _next(self, kind: str) -> tuple[int, str]:
        return self.version + 1, f"{kind}-{self.version + 1}"

    def upsert(self, rows: DataFrame) -> ListIndex:
        """The next version, in which ``rows`` (id, vector) are new or take the place of those of their ids, in the lists of their own vectors."""
        number, name = self._next("rows")
        self._put(rows.where("id is not null and vector is not null").select("id", "vector").dropDuplicates(["id"]), name)
        return replace(self, version=number, segments=(*self.segments, (number, "rows")))._described()

    def delete(self, ids: DataFrame) -> ListIndex:
        """The next version, without ``ids`` (id); those that aren't there don't matter."""
        number, name = self._next("gone")
        ids.where("id is not null").select(F.col("id").cast("long").alias("id")).distinct().write.mode("overwrite").parquet(f"{self.path}/{name}")
        return replace(self, version=number, segments=(*self.segments, (number, "gone")))._described()

    def _changes(self) -> DataFrame | None:
        """(id, last): the number of each id's last change."""
        out = None
        for number, kind in self.segments:
            one = self.spark.read.parquet(f"{self.path}/{kind}-{number}").select("id", F.lit(number).alias("last"))
            out = one if out is None else out.unionByName(one)
        return out if out is None else out.groupBy("id").agg(F.max("last").alias("last"))

    def rows(self, wanted: DataFrame | None = None) -> DataFrame:
        """(id, vector, cluster_id): what is in the index; ``wanted`` (cluster_id, few) leaves lists out before they are read.

        The join to ``wanted`` is on the column that the folders are named by, so Spark prunes them when it runs. Only ids
        of changes are joined to what is left.
        """
        parts = [self._read(self.base, 0), *(self._read(f"rows-{n}", n) for n, kind in self.segments if kind == "rows")]
        if wanted is not None:
            parts = [p.join(F.broadcast(wanted), "cluster_id", "left_semi") for p in parts]  # at most a row for each centroid, which the driver holds
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        if (changes := self._changes()) is not None:
            every = every.join(changes, "id", "left").where("last is null or number >= last")
        return every.select("id", "vector", "cluster_id")

    def search(self, queries: DataFrame, k: int, n_probe: int = 10) -> DataFrame:
        """The best ``k`` among the vectors of the ``n_probe`` nearest lists of each query; other lists aren't read."""
        near = graph_route(queries, CentroidGraph(self.centroids, self.metric), n_probe, max(self.beam, n_probe)) if self.beam else route(queries, self.centroids, n_probe, self.metric)
        routes = saved(near.select("query_id", "probe", F.col("cluster_id").alias("bucket")))
        wanted = routes.where(F.col("probe") < n_probe).select(F.col("bucket").alias("cluster_id")).distinct()
        return probed(self.rows(wanted).withColumnRenamed("cluster_id", "bucket"), routes, queries, k, self.metric)

    def sizes(self) -> DataFrame:
        """(cluster_id, n) of the lists that hold anything."""
        return self.rows().groupBy("cluster_id").agg(F.count("*").alias("n"))

    def compact(self, retrain: bool = False, iterations: int = 20) -> ListIndex:
        """The next version, with all changes worked into a new base; ``retrain`` also trains as many centroids anew over what is there now."""
        number = self.version + 1
        live, new = self.rows().select("id", "vector"), replace(self, version=number, base=f"base-{number}", segments=())
        if retrain:
            live = saved(live)
            n = len(self.centroids)
            moved = graph_kmeans(live, n, iterations, self.metric, self.beam) if self.beam else kmeans(live, plus_plus(live, n), iterations, self.metric, unit_length=self.metric is Metric.COSINE)
            new = replace(new, centroids=moved, named=f"centroids-{number}")
            as_table(self.spark, moved).write.mode("overwrite").parquet(f"{self.path}/{new.named}")
        new._put(live, new.base)
        return new._described()

    def forget_before(self) -> None:
        """Deletes the tables that only earlier versions name; their readers must be done."""
        kept = {self.base, self.named, *(f"{kind}-{n}" for n, kind in self.segments)}
        for version in range(self.version):
            meta = read_meta(self.spark, self.path, version, missing_ok=True)
            if meta:
                for name in {meta["base"], meta["centroids"], *(f"{kind}-{n}" for n, kind in meta["segments"])} - kept:
                    discard(self.spark, f"{self.path}/{name}")
                discard(self.spark, f"{self.path}/version-{version}")
