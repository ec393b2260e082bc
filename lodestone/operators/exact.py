"""Exact nearest neighbours, top-k and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.plans.storage import ship

BROADCAST_CELLS = 4_000_000  # components of queries that are sent to every task, at most
PART = 2048  # rows measured at once
SLICE, BLOCK = 65_536, 32_768  # rows and queries of a cell, at most about


class EmptyIndexError(ValueError):
    """A search over no vectors."""


class DimensionMismatchError(ValueError):
    """Vectors of different lengths."""


def top_k(scored: DataFrame, k: int, by: Column | str = "distance", partition: str = "query_id", tie: str = "id", rank: str = "rank") -> DataFrame:
    """The ``k`` smallest of each partition, ties to the smaller id, with their rank from 1."""
    if k <= 0:
        raise ValueError("the limit must be above 0")
    place = F.row_number().over(Window.partitionBy(partition).orderBy(F.col(by) if isinstance(by, str) else by, tie))
    return scored.withColumn(rank, place).where(F.col(rank) <= k)


def _distances(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if q.shape[1] != x.shape[1]:
        raise DimensionMismatchError(f"expected dimension {q.shape[1]}, got {x.shape[1]}")
    if metric is Metric.EUCLIDEAN:
        square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
        return np.sqrt(np.maximum(square, 0))
    nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    if not nq.all() or not nx.all():
        raise ValueError("cosine distance of a zero vector")
    return 1 - (q @ x.T) / (nq[:, None] * nx[None])


def _exact(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of q's rows to as many lists of x (queries x picks x dim), term by term."""
    if metric is Metric.EUCLIDEAN:
        return np.sqrt(((x - q[:, None]) ** 2).sum(-1))
    return 1 - (x * q[:, None]).sum(-1) / (np.linalg.norm(x, axis=-1) * np.linalg.norm(q, axis=-1)[:, None])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and len(flat) % len(column):
        raise DimensionMismatchError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def _best(metric: Metric, q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, scale: np.ndarray | None = None) -> pa.Table:
    """The best ``k`` of each query: picked by matrix products, then measured term by term; ``scale`` multiplies each row's distances."""
    scale = np.ones(len(x)) if scale is None else scale
    if len(x) > PART >= 4 * k and len(q):
        return _best_of_many(metric, q_id, q, ids, x, k, scale)
    out: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(q) if len(x) else 0, 64):
        mine = q[at : at + 64]
        near = _distances(metric, mine, x) * scale
        most = min(len(x), k + 16)  # the products' rounding can swap near-ties
        pick = np.argpartition(near, most - 1, 1)[:, :most] if most < len(x) else np.tile(np.arange(len(x)), (len(mine), 1))
        edge = np.take_along_axis(near, pick, 1).max(1)
        exact = _exact(metric, mine, x[pick]) * scale[pick]
        order = np.lexsort((ids[pick], exact), axis=1)[:, :k]
        got, d = np.take_along_axis(pick, order, 1), np.take_along_axis(exact, order, 1)
        for r in np.flatnonzero((near <= edge[:, None] + 1e-9).sum(1) > most):  # more ties than were picked
            all_ = np.flatnonzero(near[r] <= edge[r] + 1e-9)
            e = _exact(metric, mine[r : r + 1], x[all_][None])[0] * scale[all_]
            o = np.lexsort((ids[all_], e))[:k]
            got[r], d[r] = all_[o], e[o]
        out[0].append(np.repeat(q_id[at : at + 64], order.shape[1]))
        out[1].append(ids[got].ravel())
        out[2].append(d.ravel())
    cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "id": pa.array(cols[1].astype(np.int64)), "distance": pa.array(cols[2].astype(np.float64))})


def _best_of_many(metric: Metric, q_id: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, scale: np.ndarray) -> pa.Table:
    """What ``_best`` gives, from parts of ``x`` that fit a cache: after the first, only what is no further than a query's k-th so far is looked at."""
    out: list[pa.Table] = []
    margin = 1e-6 * (1 + max(np.abs(q).max(), np.abs(x).max())) * max(1.0, scale.max())  # the products' rounding, under a root
    for at in range(0, len(q), 128):
        mine = q[at : at + 128]
        first = _best(metric, np.arange(len(mine)), mine, np.arange(PART), x[:PART], k, scale[:PART])
        row, got, d = (first.column(c).to_numpy() for c in range(3))
        got = np.concatenate([g[np.lexsort((ids[g], e))] for g, e in zip(np.split(got, len(mine)), np.split(d, len(mine)))])
        d = d.copy()
        for start in range(PART, len(x), PART):
            near = _distances(metric, mine, x[start : start + PART]) * scale[start : start + PART]
            a, b = np.nonzero(near <= d.reshape(len(mine), k)[:, -1:] + margin)
            if len(a):
                b = b + start
                e = _exact(metric, mine[a], x[b][:, None])[:, 0] * scale[b]
                row, got, d = np.concatenate((row, a)), np.concatenate((got, b)), np.concatenate((d, e))
                order = np.lexsort((ids[got], d, row))
                row, got, d = row[order], got[order], d[order]
                n = np.bincount(row, minlength=len(mine))
                keep = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < k
                row, got, d = row[keep], got[keep], d[keep]
        out.append(pa.table({"query_id": pa.array(q_id[at : at + 128][row].astype(np.int64)), "id": pa.array(ids[got].astype(np.int64)), "distance": pa.array(d)}))
    return pa.concat_tables(out).combine_chunks()


def knn(data: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.EUCLIDEAN, scale: Column | float = 1.0) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest rows of ``data`` (id, vector) for each of ``queries`` (query_id, vector).

    Fewer rows than ``k`` give all of them; no rows give an empty result. Ties go to the smaller id. Rows without id or
    vector take no part. Vectors of another length, and zero vectors under cosine, raise. ``scale``, a column of ``data``,
    multiplies a row's distances before they are ranked.

    Few queries go to every task, which sends on its own best ``k``. Beyond BROADCAST_CELLS components queries and data
    meet in a grid of blocks of fixed size instead.
    """
    if k <= 0:
        raise ValueError("the limit must be above 0")
    spark = data.sparkSession
    ship(spark)
    data = data.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), (scale if isinstance(scale, Column) else F.lit(float(scale))).cast("double").alias("scale")).where("id is not null and vector is not null")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where("query_id is not null and vector is not null")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("cells")).first()
    schema = "query_id long, id long, distance double"
    if size.cells <= BROADCAST_CELLS:
        known = queries.toArrow()
        shared = spark.sparkContext.broadcast((known.column(0).to_numpy(), _matrix(known.column(1))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_id, q = shared.value
            for b in batches:
                if b.num_rows and len(q):
                    yield from _best(metric, q_id, q, b.column(0).to_numpy(), _matrix(b.column(1)), k, b.column(2).to_numpy()).to_batches()

        found = data.mapInArrow(scan, schema)
    else:
        n_slices = max(1, -(-data.count() // SLICE))
        # Where that makes few cells, queries are parted further, so that all cores have some.
        n_blocks = max(-(-size.n // BLOCK), min(-(-size.n // 1024), 2 * spark.sparkContext.defaultParallelism // n_slices))
        cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = data.select(cut("id", n_slices).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "id", "vector", "scale")
        right = queries.select(cut("query_id", n_blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"), "query_id", "vector")

        def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
            if not rows.num_rows or not asked.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
            return _best(metric, asked.column("query_id").to_numpy(), _matrix(asked.column("vector")), rows.column("id").to_numpy(), _matrix(rows.column("vector")), k, rows.column("scale").to_numpy())

        found = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(meet, schema)
    return top_k(found, k).select("query_id", "rank", "id", "distance")


def knn_one(data: DataFrame, query: list[float], k: int, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """(id, distance) of one query vector, nearest first."""
    from lodestone.functions.vectors import distance, literal

    if k <= 0:
        raise ValueError("the limit must be above 0")
    return data.select("id", distance(metric, F.col("vector"), literal(query)).alias("distance")).orderBy("distance", "id").limit(k)


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the first k true neighbours (or of all, if fewer) that were found."""
    want = truth.where(F.col("rank") <= k).select("query_id", "id").distinct()
    got = found.where(F.col("rank") <= k).select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return want.join(got, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def recall_summary(recall: DataFrame) -> DataFrame:
    return recall.agg(F.avg("recall").alias("avg_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"))
