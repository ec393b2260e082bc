"""Maximum inner product search with score-aware (anisotropic) quantisation and four-bit tables.

A vector is cut into parts of two dimensions, each coded by one of 16 centres. Centres and codes minimise
|r|^2 + (weight - 1) (r . x / |x|)^2 of the residual r: the error along the vector itself, which moves the score of the
queries that matter, costs ``weight`` times as much as that across it. Every query makes tables of its products with the
centres; a scan sums table entries by the codes, and the best by these sums are scored again exactly. A vector's score can
differ from its sum by no more than |q| |r|: whatever could still be among the best by that bound is scored exactly too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.storage import saved, ship

SUB = 2
CENTRES = 16
WEIGHT = 4.0
SAMPLE = 20_000  # vectors that the centres are fitted on, at most
SLICE, BLOCK = 65_536, 16_384  # codes and queries compared in one task, at most about
RERANK = 8  # vectors of a slice scored exactly, for each neighbour wanted, or
SHARE = 0.01  # this part of the slice, if that is more


@dataclass
class Quantiser:
    centres: np.ndarray  # parts x 16 x 2, of vectors divided by scale
    weight: float
    scale: float = 1.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x / self.scale, -1e60, 1e60)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n x parts, uint8) of scaled vectors: nearest centres, then each part chosen anew given the others' parallel error."""
        parts = self._parts(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        gap = parts[:, :, None, :] - self.centres[None]
        square, along = (gap**2).sum(-1), np.einsum("npcd,npd->npc", gap, unit)
        code = square.argmin(-1)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(rounds):
            for p in range(parts.shape[1]):
                rest = total - along[rows, p, code[:, p]]
                code[:, p] = (square[:, p] + (self.weight - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(1)
                total = rest + along[rows, p, code[:, p]]
        return code.astype(np.uint8)

    def slack(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How far, for each unit of a query's length, the sum of table entries can be from the product with each of ``x`` (divided by scale): the residual's length, and the rounding of the tables and sums."""
        with np.errstate(over="ignore"):
            coded = self.centres[np.arange(len(self.centres)), code]
            rest = np.linalg.norm((self._parts(x) - coded).reshape(len(x), -1), axis=1)
            return rest * (1 + 1e-9) + 1e-5 * np.linalg.norm(coded.reshape(len(x), -1), axis=1) + 1e-30

    def _parts(self, x: np.ndarray) -> np.ndarray:
        width = self.centres.shape[0] * SUB
        return np.pad(x, ((0, 0), (0, width - x.shape[1]))).reshape(len(x), -1, SUB)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of queries, each divided by its largest component, with centres: parts x 16 x queries."""
        q = q / np.maximum(np.abs(q).max(1, keepdims=True), 1e-300)
        return np.einsum("qpd,pcd->pcq", self._parts(q), self.centres).astype(np.float32)


def packed(code: np.ndarray) -> np.ndarray:
    """Two four-bit codes in a byte; an odd last part stands alone."""
    if code.shape[1] % 2:
        code = np.pad(code, ((0, 0), (0, 1)))
    return code[:, ::2] | code[:, 1::2] << 4


def table_scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (candidates x queries) from packed codes: a lookup and a sum for each byte."""
    if len(tables) % 2:
        tables = np.concatenate((tables, np.zeros_like(tables[:1])))
    out = np.zeros((len(codes), tables.shape[2]), np.float32)
    for j in range(codes.shape[1]):
        pair = (tables[2 * j][None, :, :] + tables[2 * j + 1][:, None, :]).reshape(256, -1)
        out += pair[codes[:, j]]
    return out


def fit(x: np.ndarray, weight: float = WEIGHT, rounds: int = 6, seed: int = 5) -> Quantiser:
    """Centres for the sample ``x``: k-means by part, then codes and centres in turn under the anisotropic loss."""
    rng = np.random.default_rng(seed)
    parts = -(-x.shape[1] // SUB)
    q = Quantiser(np.zeros((parts, CENTRES, SUB)), weight, float(np.abs(x).max()))
    x = q.scaled(x)
    split = q._parts(x)
    unit = split / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
    for p in range(parts):
        c = split[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), p].copy()
        for _ in range(8):
            near = ((split[:, p, None] - c) ** 2).sum(-1).argmin(1)
            n = np.bincount(near, minlength=CENTRES)
            for d in range(SUB):
                c[:, d] = np.where(n > 0, np.bincount(near, split[:, p, d], CENTRES) / np.maximum(n, 1), c[:, d])
        q.centres[p] = c
    for _ in range(rounds):
        code = q.encode(x, 1)
        along = np.stack([((split[:, p] - q.centres[p][code[:, p]]) * unit[:, p]).sum(1) for p in range(parts)], 1)
        total = along.sum(1)
        for p in range(parts):
            rest, u = total - along[:, p], unit[:, p]
            pull = split[:, p] + (weight - 1) * u * (rest + (split[:, p] * u).sum(1))[:, None]
            for k in range(CENTRES):
                mine = code[:, p] == k
                if mine.any():
                    a = np.eye(SUB) * mine.sum() + (weight - 1) * u[mine].T @ u[mine]
                    q.centres[p, k] = np.linalg.solve(a, pull[mine].sum(0))
            new = ((split[:, p] - q.centres[p][code[:, p]]) * u).sum(1)
            total, along[:, p] = rest + new, new
    return q


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, v of floats where the table has floats, else of doubles. Those without id, null, empty, zero or with a null, infinite or NaN component don't."""
    floats = dict(vectors.dtypes)[vector_col] == "array<float>"
    v = F.col(vector_col) if floats else F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, rerank: int = RERANK, share: float = SHARE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for the rows of ``vectors`` that are queries, their ``k`` best found.

    Candidates are all usable rows but the query's own row; the score is the inner product of the vectors as given, in
    double precision; ties go to the smaller id. Equal vectors are one class, of which the k + 1 smallest ids stand in:
    no more of them can be wanted. ``is_query`` speaks of vec_id. All vectors must have one length, that of the first
    by id hash (others raise). Repeated rows count once; repeated ids with different vectors are separate candidates, each
    other's too, and as queries each has a ranking of its own. An empty table gives an empty result.

    Each class is coded once. Classes and queries meet in a grid of blocks of fixed size: every query is scanned against
    the codes of all classes, the best ``rerank`` * k + 1 or ``share`` of a slice are scored exactly, then all others whose
    sum and slack reach the score of the (k + 1)-th of these, and the best k + 1 go on, as numbers alone: the result is
    exact. What is shuffled is each vector once for each block of queries, in the table's type.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = saved(usable(vectors, id_col, vector_col))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, kind = len(some[0].v), dict(rows.dtypes)["v"]
    rows = rows.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit(f"all vectors must have {dim} components")).cast(kind)))
    quantiser = fit(np.array([r.v for r in some if len(r.v) == dim], np.float64))
    first = Window.partitionBy("v").orderBy("vec_id")
    standing = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = saved(standing.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("key"), "ids", "v"))
    queries = saved(rows.where(is_query).distinct().select(F.monotonically_increasing_id().alias("asked"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                codes = quantiser.encode(quantiser.scaled(x))
                yield pa.record_batch([*b.columns, pa.array([c.tobytes() for c in packed(codes)], pa.binary()), pa.array(quantiser.slack(x / quantiser.scale, codes))], ["key", "v", "least", "code", "slack"])

    n_queries = queries.count()
    n_slices = max(1, -(-classes.count() // SLICE))
    # Where that makes few cells, queries are parted further, so that more cores have some; what is found doesn't depend on the blocks.
    n_blocks = max(1, -(-n_queries // BLOCK), min(-(-n_queries // 64), min(64, spark.sparkContext.defaultParallelism) // n_slices))
    cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    coded = classes.select("key", "v", F.element_at("ids", 1).alias("least")).mapInArrow(code, f"key long, v {kind}, least long, code binary, slack double")
    left = coded.select(cut("key", n_slices).alias("slice"), every(n_blocks).alias("block"), "key", "v", "least", "code", "slack")
    right = queries.select(cut("asked", n_blocks).alias("block"), every(n_slices).alias("slice"), "asked", "q")

    def scan(cand: pa.Table, query: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if cand.num_rows and query.num_rows:
            codes = np.frombuffer(b"".join(cand.column("code").to_pylist()), np.uint8).reshape(cand.num_rows, -1)
            key, least, asked = (t.column(c).to_numpy() for t, c in ((cand, "key"), (cand, "least"), (query, "asked")))
            x, q = _matrix(cand.column("v")), _matrix(query.column("q"))
            slack = cand.column("slack").to_numpy()
            most = min(len(x), max(rerank * k + 1, ceil(share * len(x))))
            for at in range(0, len(q), 32):
                mine = q[at : at + 32]
                near = np.ascontiguousarray(table_scan(quantiser.tables(mine), codes).T)
                best = np.argpartition(-near, most - 1, 1)[:, :most] if most < len(x) else np.tile(np.arange(len(x)), (len(near), 1))
                exact = np.einsum("qmd,qd->qm", x[best], mine)
                for r, v in enumerate(mine):
                    few, score, largest = best[r], exact[r], np.abs(v).max()
                    if most < len(x):
                        floor = np.partition(score, -k - 1)[-k - 1] / largest / quantiser.scale
                        can = near[r] + np.linalg.norm(v / largest) * slack >= floor - 1e-9 * abs(floor) if np.isfinite(floor) else np.ones(len(x), bool)
                        can[few] = False
                        more = np.flatnonzero(can)
                        few, score = np.concatenate((few, more)), np.concatenate((score, np.einsum("md,d->m", x[more], v)))
                        few, score = (z[score >= np.partition(score, -k - 1)[-k - 1]] for z in (few, score))
                    order = np.lexsort((least[few], -score))[: k + 1]
                    got = few[order]
                    own = (x[got] == v).all(1)  # the class of the query's own vector
                    for o, c in zip(out, (np.repeat(asked[at + r], len(got)), key[got], least[got], score[order], own)):
                        o.append(c)
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("asked", "key", "least", "score", "own"), cols, (np.int64, np.int64, np.int64, np.float64, bool))})

    found = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(scan, "asked long, key long, least long, score double, own boolean")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "least"))
    short = found.withColumn("place", place).where(F.col("place") <= k + 1)
    met = short.join(classes.select("key", "ids"), "key").join(queries.select("asked", "query_id"), "asked")
    each = met.select("asked", "query_id", F.explode("ids").alias("vec_id"), "score", "own").where(~F.col("own") | (F.col("vec_id") != F.col("query_id")))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
