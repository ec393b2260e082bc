"""Neighbour graphs as edge tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.vectors import Metric
from lodestone.operators.descent import EDGE, cells_of, descended, in_cells, sorted_rows
from lodestone.operators import exact
from lodestone.operators.exact import knn, top_k
from lodestone.operators.shortlist import rounded_distances, shortlisted
from lodestone.plans.storage import saved, ship
from lodestone.sources.vectors import load_index, save_index, unit_column

UPPER = 256  # vectors of an upper layer, at most


def layer(id_: Column, seed: int = 42, ml: float = 1 / math.log(2)) -> Column:
    """A vector's top layer: floor(-ln(u) * ml), with u from a hash of its id."""
    u = F.greatest(unit_column(id_, F.lit(0), seed), F.lit(1e-9))
    return F.floor(-F.ln(u) * ml).cast("int")


def knn_graph(data: DataFrame, k: int, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """(src, rank, dst, distance): the ``k`` nearest others of every vector, exactly; ids are unique. Work grows with the square of the number of vectors."""
    found = knn(data, data.select(F.col("id").alias("query_id"), "vector"), k + 1, metric).where("id != query_id")
    return top_k(found.drop("rank"), k).select(F.col("query_id").alias("src"), "rank", F.col("id").alias("dst"), "distance")


def local_entropy(edges: DataFrame) -> DataFrame:
    """(src, entropy) of each vector's distances to its neighbours."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("distance")).alias("ds")).select("src", V.entropy(F.col("ds")).alias("entropy"))


def adaptive_graph(edges: DataFrame, base: int = 16) -> DataFrame:
    """(src, dst): each vector keeps int(base * clamp(entropy / mean, 0.5, 2)) nearest neighbours; then both directions."""
    h = local_entropy(edges)
    mean = h.agg(F.avg("entropy").alias("mean"))
    degree = F.when(F.col("mean") > 0, F.floor(F.round(base * F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("entropy") / F.col("mean"))), 9))).otherwise(F.lit(base))
    degrees = h.join(F.broadcast(mean)).select("src", degree.alias("degree"))
    kept = edges.join(degrees, "src").where("rank <= degree").select("src", "dst")
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def nexus_rerank(data: DataFrame, queries: DataFrame, projection: Sequence[Sequence[float]], k: int, ratio: float = 2.0, metric: Metric = Metric.EUCLIDEAN, share: float = 0.0) -> DataFrame:
    """The best max(ratio * k, k) by projected distance, or ``share`` of all vectors if that is more, ranked exactly."""
    small = lambda df: df.withColumn("small", V.project(F.col("vector"), projection))
    most = max(int(ratio * k), k, math.ceil(share * data.count()) if share else 0)
    return shortlisted(small(data), small(queries), k, most, rounded_distances, metric)


def rng_prune(edges: DataFrame, data: DataFrame, m: int, factor: float = 0.95, share: float = 0.6) -> DataFrame:
    """(src, dst, distance): of each vector's neighbours up to ``m``, first those that no chosen one is nearer to, then the nearest."""
    ship(edges.sparkSession)
    first = int(share * m)

    def prune(edges: pa.Table, known: pa.Table) -> pa.Table:
        ids, vectors, _ = sorted_rows(known) if known.num_rows else (np.zeros(0, np.int64), None, None)
        src, dst, length = (edges.column(c).to_numpy() for c in ("src", "dst", "distance"))
        there = np.isin(dst, ids)
        src, dst, length = src[there], dst[there], length[there]
        order = np.lexsort((dst, length, src))
        src, dst, length = src[order], dst[order], length[order]
        at, edge = np.searchsorted(ids, dst), np.flatnonzero(np.diff(src, prepend=src[:1] - 1, append=src[-1:] + 1))
        kept = []
        for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
            x, d = vectors[at[start:end]], length[start:end]
            chosen: list[int] = []
            for i in range(len(d)):
                if len(chosen) >= first:
                    break
                if not chosen or not (np.linalg.norm(x[chosen] - x[i], axis=1) < factor * d[i]).any():
                    chosen.append(i)
            chosen += [i for i in range(len(d)) if i not in set(chosen)][: m - len(chosen)]
            kept += [start + i for i in sorted(chosen)]
        kept = np.array(kept, np.int64)
        return pa.table({"src": src[kept], "dst": dst[kept], "distance": length[kept]})

    return in_cells(edges.select("src", "dst", "distance"), "src", ["dst"], data.select("id", "vector"), cells_of(data.sparkSession, data.count()), prune, EDGE)


def zenith_params(dim: int, k: int) -> dict[str, float]:
    m = max(12, min(48, math.floor(1.5 * math.sqrt(dim) + 0.5)))
    return {"m": m, "ef_construction": 16 * m, "ml": 1 / math.log(m), "ef": min(max(10 * k, 6 * m), 800)}


def edge_prune(edges: DataFrame, most: float = 0.5, degree: int = 32, strategy: str = "combined") -> DataFrame:
    """Edges (src, dst, distance) that a strategy keeps. Distances count by the largest, at least 1.

    ``distance``: those within ``most``; ``degree``: the nearest ``degree`` of each vector; ``combined``: both;
    ``importance``: the most important ``degree`` of each, importance being 1 / (distance + 0.001), as far as it is above that of ``most``.
    """
    if strategy not in ("distance", "degree", "combined", "importance"):
        raise ValueError(f"unknown strategy {strategy!r}")
    near = edges
    if strategy != "degree":
        largest = edges.agg(F.greatest(F.max("distance"), F.lit(1.0)).alias("largest"))
        scaled = F.col("distance") / F.col("largest")
        kept = 1 / (scaled + 0.001) > F.lit(1 / (most + 0.001)) if strategy == "importance" else scaled <= most
        near = edges.join(F.broadcast(largest)).where(kept).drop("largest")  # one row
    return near if strategy == "distance" else top_k(near, degree, partition="src", tie="dst").drop("rank")


def expand(found: DataFrame, edges: DataFrame, now: int, half: float = 86400.0) -> DataFrame:
    """(query_id, id, distance): what was found and, by either direction of ``edges`` (src, dst, distance, ts), its neighbours with the decayed length of the edge."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance", "ts"))
    decayed = V.decay_half_life(F.col("length"), F.lit(now) - F.col("ts"), half)
    more = found.select("query_id", F.col("id").alias("src")).join(both.withColumnRenamed("distance", "length"), "src").select("query_id", F.col("dst").alias("id"), decayed.alias("distance"))
    new = more.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    return found.select("query_id", "id", "distance").unionByName(new)


def entry_points(data: DataFrame, n: int) -> DataFrame:
    """(place, id): ``n`` ids at even steps of the ids' order. Ids are numbered range by range, so no task sees all of them."""
    ranged = saved(data.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    step = max(1, ranged.count() // max(1, n))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    numbered = ranged.join(F.broadcast(starts), "part").select("id", place.alias("place"))
    return numbered.where((F.col("place") % step == 0) & (F.floor(F.col("place") / step) < n)).select((F.col("place") / step).cast("int").alias("place"), "id")


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst): every edge in either direction, once."""
    one = edges.select("src", "dst")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def top_layer(data: DataFrame, most: int = UPPER, seed: int = 42, ml: float = 1 / math.log(2)) -> DataFrame:
    """The vectors (id, vector) of the lowest layer that has at most ``most`` of them; of all layers if even the highest has more, its first by id."""
    # Not by ``layer``: it draws its numbers as the generator does, so it would pick generated vectors by their first component.
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31)) + 1) / float(1 << 31)
    layered = data.select("id", "vector", F.floor(-F.ln(u) * ml).cast("int").alias("layer"))
    sizes = {r.layer: r.n for r in layered.groupBy("layer").agg(F.count("*").alias("n")).collect()}  # a number for each layer
    at, above = max(sizes, default=0), 0
    for level in sorted(sizes, reverse=True):
        above += sizes[level]
        if above > most:
            break
        at = level
    upper = layered.where(F.col("layer") >= at).select("id", "vector")
    return upper if above <= most or at < max(sizes, default=0) or sizes.get(at, 0) <= most else upper.orderBy("id").limit(most)


def walk(data: DataFrame, edges: DataFrame, queries: DataFrame, starts: DataFrame, k: int, ef: int, rounds: int | None = None, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """(query_id, rank, id, distance): the best ``k`` that a walk along ``edges`` (src, dst) reaches from ``starts`` (query_id, id).

    All queries walk at once. In each round the ``ef`` best vectors so far of each query, as far as they are new, are
    joined to their edges and the edges' ends to their vectors; the walk of a query ends when a round brings nothing
    better, which it does after a finite number of them. ``rounds`` can end all walks earlier; they are not finished then.
    A round is a few joins over at most queries x ef x degree rows and is cut off by a checkpoint. Approximate: what the
    edges don't reach isn't found.
    """
    known, asked = data.select("id", "vector"), queries.select("query_id", F.col("vector").alias("qv"))
    # With few queries, as for ``knn``, vectors stay where they meet the pairs; Spark's own estimate of their size is that of the whole table.
    if asked.agg(F.coalesce(F.sum(F.size("qv")), F.lit(0)).alias("cells")).first().cells <= exact.BROADCAST_CELLS:
        asked = F.broadcast(asked)

    def measured(pairs: DataFrame) -> DataFrame:
        met = pairs.join(known, "id").join(asked, "query_id")
        return met.select("query_id", "id", V.distance(metric, F.col("qv"), F.col("vector")).alias("distance"), F.lit(True).alias("fresh"))

    beam = saved(top_k(measured(starts.select("query_id", "id").distinct()), ef).drop("rank"))
    turn = 0
    while turn != rounds and not (front := beam.where("fresh")).isEmpty():
        turn += 1
        ends = front.select("query_id", F.col("id").alias("src")).join(edges.select("src", "dst"), "src").select("query_id", F.col("dst").alias("id")).distinct()
        new = measured(ends.join(beam.select("query_id", "id"), ["query_id", "id"], "left_anti"))
        beam = saved(top_k(beam.withColumn("fresh", F.lit(False)).unionByName(new), ef).drop("rank"))
    return top_k(beam.drop("fresh"), k).select("query_id", "rank", "id", "distance")


@dataclass(frozen=True)
class GraphIndex:
    """Vectors, edges in either direction, and the few vectors of an upper layer where walks begin; built once, searched often."""

    data: DataFrame
    edges: DataFrame
    upper: DataFrame
    metric: Metric = Metric.EUCLIDEAN

    @classmethod
    def build(cls, data: DataFrame, m: int = 16, metric: Metric = Metric.EUCLIDEAN, pruned: bool = False, upper: int = UPPER, exact: bool = False) -> GraphIndex:
        """Edges to about the ``m`` nearest others of each vector, found by descent, or, ``pruned``, ``m`` of the 2m nearest chosen for their spread. ``exact`` takes the true nearest, by a join of all with all."""
        near = (knn_graph if exact else descended)(data, 2 * m if pruned else m, metric)
        kept = rng_prune(near, data, m) if pruned else near
        return cls(data.select("id", "vector"), saved(both_ways(kept)), saved(top_layer(data, upper)), metric)

    def search(self, queries: DataFrame, k: int, ef: int = 100, entries: int = 3, rounds: int | None = None) -> DataFrame:
        """A walk from the ``entries`` vectors of the upper layer that are nearest to each query."""
        starts = knn(self.upper, queries, entries, self.metric).select("query_id", "id")
        return walk(self.data, self.edges, queries, starts, k, max(ef, k), rounds, self.metric)

    def save(self, path: str) -> None:
        save_index({"data": self.data, "edges": self.edges, "upper": self.upper}, {"metric": self.metric.value}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphIndex:
        tables, meta = load_index(spark, path)
        return cls(tables["data"], tables["edges"], tables["upper"], Metric(meta["metric"]))


def tiered_search(data: DataFrame, queries: DataFrame, k: int, target: float = 0.96) -> DataFrame:
    """Parameters by the number of vectors: with fewer than 1,000 a scan of all, beyond that a walk over the graph that they set, or, where ``target`` asks for a recall of 1, a scan again."""
    from lodestone.operators.state import universal_params

    n = data.count()
    p = queries.sparkSession.range(1).select(universal_params(F.lit(n), F.lit(64), F.lit(target)).alias("p")).first().p
    if p.layers == 1 or target >= 1:  # no walk can promise all
        return knn(data, queries, k)
    return GraphIndex.build(data, p.m).search(queries, k, max(p.ef, 4 * k), p.entry_points)
