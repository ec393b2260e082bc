"""Locality-sensitive hashing: buckets, probes and the searches built on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.vectors import Metric
from lodestone.operators.clustering import bucket_search
from lodestone.operators.exact import top_k
from lodestone.operators.shortlist import shortlisted
from lodestone.plans.storage import saved

Planes = Sequence[Sequence[float]]


def bucketed(data: DataFrame, planes: Planes) -> DataFrame:
    return data.withColumn("bucket", V.bucket(F.col("vector"), planes))


def probes(queries: DataFrame, planes: Planes, n: int) -> DataFrame:
    """(query_id, qv, bucket, probe): the query's bucket, then those one bit away, two bits and so on."""
    masks = F.array(*map(F.lit, V.probe_masks(len(planes), n)))
    own = V.bucket(F.col("vector"), planes)
    return queries.select("query_id", F.col("vector").alias("qv"), own.alias("own"), F.posexplode(masks).alias("probe", "mask")).select("query_id", "qv", F.col("own").bitwiseXOR(F.col("mask")).alias("bucket"), "probe")


def swift_search(data: DataFrame, queries: DataFrame, planes: Planes, k: int, n_probes: int = 4, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """The best of each probed bucket, merged: a bucket's best ``k`` are all that can count. May give fewer than k."""
    return bucket_search(bucketed(data, planes), probes(queries, planes, n_probes), k, metric)


def fusion_search(data: DataFrame, queries: DataFrame, planes: Planes, k: int, n_probes: int = 8, factor: float = 3.0, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """The best ``k`` of all probed buckets; with as many probes as there are buckets, of all rows.

    No bucket is left out early. That factor * k candidates lie within the k-th best distance so far, the sign to stop at
    otherwise, only comes of ties, and nearer vectors can lie in the buckets after it; so ``factor`` changes nothing.
    """
    from lodestone.operators.lists import probed

    asked = saved(queries.select("query_id", "vector").withColumn("turn", F.monotonically_increasing_id()))  # rows with the same query_id are asked each
    routes = probes(asked.select(F.col("turn").alias("query_id"), "vector"), planes, n_probes).select("query_id", "bucket")
    near = saved(probed(bucketed(data, planes), routes, asked.select(F.col("turn").alias("query_id"), "vector"), k, metric).select(F.col("query_id").alias("turn"), "id", "distance"))
    found = near.join(asked.select("turn", "query_id"), "turn")
    return top_k(found, k).select("query_id", "rank", "id", "distance")


def seer_probes(data: DataFrame, queries: DataFrame, planes: Planes, least: int = 50) -> DataFrame:
    """(query_id, qv, bucket): the query's bucket, and all one bit away if it holds fewer than ``least`` vectors."""
    sizes = bucketed(data, planes).groupBy("bucket").agg(F.count("*").alias("n"))
    own = queries.select("query_id", F.col("vector").alias("qv"), V.bucket(F.col("vector"), planes).alias("bucket")).join(sizes, "bucket", "left")
    masks = F.array(F.lit(0), *[F.lit(1 << i) for i in range(len(planes))])
    chosen = F.when(F.coalesce("n", F.lit(0)) < least, masks).otherwise(F.array(F.lit(0)))
    return own.select("query_id", "qv", F.explode(F.transform(chosen, lambda m: F.col("bucket").bitwiseXOR(m))).alias("bucket"))


def seer_search(data: DataFrame, queries: DataFrame, planes: Planes, weights: Sequence[float], k: int, share: float = 0.3, least: int = 50, metric: Metric = Metric.EUCLIDEAN, n_probes: int | None = None) -> DataFrame:
    """Candidates by buckets, the likeliest by projections, then exact. Keeps max(share * n, least, k) for the last step.

    Buckets are the first ``n_probes`` in probe order, or those of ``seer_probes`` if that is None.
    """
    marked = lambda df: df.withColumns({"pv": V.project(F.col("vector"), planes), "bucket": V.bucket(F.col("vector"), planes)})
    probed = (seer_probes(data, queries, planes, least) if n_probes is None else probes(queries, planes, n_probes)).select("query_id", "bucket")
    sizes = bucketed(data, planes).groupBy("bucket").agg(F.count("*").alias("size"))
    n = probed.join(sizes, "bucket").groupBy("query_id").agg(F.sum("size").alias("n"))
    several = probed.groupBy("query_id").agg(F.count("*").alias("probed"))
    masks = [V.probe_masks(len(planes), len(planes) + 1 if n_probes is None else n_probes), [0]]
    allowed = np.array([np.isin(np.arange(1 << len(planes)), m) for m in masks])
    w = np.array(weights)

    def rough(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        score = np.zeros((len(q), len(x)))
        for i, weight in enumerate(w):
            score += weight * np.exp(-np.abs(q[:, i][:, None] - x[:, i][None]))
        met = allowed[q[:, -1].astype(int)[:, None], q[:, -2].astype(int)[:, None] ^ x[:, -1].astype(int)[None]]
        return np.where(met, -np.round(score, 12), np.inf)

    alone = (F.col("probed") == 1).cast("double")
    asked = marked(queries).join(n, "query_id").join(several, "query_id").withColumns({"small": F.concat("pv", F.array(F.col("bucket").cast("double"), alone)), "most": F.greatest(F.floor(F.col("n") * share), F.lit(least), F.lit(k))})
    rows = marked(data).withColumn("small", F.concat("pv", F.array(F.col("bucket").cast("double"))))
    return shortlisted(rows, asked, k, None, rough, metric)


def train_weights(pairs: DataFrame, planes: Planes) -> list[float]:
    """Weights of projections from pairs (a, b): how well each one's difference agrees with the distance."""
    d = V.l2(F.col("a"), F.col("b"))
    squashed = V.squash(d)
    gaps = F.zip_with(V.project(F.col("a"), planes), V.project(F.col("b"), planes), lambda x, y: F.abs(x - y))
    agree = F.transform(gaps, lambda g: 1 - F.abs(squashed - g / (g + 1)))
    row = pairs.select(agree.alias("agree")).agg(*[F.sum(F.col("agree")[i]).alias(f"w{i}") for i in range(len(planes))]).first()
    total = sum(x or 0 for x in row)
    return [(x or 0) / total for x in row] if total > 0 else [1 / len(planes)] * len(planes)


def bucket_stats(data: DataFrame, planes: Planes) -> DataFrame:
    sizes = bucketed(data, planes).groupBy("bucket").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("non_empty"), F.max("n").alias("largest"), F.avg("n").alias("average"))


def lsh_neighbors(data: DataFrame, queries: DataFrame, planes: Planes, n_probes: int, most: int) -> DataFrame:
    """(query_id, id, place): the first ``most`` ids in probe order, then by id; not ranked by distance."""
    # A bucket's first most + 1 ids are all that can count, one of which may be the query's own.
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("id"))
    lists = bucketed(data, planes).where("id is not null").select("bucket", "id").distinct().withColumn("place", place).where(F.col("place") <= most + 1).drop("place")
    met = probes(queries, planes, n_probes).join(lists, "bucket").where("id != query_id")
    first = met.groupBy("query_id", "id").agg(F.min("probe").alias("probe"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("probe", "id"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("query_id", "id", "place")


def fallback_buckets(wanted: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """(bucket, options): the bucket itself if it holds anything, else its neighbours by number that do, else 0."""
    filled = F.broadcast(sizes.where("n > 0").agg(F.collect_set("bucket").alias("filled"))) if n <= 1 << 16 else sizes.where("n > 0").agg(F.collect_set("bucket").alias("filled"))
    near = lambda f: F.array_sort(F.filter(F.array(F.col("bucket") - 1, F.col("bucket") + 1), lambda x: F.array_contains(f, x)))
    own = F.when(F.array_contains("filled", F.col("bucket")), F.array("bucket")).when(F.size(near(F.col("filled"))) > 0, near(F.col("filled"))).otherwise(F.array(F.lit(0)))
    return wanted.join(filled).select("bucket", own.alias("options"))


def merge_candidates(sizes: DataFrame, least: int) -> DataFrame:
    """(bucket, n, target): for buckets smaller than ``least``, the smaller adjacent one (ties to the lower number)."""
    w = Window.orderBy("bucket")  # one row for each bucket of a fixed number of bits
    both = sizes.withColumn("pn", F.lag("n").over(w)).withColumn("p", F.lag("bucket").over(w)).withColumn("qn", F.lead("n").over(w)).withColumn("q", F.lead("bucket").over(w))
    target = F.when(F.col("q").isNull(), F.col("p")).when(F.col("p").isNull(), F.col("q")).when(F.col("pn") <= F.col("qn"), F.col("p")).otherwise(F.col("q"))
    return both.where(F.col("n") < least).select("bucket", "n", target.alias("target"))
