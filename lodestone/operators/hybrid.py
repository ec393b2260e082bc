"""Searches over several modalities and over time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.functions.vectors import Metric
from lodestone.operators.exact import top_k
from lodestone.plans.storage import saved, ship

MODAL_WEIGHTS = (0.6, 0.3, 0.1)  # dense, sparse, audio


def term_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, weight): how often each word, a run without ASCII white space, occurs in a text."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(F.col(id_col).alias("id"), F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))


def inverted_index(terms: DataFrame) -> DataFrame:
    """(term, n_docs, weight): the postings' sizes; ``terms`` itself, keyed by term, is the index."""
    return terms.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("weight").alias("weight"))


def sparse_products(terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, dot) of what shares a term; ``asked`` has (query_id, term, qweight)."""
    return asked.join(terms, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qweight")).alias("dot"))


def sparse_norms(terms: DataFrame) -> DataFrame:
    return terms.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def sparse_cosines(terms: DataFrame, asked: DataFrame) -> DataFrame:
    norms = sparse_norms(terms)
    q_norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qweight") * F.col("qweight"))).alias("qnorm"))
    return sparse_products(terms, asked).join(norms, "id").join(q_norms, "query_id").select("query_id", "id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))


def hybrid_search(data: DataFrame, terms: DataFrame, queries: DataFrame, asked: DataFrame, k: int, dense_weight: float = 0.6, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """Documents that share a term with the query (all, if none does), scored by distance and product, each scaled to [0, 1] within the query's candidates."""
    known = terms.join(data.select("id"), "id", "left_semi")  # what has no vector is no candidate
    products = sparse_products(known, asked)
    any_term = asked.join(terms.select("term").distinct(), "term", "left_semi").select("query_id").distinct()
    alone = queries.join(any_term, "query_id", "left_anti")
    every = alone.join(data.select("id")).select("query_id", "id", F.lit(0.0).alias("dot"))
    met = products.unionByName(every).join(data.select("id", "vector"), "id").join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
    scored = met.select("query_id", "id", V.distance(metric, F.col("qv"), F.col("vector")).alias("d"), "dot")
    w = Window.partitionBy("query_id")
    near = 1 - V.within(F.col("d"), F.min("d").over(w), F.max("d").over(w))
    like = V.within(F.col("dot"), F.min("dot").over(w), F.max("dot").over(w))
    fused = scored.select("query_id", "id", F.round(1 - (dense_weight * near + (1 - dense_weight) * like), 12).alias("distance"))
    return top_k(fused, k).select("query_id", "rank", "id", "distance")


def dense_first(data: DataFrame, terms: DataFrame, queries: DataFrame, asked: DataFrame, k: int, weight: float = 0.6, routes: DataFrame | None = None) -> DataFrame:
    """The 3k nearest by vector, ranked by w * d / (d + 1) + (1 - w) * (1 - cos of the terms).

    With ``routes`` (query_id, bucket), only those of ``data`` (id, vector, bucket) in the query's buckets. Cosines are
    taken of these pairs alone.
    """
    from lodestone.operators.exact import knn
    from lodestone.operators.lists import probed

    near = saved((knn(data, queries, 3 * k) if routes is None else probed(data, routes, queries, 3 * k)).drop("rank"))
    norms = sparse_norms(terms.join(near.select("id").distinct(), "id", "left_semi"))
    q_norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qweight") * F.col("qweight"))).alias("qnorm"))
    dots = near.select("query_id", "id").join(terms, "id").join(asked, ["query_id", "term"]).groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("qweight")).alias("dot"))
    cos = dots.join(norms, "id").join(q_norms, "query_id").select("query_id", "id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))
    ranked = near.join(cos, ["query_id", "id"], "left").select("query_id", "id", (F.round(weight * V.squash(F.col("distance")) + (1 - weight) * (1 - F.coalesce("cosine", F.lit(0.0))), 12) + F.lit(0.0)).alias("distance"))
    return top_k(ranked, k).select("query_id", "rank", "id", "distance")


def ranked_with_terms(near: DataFrame, each: DataFrame, asked: DataFrame, k: int, weight: float = 0.6) -> DataFrame:
    """What ``dense_first`` makes of its nearest: ``near`` (query_id, id, distance) ranked by distance and terms. ``each`` (id, terms, weights) has the words of rows, ``asked`` those of queries, ids unique.

    Words stay beside each other in their document's row, so a pair is one row of two joins, however many words it has.
    """
    ship(near.sparkSession)
    asked = asked.select(F.col("id").alias("query_id"), F.col("terms").alias("qterms"), F.col("weights").alias("qweights"))
    pairs = near.select("query_id", "id", "distance").join(each.select("id", "terms", "weights"), "id", "left").join(asked, "query_id", "left")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = []
            for terms, weights, qterms, qweights in zip(*(b.column(i).to_pylist() for i in range(3, 7))):
                known = dict(zip(qterms or [], qweights or []))
                dot = sum(w * known[t] for t, w in zip(terms or [], weights or []) if t in known)
                cosine.append(dot / (math.sqrt(sum(w * w for w in weights)) * math.sqrt(sum(w * w for w in qweights))) if dot else 0.0)
            yield pa.record_batch([*b.columns[:3], pa.array(cosine, pa.float64())], ["query_id", "id", "distance", "cosine"])

    order = ("query_id", "id", "distance", "terms", "weights", "qterms", "qweights")
    scored = pairs.select(*order).mapInArrow(meet, "query_id long, id long, distance double, cosine double")
    ranked = scored.select("query_id", "id", (F.round(weight * V.squash(F.col("distance")) + (1 - weight) * (1 - F.col("cosine")), 12) + F.lit(0.0)).alias("distance"))
    return top_k(ranked, k).select("query_id", "rank", "id", "distance")


def multimodal_distance(prefix_a: str, prefix_b: str, weights: tuple[float, float, float] = MODAL_WEIGHTS, metric: Metric = Metric.EUCLIDEAN) -> Column:
    """Weighted mean over the modalities (_dense, _sparse, _audio) that both sides have; null if they share none."""
    parts = []
    for name, measure in (("dense", lambda a, b: V.distance(metric, a, b)), ("sparse", V.sparse_distance), ("audio", lambda a, b: V.distance(metric, a, b))):
        a, b = F.col(f"{prefix_a}_{name}"), F.col(f"{prefix_b}_{name}")
        parts.append(F.when(a.isNotNull() & b.isNotNull(), measure(a, b)))
    return V.weighted_mean(parts, weights)


def multimodal_search(data: DataFrame, queries: DataFrame, k: int, weights: tuple[float, float, float] = MODAL_WEIGHTS) -> DataFrame:
    """Exact search by ``multimodal_distance``; ``data`` has (id, dense, sparse, audio), queries (query_id, ...). What shares no modality is left out."""
    a = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in ("dense", "sparse", "audio")])
    b = data.select("id", *[F.col(c).alias(f"d_{c}") for c in ("dense", "sparse", "audio")])
    met = b.join(a).select("query_id", "id", F.round(multimodal_distance("q", "d", weights), 12).alias("distance")).where("distance is not null")
    return top_k(met, k).select("query_id", "rank", "id", "distance")


def candidate_union(dense: DataFrame, audio: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Dense candidates, then audio ones, then sparse ones at 0.5; the first list that has an id gives its distance; the best ``k``."""
    lists = [df.select("query_id", "id", d.alias("distance"), F.lit(i).alias("list")) for i, (df, d) in enumerate(((dense, F.col("distance")), (audio, F.col("distance")), (sparse, F.lit(0.5))))]
    once = lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("query_id", "id").agg(F.min_by("distance", "list").alias("distance"))
    return top_k(once, k).select("query_id", "rank", "id", "distance")


def lim_search(data: DataFrame, queries: DataFrame, k: int, now: int, weight: float = 0.7, rate: float = 0.01, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """Distance in space, scaled to the range of distances to the mean of all vectors, combined with age; ``data`` has ts (seconds)."""
    n = data.select(F.size("vector").alias("n")).first()
    if n is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance double")
    mean = data.agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(n.n)]).alias("mean"))
    span = data.join(F.broadcast(mean)).select(V.distance(metric, F.col("vector"), F.col("mean")).alias("d")).agg(F.min("d").alias("low"), F.max("d").alias("high"))
    met = data.join(F.broadcast(span)).join(queries.select("query_id", F.col("vector").alias("qv")))
    d = V.within(V.distance(metric, F.col("qv"), F.col("vector")), F.col("low"), F.col("high"))
    scored = met.select("query_id", "id", F.round(V.combined_with_age(d, F.lit(now) - F.col("ts"), weight, rate), 12).alias("distance"))
    return top_k(scored, k).select("query_id", "rank", "id", "distance")


def decayed(found: DataFrame, times: DataFrame, now: int, rate: float = 0.1) -> DataFrame:
    """Results ranked anew after their distances have been decayed by age."""
    old = found.drop("rank").join(times.select("id", "ts"), "id").select("query_id", "id", F.round(V.decay_daily(F.col("distance"), F.lit(now) - F.col("ts"), rate), 12).alias("distance"))
    return top_k(old, 1 << 30).select("query_id", "rank", "id", "distance")


def decayed_knn(data: DataFrame, queries: DataFrame, k: int, now: int, half: float = 86400.0, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """The ``k`` nearest by the distance that age has decayed, over all of ``data`` (id, vector, ts): decay comes before the cut."""
    from lodestone.operators.exact import knn

    return knn(data, queries, k, metric, V.decay_half_life(F.lit(1.0), F.lit(now) - F.col("ts"), half))


def combine(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """(id, score): the weighted mean of several strategies' distances over the strategies that found the id."""
    union = None
    for df, w in parts:
        one = df.select("query_id", "id", (F.col("distance") * w).alias("wd"), F.lit(w).alias("w"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("query_id", "id").agg((F.sum("wd") / F.count("*")).alias("score"))
