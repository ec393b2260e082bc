"""Column expressions on vectors (array<double>) and sparse vectors (map<string,double>)."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum
from itertools import combinations, islice

from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(Enum):
    EUCLIDEAN = "euclidean"
    COSINE = "cosine"


def parse_metric(name: str) -> Metric:
    """``euclidean``, ``l2`` or ``cosine``, in either case."""
    known = {"euclidean": Metric.EUCLIDEAN, "l2": Metric.EUCLIDEAN, "cosine": Metric.COSINE}
    if name.lower() not in known:
        raise ValueError(f"unknown metric {name!r}")
    return known[name.lower()]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; raises on a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.raise_error(F.lit("cosine distance of a zero vector")).cast("double")).otherwise(1 - dot(a, b) / n)


def cosine_similarity_safe(a: Column, b: Column) -> Column:
    """cos, and 0 where a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def distance(metric: Metric, a: Column, b: Column) -> Column:
    return l2(a, b) if metric is Metric.EUCLIDEAN else cosine_distance(a, b)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def check_dimension(a: Column, dim: int) -> Column:
    return F.when(F.size(a) != dim, F.raise_error(F.concat(F.lit(f"expected dimension {dim}, got "), F.size(a).cast("string"))).cast("array<double>")).otherwise(a)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def project(a: Column, rows: Sequence[Sequence[float]]) -> Column:
    """Products with fixed rows: a random projection."""
    return F.array(*[dot(a, literal(r)) for r in rows])


def bucket(a: Column, planes: Sequence[Sequence[float]]) -> Column:
    """Bit i is set if the product with plane i is positive."""
    out = F.lit(0)
    for i, p in enumerate(planes):
        out = out + F.when(dot(a, literal(p)) > 0, F.lit(1 << i)).otherwise(F.lit(0))
    return out.cast("int")


def probe_masks(bits: int, probes: int) -> list[int]:
    """0, then single bits, then pairs of bits, triples and so on, as many as ``probes``."""
    return list(islice((sum(1 << i for i in some) for n in range(bits + 1) for some in combinations(range(bits), n)), probes))


def locality(p: Column, q: Column, weights: Sequence[float]) -> Column:
    """Sum of w_i exp(-|p_i - q_i|) over projections."""
    terms = F.zip_with(p, q, lambda x, y: F.exp(-F.abs(x - y)))
    return dot(terms, literal(weights))


def entropy(distances: Column) -> Column:
    """-sum p ln p of the shares of the distances; 1 for none, 0 if they don't add up to more than 0."""
    s = total(distances)
    h = total(F.transform(distances, lambda d: F.when(d > 0, -(d / s) * F.ln(d / s)).otherwise(F.lit(0.0))))
    return F.when(F.size(distances) == 0, F.lit(1.0)).when(s <= 0, F.lit(0.0)).otherwise(h)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


# --- sparse vectors -------------------------------------------------------------------------------------------


def sparse_dot(a: Column, b: Column) -> Column:
    return total(F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0))))


def sparse_norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(F.map_values(a), lambda w: w * w)))


def sparse_cosine(a: Column, b: Column) -> Column:
    """cos; 0 if either is empty or null."""
    n = sparse_norm(a) * sparse_norm(b)
    return F.coalesce(F.when(n > 0, sparse_dot(a, b) / n), F.lit(0.0))


def sparse_distance(a: Column, b: Column) -> Column:
    """1 - cos within [-1, 1]; 1 if either is empty."""
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sparse_cosine(a, b)))


def weighted_mean(distances: Sequence[Column], weights: Sequence[float]) -> Column:
    """Mean over the distances that aren't null, their weights made to sum to 1; null if all are null."""
    above, below = F.lit(0.0), F.lit(0.0)
    for d, w in zip(distances, weights):
        above = above + F.coalesce(d * w, F.lit(0.0))
        below = below + F.when(d.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.when(below > 0, above / below)


# --- time -----------------------------------------------------------------------------------------------------


def combined_with_age(spatial: Column, seconds: Column, weight: float = 0.7, rate: float = 0.01) -> Column:
    """weight * spatial + (1 - weight) * (1 - exp(-|age| * rate))."""
    return F.lit(weight) * spatial + F.lit(1 - weight) * (1 - F.exp(-F.abs(seconds) * rate))


def within(d: Column, low: Column, high: Column) -> Column:
    """(d - low) / (high - low), clamped to [0, 1]; 0.5 without a range."""
    return F.when(high - low < 1e-10, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (d - low) / (high - low))))


def decay_daily(d: Column, seconds: Column, rate: float = 0.1) -> Column:
    return d * (2 - F.exp(-rate * seconds / 86400.0))


def decay_half_life(d: Column, seconds: Column, half: float = 86400.0) -> Column:
    """d * (2 - 2^(-age / half)); no change at age 0 or less."""
    return F.when(seconds <= 0, d).otherwise(d * (2 - F.pow(F.lit(2.0), -seconds / half)))


def squash(d: Column) -> Column:
    return d / (d + 1)
