"""Changes to an index, statistics of shifts and sessions, and tuning rules."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V


def insert(data: DataFrame, new: DataFrame) -> DataFrame:
    """Both together; ids are expected to be new. ``upsert`` is for those that may be there."""
    return data.unionByName(new)


def delete(data: DataFrame, ids: DataFrame) -> tuple[DataFrame, bool]:
    """What is left, and whether anything went."""
    return data.join(ids.select("id"), "id", "left_anti"), data.join(ids.select("id"), "id", "left_semi").limit(1).count() > 0


def update(data: DataFrame, new: DataFrame) -> tuple[DataFrame, bool]:
    """Vectors replaced where the id is there already. Of several new vectors of one id the smallest by components counts."""
    fresh = new.groupBy("id").agg(F.min("vector").alias("_new"))
    out = data.join(fresh, "id", "left").withColumn("vector", F.coalesce("_new", "vector")).drop("_new").select(*data.columns)
    return out, data.join(fresh, "id", "left_semi").limit(1).count() > 0


def upsert(data: DataFrame, new: DataFrame) -> DataFrame:
    return data.join(new.select("id"), "id", "left_anti").select(*data.columns).unionByName(new.select(*data.columns))


# --- shifts ---------------------------------------------------------------------------------------------------


def shift_stats(data: DataFrame) -> DataFrame:
    """(pos, n, mean, m2): count, mean and sum of squared deviations of every dimension."""
    cells = data.select(F.posexplode("vector").alias("pos", "x"))
    return cells.groupBy("pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"))


def detect_shift(data: DataFrame, order: str = "id", window: int = 1000, threshold: float = 0.1, proper_variance: bool = False) -> DataFrame:
    """(n, moved, limit, shifted): whether the last ``window`` vectors lie further from the mean, on average, than sqrt(mean m2) * threshold.

    m2 is the sum of squared deviations; with ``proper_variance`` it is divided by the count.
    """
    stats = shift_stats(data)
    mean = stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("mu"), F.avg(F.col("m2") / F.col("n") if proper_variance else F.col("m2")).alias("m2"), F.max("n").alias("n"))  # one entry for each dimension
    recent = data.orderBy(F.col(order).desc()).limit(window)
    moved = recent.join(F.broadcast(mean)).agg(F.first("n").alias("n"), F.avg(V.l2(F.col("vector"), F.col("mu"))).alias("moved"), (F.sqrt(F.first("m2")) * threshold).alias("limit"))
    return moved.select("n", "moved", "limit", ((F.col("n") >= window) & (F.col("moved") > F.col("limit"))).alias("shifted"))


# --- sessions -------------------------------------------------------------------------------------------------


def hot_nodes(results: DataFrame, most: int = 100) -> DataFrame:
    """(session, id, hits, quality): of a session's results (session, id, rank from 1) the ids with most quality, sum of 1 / rank."""
    sums = results.groupBy("session", "id").agg(F.count("*").alias("hits"), F.sum(1 / F.col("rank")).alias("quality"))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.round("quality", 12).desc(), "id"))
    return sums.withColumn("place", place).where(F.col("place") <= most).drop("place")


def related(queries: DataFrame, back: int = 10, threshold: float = 0.85) -> DataFrame:
    """(session, seq, related_seq, similarity): for each query (session, seq, vector) the newest of the ``back`` before it that is alike enough."""
    past = queries.select("session", F.explode(F.transform(F.sequence(F.lit(1), F.lit(back)), lambda i: F.col("seq") + i)).alias("seq"), F.col("seq").alias("related_seq"), F.col("vector").alias("pv"))
    met = queries.join(past, ["session", "seq"]).withColumn("similarity", V.cosine_similarity_safe(F.col("vector"), F.col("pv"))).where(F.col("similarity") > threshold)
    place = F.row_number().over(Window.partitionBy("session", "seq").orderBy(F.col("related_seq").desc()))
    return met.withColumn("place", place).where("place = 1").select("session", "seq", "related_seq", "similarity")


def adaptive_ef(effort: Column, similarity: Column, any_hot: Column, base: int = 64, low: int = 16, high: int = 256) -> Column:
    """base by past effort, likeness to past queries and whether a hot node is at hand, within [low, high]."""
    difficulty = F.when(effort > 100, 1.3).when((effort > 0) & (effort < 30), 0.7).otherwise(1.0)
    relation = F.when(similarity > 0.8, 0.5).when(similarity > 0.6, 0.8).otherwise(1.0)
    hot = F.when(any_hot, 0.9).otherwise(1.0)
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.round(base * difficulty * relation * hot, 9)).cast("int")))


# --- tuning rules ---------------------------------------------------------------------------------------------


def estimated_recall(average: Column) -> Column:
    """A recall guessed from the average distance of a result."""
    return F.when(average < 0.5, 0.98).when(average < 1.0, 0.95).otherwise(0.90)


def precision(remaining: Column) -> Column:
    """The number format that the share of energy left allows."""
    return F.when(remaining < 0.3, "INT8").when(remaining < 0.6, "FP16").otherwise("FP32")


def fusion_weights(dense: Column, sparse: Column, audio: Column) -> Column:
    """Base weights of the modalities that are present, made to sum to 1."""
    base = [F.when(p, F.lit(w)).otherwise(F.lit(0.0)) for p, w in ((dense, 0.6), (sparse, 0.3), (audio, 0.1))]
    whole = base[0] + base[1] + base[2]
    return F.array(*[F.when(whole > 0, b / whole).otherwise(F.lit(0.0)) for b in base])


def universal_params(n: Column, dim: Column, target: Column) -> Column:
    """layers, m, ef_construction, ef, planes and entry points by size, dimension and recall wanted."""
    ef = F.when(n < 1000, 10).when(n < 10000, 50).otherwise(100) * F.when(target > 0.98, 2.0).when(target > 0.95, 1.5).otherwise(1.0)
    return F.struct(
        F.when(n < 1000, 1).when(n < 10000, 3).when(n < 100000, 5).otherwise(7).alias("layers"), F.when(n < 1000, 8).when(n < 10000, 16).otherwise(24).alias("m"),
        F.when(n < 1000, 50).when(n < 10000, 200).otherwise(400).alias("ef_construction"), F.floor(ef).cast("int").alias("ef"),
        F.when(dim < 64, 2).when(dim < 256, 3).otherwise(4).alias("planes"), F.when(n < 1000, F.least(n, F.lit(10))).when(n < 10000, F.lit(10)).otherwise(F.lit(20)).cast("int").alias("entry_points"))


@dataclass
class EnergyBudget:
    """What operations of each precision cost, and what is left."""

    total: float
    spent: float = 0.0
    costs: dict[str, float] = field(default_factory=lambda: {"FP32": 1.0, "FP16": 0.5, "INT8": 0.25, "BINARY": 0.1, "insert": 0.05})

    @property
    def remaining(self) -> float:
        return max(0.0, 1 - self.spent / self.total) if self.total > 0 else 0.0

    def spend(self, operation: str, times: int = 1) -> bool:
        """False, and nothing is spent, if it would cost more than is left."""
        cost = self.costs[operation] * times
        if self.spent + cost > self.total:
            return False
        self.spent += cost
        return True


@dataclass
class EfTuner:
    """Search effort for each kind of query, moved by a running estimate of recall."""

    low: int = 10
    high: int = 200
    target: float = 0.95
    by_kind: dict[str, int] = field(default_factory=dict)

    def ef(self, kind: str) -> int:
        return self.by_kind.get(kind, (self.low + self.high) // 2)

    def record(self, kind: str, recall: float) -> int:
        step = 10 if recall < self.target else -5
        self.by_kind[kind] = max(self.low, min(self.high, self.ef(kind) + step))
        return self.by_kind[kind]


@dataclass
class AdaptiveLsh:
    """Number of bits and probes by what earlier searches needed."""

    bits: int = 3
    bit_range: tuple[int, int] = (2, 8)
    probe_range: tuple[int, int] = (4, 16)
    history: list[int] = field(default_factory=list)

    def adjust_bits(self, average_bucket: float, wanted: float) -> int:
        low, high = self.bit_range
        self.bits = min(high, self.bits + 1) if average_bucket > 2 * wanted else max(low, self.bits - 1) if average_bucket < wanted / 2 else self.bits
        return self.bits

    def probes(self) -> int:
        low, high = self.probe_range
        return max(low, min(high, round(sum(self.history) / len(self.history)))) if self.history else (low + high) // 2


def adapt_threshold(threshold: float, density_is_high: bool) -> float:
    """An edge threshold moved by a tenth, within [0.1, 1]."""
    return max(0.1, min(1.0, threshold * (0.9 if density_is_high else 1.1)))


class ResultCache:
    """Result tables by a key of the query; the oldest tenth goes when it is full, all of it when the index changes."""

    def __init__(self, points: int) -> None:
        self.most, self.kept = max(1, math.isqrt(max(points, 1))), {}

    def get(self, key: int) -> DataFrame | None:
        return self.kept.get(key)

    def put(self, key: int, result: DataFrame) -> None:
        if len(self.kept) >= self.most:
            for old in list(self.kept)[: max(1, self.most // 10)]:
                del self.kept[old]
        self.kept[key] = result

    def invalidate(self) -> None:
        self.kept.clear()


def query_key(vector: Column, first: int = 8) -> Column:
    """A hash of the first components in thousandths, negative ones as 0."""
    return F.xxhash64(F.transform(F.slice(vector, 1, first), lambda x: F.greatest(x * 1000, F.lit(0.0)).cast("long")))


# Presets of the searches.
PRESETS = {
    "high_recall": {"n_probes": 12, "max_probes": 20, "m": 24, "ef_construction": 200, "ef": 100, "max_ef": 300, "edge_threshold": 0.7},
    "high_speed": {"n_probes": 4, "max_probes": 8, "m": 12, "ef_construction": 50, "ef": 30, "min_ef": 5, "max_ef": 100, "edge_threshold": 0.3, "degree": 16},
    "energy_efficient": {"n_probes": 4, "ef": 50, "confidence": 0.7}, "memory_efficient": {"n_probes": 4, "ef": 50, "m": 8},
    "fast": {"n_probes": 2, "ef": 10}, "accurate": {"n_probes": 16, "ef": 400},
}


def preset(name: str, **changes: float) -> dict[str, float]:
    """A preset with changes; values must be positive, a confidence at most 1."""
    out = PRESETS[name] | changes
    if any(v <= 0 for v in out.values()) or out.get("confidence", 1) > 1:
        raise ValueError(f"bad settings {out}")
    return out
