"""Vectors from tables and from a generator; saved indexes, scenarios and reports."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRIME = 2147483647  # a generator's modulus
MULTIPLIER = 48271


def unit(i: int, j: int, seed: int) -> float:
    """A number in [0, 1) for a row, a position and a seed; the same arithmetic as ``unit_column``.

    The steps are quadratic: linear ones would leave all rows of a seed on one closed curve.
    """
    x = (i * 7919 + j * 104729 + seed * 15485863 + 1) % PRIME
    for _ in range(3):
        x = x * (x + MULTIPLIER) % PRIME
    return x / PRIME


def unit_column(i: Column, j: Column, seed: int) -> Column:
    x = (i.cast("long") * 7919 + j.cast("long") * 104729 + F.lit(seed * 15485863 + 1)) % PRIME
    for _ in range(3):
        x = x * (x + MULTIPLIER) % PRIME
    return x / F.lit(float(PRIME))


def unit_sql(i: str, j: str, seed: int) -> str:
    x = f"(({i})::BIGINT * 7919 + ({j})::BIGINT * 104729 + {seed * 15485863 + 1}) % {PRIME}"
    for _ in range(3):
        x = f"(({x}) * (({x}) + {MULTIPLIER})) % {PRIME}"
    return f"({x}) / {float(PRIME)}"


def rows(n: int, dim: int, seed: int, low: float = -1.0, high: float = 1.0, unit_length: bool = False) -> list[list[float]]:
    """Fixed vectors on the driver: planes and projections."""
    out = [[low + (high - low) * unit(i, j, seed) for j in range(dim)] for i in range(n)]
    if unit_length:
        out = [[x / (sum(y * y for y in r) ** 0.5 or 1.0) for x in r] for r in out]
    return out


def generate_uniform(spark: SparkSession, dim: int, count: int, low: float = -1.0, high: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, vector) with components in [low, high); the same for the same seed, however it is partitioned."""
    if dim < 1 or count < 0 or not low < high:
        raise ValueError("dim >= 1, count >= 0 and low < high are needed")
    positions = F.sequence(F.lit(0), F.lit(dim - 1))
    return spark.range(count).select("id", F.transform(positions, lambda j: F.lit(low) + (high - low) * unit_column(F.col("id"), j, seed)).alias("vector"))


def generate_queries(spark: SparkSession, dim: int, count: int, low: float = -1.0, high: float = 1.0, seed: int = 43) -> DataFrame:
    return generate_uniform(spark, dim, count, low, high, seed).withColumnRenamed("id", "query_id")


def read_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector array<double>) from Parquet; nothing else is read."""
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


def dataset_bytes(vectors: DataFrame) -> DataFrame:
    """Bytes of the components as 32-bit floats."""
    return vectors.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 4), F.lit(0)).alias("bytes"))


def save_index(tables: dict[str, DataFrame], meta: dict[str, Any], path: str) -> None:
    """Every table of an index as Parquet, and its settings as one JSON line; through Spark, so any store will do."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta.pop("tables")}, meta


def write_meta(spark: SparkSession, path: str, version: int, meta: dict[str, Any]) -> None:
    """Describes a version of what lies in ``path``. The folder gets its name once the line is written, so a reader sees all of it or nothing; a version that is there already raises."""
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/version-{version}")


def read_meta(spark: SparkSession, path: str, version: int, missing_ok: bool = False) -> dict[str, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-{version}/_SUCCESS")
    if missing_ok and not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {}
    return json.loads(spark.read.text(f"{path}/version-{version}").first().value)


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest number of a version whose description is complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    numbers = [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found or []]
    if not numbers:
        raise ValueError(f"no version of an index in {path}")
    return max(numbers)


def generate_clustered(spark: SparkSession, dim: int, count: int, clusters: int, spread: float = 0.1, seed: int = 42, first: int = 0) -> DataFrame:
    """(id, vector): vectors around ``clusters`` centres that are uniform in [-1, 1), each component off by up to ``spread``; rows ``first`` to ``first`` + ``count`` of an endless table."""
    if dim < 1 or count < 0 or clusters < 1:
        raise ValueError("dim >= 1, count >= 0 and clusters >= 1 are needed")
    positions = F.sequence(F.lit(0), F.lit(dim - 1))
    own = F.floor(unit_column(F.col("id"), F.lit(dim), seed + 1) * clusters)
    centre = lambda j: -1 + 2 * unit_column(own, j, seed)
    off = lambda j: spread * (2 * unit_column(F.col("id"), j, seed + 2) - 1)
    return spark.range(first, first + count).select("id", F.transform(positions, lambda j: centre(j) + off(j)).alias("vector"))


def export_testdata(vectors: DataFrame, queries: DataFrame, path: str, metadata: dict[str, Any]) -> None:
    """Data and queries as JSON lines, beside a line of metadata."""
    vectors.select("id", F.col("vector").alias("values")).write.mode("overwrite").json(f"{path}/dataset")
    queries.select("query_id", F.col("vector").alias("values")).write.mode("overwrite").json(f"{path}/queries")
    vectors.sparkSession.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


@dataclass(frozen=True)
class Scenario:
    name: str
    points: int
    dim: int
    queries: int
    k: int
    metric: str = "euclidean"
    seed: int = 42


# The four presets, in the sizes of their published figures and in those that the tools run.
PUBLISHED = (Scenario("smoke", 1_000, 32, 32, 5), Scenario("recall-baseline", 10_000, 64, 256, 20), Scenario("cosine-quality", 15_000, 128, 256, 25, "cosine"), Scenario("io-heavy", 50_000, 256, 512, 15))
PRESETS = (Scenario("smoke", 5_000, 64, 64, 10), Scenario("recall-baseline", 100_000, 128, 500, 50), Scenario("cosine-quality", 75_000, 256, 500, 50, "cosine"), Scenario("io-heavy", 500_000, 384, 1_000, 25))


def scenario(name: str, published: bool = False) -> Scenario:
    found = {s.name: s for s in (PUBLISHED if published else PRESETS)}
    if name not in found:
        raise ValueError(f"unknown scenario {name!r}; there are {sorted(found)}")
    return found[name]


def report(config: Scenario, build_ms: float, search_micros: float, recall: dict[str, float]) -> str:
    """The report of a run as JSON; without any time spent, queries per second are infinite."""
    qps = 1e6 / search_micros if search_micros > 0 else float("inf")
    return json.dumps({"config": asdict(config) | {"dataset_bytes": config.points * config.dim * 4}, "timings": {"build_ms": build_ms, "avg_search_micros": search_micros, "queries_per_second": qps}, "recall": recall})
