"""A corpus pipeline over the table documents: each stage works on what its predecessor kept.

Toxic documents go, then all but one document of each group of near copies; secrets in the texts are blotted out; sources
are mixed to target weights, for which documents can recur in several epochs; what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, secrets, toxicity
from lodestone.llm.simhash import simhash_groups
from lodestone.plans.storage import discard, discarded_at_exit, fresh_path, stored

#: Models, ordered budgets and BPE ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the one with the smallest doc_id, null after all others, then the smallest key.

    Groups are made over keys, a number for each row, so rows without doc_id and rows that share one are told apart. Any
    further columns stay as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed = stored(docs.toDF(*names).withColumn("key", F.monotonically_increasing_id()), "near-dedup")
    groups = simhash_groups(keyed.select("key", text), id_col="key", text_col=text).select(F.col("doc_id").alias("key"), "component_id")
    met = keyed.select("key", F.col(doc_id).alias("id")).join(groups, "key")
    order = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0)), "key")
    first = met.groupBy("component_id").agg(F.min_by("key", order).alias("key"))
    return keyed.join(first, "key", "left_semi").select(*names).toDF(*docs.columns)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; n_chars follows. No document goes."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture selects them, with as many words in all as there were, if the leaves have them."""
    return mixing.mix(docs, mixing.document_levels(), mixing.WEIGHTS).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document, under a byte-level BPE."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_with(docs, path, public_tokenizers.PATTERN, lambda ids, _: (len(ids), ids), "n_tokens long, ids array<int>")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", blot_secrets),
    ("mixing", mix_sources),
    ("bpe_encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again as the next one's input. A stage's folder goes once the next is written, the last one's with the session."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    discarded_at_exit(spark, before)
    return docs
