"""The queries op1 to op13 over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import token_files
    from lodestone.plans.storage import discarded_at_exit, fresh_path

    path = fresh_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    discarded_at_exit(spark, path)
    return token_files.read_token_files(spark, path, token_files.crc32, "ids_crc32 long")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import bpe

    return bpe.encode_with(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import secrets

    return secrets.digest(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.llm.anisotropic import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import chat

    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.parse_chats(chat.format_chats(turns)))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.spotsigs import edited_likeness

    return edited_likeness(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.llm import mixing
    from lodestone.plans.storage import saved

    docs = _table(spark, sf_dir, "documents")
    slim = saved(docs.select("doc_id", "lang", "source", mixing.word_count(F.col("text")).alias("n_tokens"), F.md5("text").alias("text")))
    out = mixing.mix(slim, mixing.document_levels(), mixing.WEIGHTS, tokens=F.col("n_tokens"))
    return out.select("doc_id", "domain", F.col("lang_").alias("lang"), F.col("source_").alias("source"), "n_tokens", "epoch")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.alignment import aligned

    return aligned(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash import minhash_groups

    return minhash_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash, "op2_secrets": op2_secrets, "op3_anisotropic": op3_anisotropic, "op4_token_files": op4_token_files,
    "op5_bpe": op5_bpe, "op6_chat": op6_chat, "op7_spotsigs": op7_spotsigs, "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts, "op10_mixing": op10_mixing,
    "op11_spelling": op11_spelling, "op12_alignment": op12_alignment, "op13_minhash": op13_minhash,
}
ORACLE_SQL: dict[str, str] = {
    "op6_chat": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), written AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS goes_on,
        replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), '</part>', '\p'), ': ', '\c') AS role_written,
        replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '</part>', '\p') AS text_written
    FROM turns
), digests AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listed,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length(text_written) + CASE WHEN goes_on THEN length('</part>') ELSE length('### ' || role_written || ': ' || '</turn>' || chr(10)) END) AS formatted_chars
    FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM digests
""",
}
