"""Token-id files: documents' ids as Simple-8b words, in ascending order of the documents.

A file is a Parquet file of pages; a page holds the ids of some whole documents: their doc_ids and numbers of ids,
the words, and the first word of each block of ids. Spark's own writer commits them, so a lost executor leaves no half
file, and any store that Spark writes to will do. Files, and pages in a file, are in ascending order (shard, page).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import piecewise, simple8b
from lodestone.plans.storage import ship

PAGE_IDS = 1 << 19
PAGES = "shard int, page int, n_ids long, doc_ids array<long>, sizes array<int>, words binary, offsets binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` to each, and write the files to the folder ``path``.

    Null texts count as empty and so give the end id alone. Documents are sorted by id (nulls first), those with the
    same id by their texts' hash and texts; each repeated row is written. Special tokens' strings inside texts become
    those tokens, as is the library's default. An empty table gives a folder without pages.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page = TaskContext.get().partitionId(), 0
        encode = piecewise.byte_level_ids(tokenizer_path)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            words, offsets = simple8b.encode(ids.astype(np.uint64))
            row = {"shard": shard, "page": page, "n_ids": len(ids), "doc_ids": [d for h in held for d in h[0]], "sizes": sizes.tolist(), "words": words.astype("<u8").tobytes(), "offsets": offsets.astype("<u4").tobytes()}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for b in batches:
            texts, doc_ids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for i, j in piecewise.blocks(texts):
                ids, sizes = encode(texts[i:j])
                ends = np.cumsum(sizes)
                held.append((doc_ids[i:j], sizes + 1, np.insert(ids, ends, end_id)))
                if sum(len(h[2]) for h in held) >= PAGE_IDS:
                    yield flush()
                    page += 1
        if held:
            yield flush()

    schema = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("offsets", pa.binary())])
    rows.select("doc_id", "text").mapInArrow(run, PAGES).write.parquet(path)


def page_starts(pages: DataFrame) -> DataFrame:
    """(shard, page, base): ids before each page. Sums run within shards, then over the shards, of which there are as many as files."""
    sizes = pages.select("shard", "page", "n_ids")
    before = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    shards = shards.select("shard", F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).join(shards, "shard").select("shard", "page", (F.col("first") + F.col("own")).alias("base"))


def read_token_files(spark: SparkSession, path: str, finish=None, schema: str = "ids array<long>") -> DataFrame:
    """(doc_id, start, n_tokens, *finish(ids)) of every document in the folder; by default the ids themselves.

    ``start`` counts the ids of all documents before it, ``ids`` hold the end id.
    """
    ship(spark)
    pages = spark.read.parquet(path)
    finish = finish or (lambda ids: (ids.tolist(),))
    full = f"shard int, page int, doc_id long, within long, n_tokens long, {schema}"
    names = [x.split()[0] for x in full.split(", ")]
    types = [f.dataType for f in spark.createDataFrame([], full).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            for k in range(b.num_rows):
                r = {n: b.column(n)[k] for n in b.schema.names}
                sizes = np.array(r["sizes"].as_py(), np.int64)
                ids = simple8b.decode(np.frombuffer(r["words"].as_buffer(), "<u8"), np.frombuffer(r["offsets"].as_buffer(), "<u4").astype(np.int64), r["n_ids"].as_py())
                ends = np.cumsum(sizes)
                got = [(r["shard"].as_py(), r["page"].as_py(), d, int(e - n), int(n), *finish(ids[e - n : e])) for d, e, n in zip(r["doc_ids"].as_py(), ends, sizes)]
                yield pa.record_batch([pa.array(c, to_arrow_type(t)) for c, t in zip(zip(*got), types)], names)

    found = pages.mapInArrow(run, full).join(page_starts(pages), ["shard", "page"])
    return found.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", *names[5:])


def crc32(ids: np.ndarray) -> tuple[int]:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
