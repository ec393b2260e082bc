"""Token counts by distinct pre-tokens, without ids.

Documents that lie together share a dictionary: it numbers their distinct pre-tokens, and for each document the codes of
its pre-tokens are kept with their frequencies, packed. The pre-tokens of all dictionaries, far fewer than the (document,
pre-token) pairs, are shuffled and sorted by pre-token, where each is counted once (one that is in more than SALTED
dictionaries once for as many). The counts are joined to the frequencies by dictionary and code, multiplied and summed
by document. Both shuffles carry plain rows; lists of places or counts would take three times the room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import piecewise, simple8b
from lodestone.plans.storage import ship, stored

BLOCK = 4_000_000  # characters of documents that are gone through at a time, about; a longer text is gone through alone
DICTIONARY = 300_000  # pre-tokens from which on a dictionary is closed
SALTED = 10_000  # rows of the frequencies' table for each salt: no more dictionaries than that share a key
BLOCKS = "dictionary long, doc_ids array<long>, n_bytes array<long>, sizes array<int>, n_codes long, packed binary, offsets binary, pre array<string>"


def frequencies(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = DICTIONARY) -> DataFrame:
    """Rows of packed frequencies for blocks of documents, and behind those of a dictionary one row with its pre-tokens (``pre``) and no documents.

    ``packed`` holds, document after document, the steps between the ascending codes of its pre-tokens, then as many
    frequencies; ``sizes`` tells how many there are. Dictionaries have a number that is theirs alone; it follows from
    how the rows lie, so the table is to be stored before it is used twice.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()))
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number, code = piecewise.word_pieces(tokenizer_path), TaskContext.get().partitionId() << 32, {}

        def row(*values) -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], k) for v, k in zip((number, *values), kinds)], names)

        for b in batches:
            texts, size = b.column(1).to_pylist(), pa.compute.binary_length(b.column(1))
            for i, j in piecewise.blocks(texts, block):
                sizes, codes, times = pieces.frequencies(texts[i:j], code)
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                steps = np.diff(codes, prepend=0)
                steps[first] = codes[first]
                words, offsets = simple8b.encode(np.concatenate((steps, times)).astype(np.uint64))
                yield row(b.column(0).slice(i, j - i).to_pylist(), size.slice(i, j - i).to_pylist(), sizes.tolist(), len(codes), words.astype("<u8").tobytes(), offsets.astype("<u4").tobytes(), [])
                if len(code) >= most:
                    yield row([], [], [], 0, b"", np.zeros(1, "<u4").tobytes(), list(code))
                    number, code = number + 1, {}
        if code:
            yield row([], [], [], 0, b"", np.zeros(1, "<u4").tobytes(), list(code))

    return rows.mapInArrow(run, BLOCKS)


def counted(pre_tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """(dictionary, code, n): the number of tokens of pre for each row of ``pre_tokens`` (pre, dictionary, code), sorted by pre: equal ones follow each other and are counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = piecewise.word_pieces(tokenizer_path).count
        last: tuple[str, int] = ("", 0)
        for b in batches:
            coded = b.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            n = [last[1] if x == last[0] else count(x) for x in distinct]
            if distinct:
                last = (distinct[-1], n[-1])
            yield pa.record_batch([b.column(1), b.column(2), pa.array(n, pa.int32()).take(coded.indices)], ["dictionary", "code", "n"])

    return pre_tokens.select("pre", "dictionary", "code").mapInArrow(run, "dictionary long, code int, n int")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = DICTIONARY, salted: int = SALTED) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null texts count as empty: no bytes, no tokens. Nothing is added, cut or padded; special tokens' strings inside a
    text count as one token each, as is the library's default. Null and repeated ids keep a row each; other columns
    don't matter. An empty table gives an empty result.
    """
    blocks = stored(frequencies(docs, tokenizer_path, id_col, text_col, block, most), "token-counts")
    salts = blocks.count() // salted + 1
    each = blocks.select("dictionary", F.pmod(F.xxhash64("dictionary"), F.lit(salts)).alias("salt"), F.posexplode("pre").alias("code", "pre"))
    found = counted(each.repartition("pre", "salt").sortWithinPartitions("pre"), tokenizer_path)

    def total(rows: pa.Table, counts: pa.Table) -> pa.Table:
        out = [pa.table({n: pa.array([], t) for n, t in zip(("doc_id", "n_bytes", "n_tokens", "over_limit"), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))})]
        tokens = np.zeros(counts.num_rows, np.int64)
        tokens[counts.column("code").to_numpy()] = counts.column("n").to_numpy()
        for row in rows.to_pylist():
            sizes, n = np.array(row["sizes"], np.int64), row["n_codes"]
            both = simple8b.decode(np.frombuffer(row["packed"], "<u8"), np.frombuffer(row["offsets"], "<u4").astype(np.int64), 2 * n).astype(np.int64)
            along, start = np.cumsum(both[:n]), np.cumsum(sizes) - sizes
            codes = along - np.repeat(np.concatenate(([0], along))[start], sizes)
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), both[n:] * tokens[codes], len(sizes)).astype(np.int64)
            out.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": sums, "over_limit": sums > limit}))
        return pa.concat_tables(out)

    return blocks.where(F.size("doc_ids") > 0).drop("pre").groupBy("dictionary").cogroup(found.groupBy("dictionary")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
