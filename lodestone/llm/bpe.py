"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary, by overlapping chunks.

Every text is cut into chunks of CHUNK code points that overlap by OVERLAP. Each chunk is pre-tokenised from its own
start, which may lie inside a pre-token. The pattern looks ahead but never behind, so once two neighbours share a
boundary in their overlap, they agree from there on: the stitching takes the left chunk's boundaries up to that one and
the right chunk's after it. Where an overlap holds no common boundary (a run longer than the overlap), the left chunk
is carried on from its last sure boundary over stretches that double, so a run of any length is gone through a fixed
number of times. Only then are the pieces between the boundaries encoded, each once. Decoding joins the tokens' bytes.

Chunks of a text lie beside each other in one task; those of a text of more than SPREAD chunks are dealt to several
tasks and meet for the stitching. The same functions do the work in both places.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import saved, ship

CHUNK = 1 << 12
OVERLAP = 1 << 8
SPREAD = 16  # chunks of one text, from which on they are dealt to several tasks
SURE = 8  # code points that the pattern looks at beyond a pre-token, a run of white space apart
KEPT_BYTES = 64 << 20  # of pieces and their ids that a worker remembers, about
LONG = 1 << 10  # pieces of more code points are never remembered


@cache
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The tiktoken encoding of a file of ranks; one for each worker process."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _compiled(pattern: str):
    return regex.compile(pattern)


@cache
def _stand_ins() -> tuple[dict[int, str], str]:
    """Characters that the library's version of Unicode takes for other kinds than ours does, each with one that ours takes for that kind; and the least of them."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    kinds, out = {r"\p{L}": "a", r"\p{N}": "1", r"\s": " "}, {}
    single = {bytes([i]): i for i in range(256)}
    theirs, ours = {}, {}
    for kind, example in kinds.items():
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(probe.decode_bytes(probe.encode_ordinary(every)).decode(), example)
        ours |= dict.fromkeys(regex.findall(kind, every), example)
    for c in {*theirs, *ours}:
        if theirs.get(c) != ours.get(c):
            out[ord(c)] = theirs.get(c, "!")
    return out, chr(min(out, default=0x10FFFF))


def chunk_ends(text: str, at: int, pattern: str) -> list[int]:
    """Where the pre-tokens of a chunk end that begins at ``at`` of its text, as places in the text.

    The pattern matches every character, has no groups, and tells letters, numbers and white space apart.
    """
    if not text.isascii():
        instead, least = _stand_ins()
        if max(text) >= least:
            text = text.translate(instead)
    return list(accumulate(map(len, _compiled(pattern).findall(text)), initial=at))[1:]


def _sure(text: str, start: int, stop: int) -> int:
    """The last place at which a boundary between ``start`` and ``stop`` can't change by what follows ``stop``."""
    return min(stop - SURE, start + len(text[start:stop].rstrip()))


def stitched(text: str, chunks: list[list[int]], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where the pre-tokens of ``text`` end, from those of its chunks (places in the text); chunk i begins at i * chunk."""
    out: list[int] = []
    start, stop, ends, i, more = 0, min(len(text), chunk + overlap), chunks[0], 1, 1
    while stop < len(text):
        at, right, sure = i * chunk, chunks[i], _sure(text, start, stop)
        left = {start, *ends[: bisect_right(ends, sure)]} if start >= at else set(ends[bisect_left(ends, at) : bisect_right(ends, sure)])
        common = next((p for p in (at, *right[: bisect_right(right, sure)]) if p in left), None)
        if common is not None:
            out += ends[: bisect_right(ends, common)]
            start, stop, ends, i, more = common, min(len(text), at + chunk + overlap), right[bisect_right(right, common) :], i + 1, 1
            continue
        keep = bisect_right(ends, sure)
        out += ends[:keep]
        start = ends[keep - 1] if keep else start
        stop, more = min(len(text), stop + more * chunk), more * 2
        ends = chunk_ends(text[start:stop], start, pattern)
        i = max(i, (stop - overlap) // chunk)
    return out + ends


def pre_tokens(text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where the pre-tokens of ``text`` end, by way of its chunks."""
    cuts = range(0, len(text), chunk)
    return stitched(text, [chunk_ends(text[at : at + chunk + overlap], at, pattern) for at in cuts], pattern, chunk, overlap) if cuts else []


class Pieces:
    """Ids of a text from where its pieces end; pieces that were seen before are remembered within KEPT_BYTES."""

    def __init__(self, enc: tiktoken.Encoding) -> None:
        self.enc, self.seen, self.held = enc, {}, 0

    def __call__(self, text: str, ends: list[int]) -> list[int]:
        out: list[int] = []
        seen, a = self.seen, 0
        for b in ends:
            x = text[a:b]
            a = b
            ids = seen.get(x)
            out += self._new(x) if ids is None else ids
        return out

    def _new(self, x: str) -> list[int]:
        ids = self.enc._encode_single_piece(x)
        if len(x) <= LONG:
            self.held += 200 + 4 * len(x) + 8 * len(ids)
            if self.held > KEPT_BYTES:
                self.seen.clear()
                self.held = 0
            self.seen[x] = ids
        return ids


def encode_with(docs: DataFrame, ranks_path: str, pattern: str, finish: Callable[[list[int], tiktoken.Encoding], tuple], schema: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """A row (doc_id, *finish(ids, encoding)) for each row of ``docs``; ``schema`` names what finish returns.

    Special strings in texts are ordinary text. A null text counts as empty and has no ids. Null and repeated ids keep
    a row each. Other columns don't matter. An empty table gives an empty result. A text's chunks, dealt out or not,
    come together again for its row, so a task holds one text and its ids at a time.
    """
    ship(docs.sparkSession)
    full = f"doc_id long, {schema}"
    names = [x.split()[0] for x in full.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    types = [f.dataType for f in docs.sparkSession.createDataFrame([], full).schema]

    def table(found: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        cols = list(zip(*found)) if found else [()] * len(names)
        return pa.record_batch([pa.array(c, to_arrow_type(t)) for c, t in zip(cols, types)], names)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        ids = Pieces(enc)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield table([(d, *finish(ids(t, pre_tokens(t, pattern, chunk, overlap)), enc)) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [np.array(chunk_ends(t, k * chunk, pattern), np.int64).tobytes() for t, k in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch([*b.columns, pa.array(ends, pa.binary())], ["row", "doc_id", "k", "text", "ends"])

    def stitch(group: pa.Table) -> pa.Table:
        enc = encoding(ranks_path, pattern)
        parts = sorted(group.to_pylist(), key=lambda r: r["k"])
        text = "".join(r["text"][:chunk] for r in parts)
        ends = stitched(text, [np.frombuffer(r["ends"], np.int64).tolist() for r in parts], pattern, chunk, overlap)
        return pa.Table.from_batches([table([(parts[0]["doc_id"], *finish(Pieces(enc)(text, ends), enc))])])

    many = F.char_length("text") > chunk * spread
    dealt = saved(rows.where(many).withColumn("row", F.monotonically_increasing_id()))  # a row's chunks need one number, whatever is computed again
    starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / chunk).cast("int"))
    parts = dealt.select("row", "doc_id", F.posexplode(F.transform(starts, lambda i: F.substring("text", i * chunk + 1, F.lit(chunk + overlap)))).alias("k", "text"))
    parts = parts.repartition("row", "k").mapInArrow(cut, "row long, doc_id long, k int, text string, ends binary")
    return rows.where(~many).mapInArrow(beside, full).unionByName(parts.groupBy("row").applyInArrow(stitch, full))


def encode(docs: DataFrame, ranks_path: str, pattern: str, **kw: Any) -> DataFrame:
    """(doc_id, ids array<int>) for each row; see ``encode_with``."""
    return encode_with(docs, ranks_path, pattern, lambda ids, _: (ids,), "ids array<int>", **kw)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the tokens' raw bytes, joined. Null ids give empty bytes."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([enc.decode_bytes(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digest(ids: list[int], enc: tiktoken.Encoding) -> tuple[int, str, str]:
    """n_tokens, sha256 of the decimal ids joined by commas, sha256 of the decoded bytes."""
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
