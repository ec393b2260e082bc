"""Alignment of two tokenizers: minimal groups of overlapping tokens, the links within them, and corpus-wide link counts.

Tokens of A and B over the same bytes are the two sides of a graph, with an edge where two tokens overlap. Its connected
components, found by union-find, are the minimal groups: they end exactly where tokens of both sides end. Links are all
A-B pairs of a component's members.

Either tokenizer starts afresh at a single space between two characters that aren't white space, so a text is cut there
and each distinct piece is encoded, aligned and expanded once for as long as a worker remembers it. Documents that lie
together share a dictionary of the id pairs in them. The pairs of all dictionaries are shuffled and summed by pair; the
counts come back by dictionary and meet the documents' pair frequencies, which stay packed.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import piecewise, simple8b
from lodestone.plans.storage import ship, stored

BLOCK = 1_000_000  # characters of documents that are gone through at a time, about; a longer text is gone through alone
DICTIONARY, PACKED = 300_000, 32 << 20  # id pairs, or bytes of packed frequencies and documents, from which on a dictionary is closed
KEPT_BYTES = 160 << 20  # of pieces and what is known of them, in a worker, about
AT_ONCE = 1 << 16  # characters of new pieces that are aligned at a time, about
RUN = 200  # new pieces that are encoded as one text
LINKS_AT_ONCE = 1 << 21  # links that are expanded at a time, about
CUT = re.compile(r"(?<=\S) (?=\S)")


def components(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of every A and every B token, numbered from 0 along the text; both sides cover the same bytes.

    Union: two tokens overlap if and only if the one that starts later (B, if both start together) starts within the
    other, so every edge of the graph is one token's link to an earlier one. Find: links are halved until all point to
    a root.
    """
    n, m = len(a_end), len(b_end)
    a_start, b_start = np.concatenate(([0], a_end[:-1])), np.concatenate(([0], b_end[:-1]))
    over = np.searchsorted(b_start, a_start, "right") - 1  # the B token in which an A token starts
    parent = np.arange(n + m)
    parent[:n] = np.where(b_start[over] < a_start, n + over, parent[:n])
    parent[n:] = np.searchsorted(a_start, b_start, "right") - 1
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    _, group = np.unique(parent, return_inverse=True)  # a root is the A token at which its component starts
    return group[:n], group[n:]


def expanded(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, times) of all links, summed by owner and pair and sorted by them; ``owner`` has the owner of each group. A pair is A's id * 2^32 + B's id.

    Equal ids of one side of a group are taken together before the sides are multiplied, so a long group of a few
    different ids gives few rows. Groups are gone through LINKS_AT_ONCE links at a time.
    """
    sides = []
    for ids, group in ((a_ids, a_group), (b_ids, b_group)):
        key, times = np.unique(group << 32 | ids, return_counts=True)
        sides.append((key >> 32, key & 0xFFFFFFFF, times, np.bincount(key >> 32, minlength=len(owner))))
    (ga, a, ta, _), (_, b, tb, nb) = sides
    first_b = np.cumsum(nb) - nb
    rows = np.cumsum(nb[ga])
    out: list[tuple[np.ndarray, ...]] = []
    start = 0
    while start < len(ga):
        stop = max(start + 1, int(np.searchsorted(rows, (rows[start - 1] if start else 0) + LINKS_AT_ONCE, "right")))
        n = nb[ga[start:stop]]
        left = np.repeat(np.arange(start, stop), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first_b[ga[left]]
        out.append(_summed(owner[ga[left]], a[left] << 32 | b[right], ta[left] * tb[right]))
        start = stop
    return out[0] if len(out) == 1 else _summed(*(np.concatenate(x) for x in zip(*out))) if out else (np.zeros(0, np.int64),) * 3


def _summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, owner))
    owner, pair = owner[order], pair[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[edge], pair[edge], np.add.reduceat(times[order], edge) if len(edge) else times[:0]


class Aligner:
    """What two tokenizers make of pieces, remembered in flat arrays within KEPT_BYTES.

    Piece k has ``sums[:, k]`` (tokens of A, tokens of B, groups, links), its groups as text, and the pairs of its links,
    ``count[k]`` of them from ``first[k]`` on, each linked ``times`` times. A piece whose tokens don't give back its
    bytes has no tokens.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.rules = piecewise.byte_level_ids(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        code = {c: b for b, c in piecewise.byte_chars().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(code[c] for c in t) if all(c in code for c in t) else b""
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a_length, self.b_length = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{mark}" for i in range(most) for mark in (",", "|", ";")]
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.held = 0
        self._sums, self._count, self._pairs, self._times = (array("q") for _ in range(4))

    def _plain(self, piece: str) -> bool:
        """Whether ``piece`` can go to A's model without its pre-tokeniser."""
        return bool(piece) and self.rules.apart and max(piece) < piecewise.PLAIN and self.rules._plain(piece)

    def _ids(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``pieces``, each after a space, in runs of RUN; None if either side's tokens don't give back their bytes."""
        runs = [" " + " ".join(pieces[i : i + RUN]) for i in range(0, len(pieces), RUN)]
        if plain:
            a = [t.id for r in runs for t in self.a.model.tokenize(r.encode().decode("latin-1").translate(self.rules.chars))]
        else:
            a = [i for e in self.a.encode_batch_fast(runs, add_special_tokens=False) for i in e.ids]
        b = [i for ids in self.b.encode([r[1:] for r in runs], num_threads=1) for i in ids]
        want = "".join(runs).encode()
        if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def _learn(self, pieces: list[str], plain: bool = False) -> None:
        """Encodes and aligns ``pieces`` together; one by one if that doesn't give back their bytes."""
        ids = self._ids(pieces, plain)
        if ids is None and len(pieces) > 1:
            for p in pieces:
                self._learn([p])
            return
        k = len(self.groups)
        self.at.update(zip(pieces, range(k, k + len(pieces))))
        if ids is None:
            self.groups.append("")
            self._sums.frombytes(np.zeros(4, np.int64).tobytes())
            self._count.append(0)
            return
        a, b = ids
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        a_group, b_group = components(a_end, b_end)
        n_groups = int(a_group[-1]) + 1
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        last = a_group[np.searchsorted(a_end, ends)]  # a piece ends where tokens of both sides do
        size = np.diff(last, prepend=-1)
        owner = np.repeat(np.arange(len(pieces)), size)
        na, nb = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        # A's tokens of a group, then B's; behind each a comma, behind A's last a bar, behind B's last a semicolon.
        mark = np.concatenate((np.where(np.diff(a_group, append=n_groups) > 0, 1, 0), np.where(np.diff(b_group, append=n_groups) > 0, 2, 0)))
        order = np.argsort(np.concatenate((a_group * 2, b_group * 2 + 1)), kind="stable")
        written = [self.written[x] for x in (np.concatenate((a, b)) * 3 + mark)[order].tolist()]
        stop = np.cumsum(na + nb)[last].tolist()
        texts = ["".join(written[i:j]) for i, j in zip([0, *stop[:-1]], stop)]
        mine, pair, times = expanded(a, b, a_group, b_group, owner)
        total = lambda x: np.bincount(owner, x, len(pieces)).astype(np.int64)
        self.groups += texts
        self._sums.frombytes(np.stack((total(na), total(nb), size, total(na * nb)), 1).astype(np.int64).tobytes())
        self._count.frombytes(np.bincount(mine, minlength=len(pieces)).astype(np.int64).tobytes())
        self._pairs.frombytes(pair.astype(np.int64).tobytes())
        self._times.frombytes(times.astype(np.int64).tobytes())
        self.held += 250 * len(pieces) + int(ends[-1]) + 16 * len(pair) + 7 * len(written)

    def codes(self, pieces: list[str]) -> np.ndarray:
        """The number of each of ``pieces``; those not seen before are made a run at a time. What was remembered can go first, and its numbers with it."""
        if self.held > KEPT_BYTES:
            self._forget()
        runs: tuple[list[str], list[str]] = ([], [])
        sizes = [0, 0]
        for p in set(pieces).difference(self.at):
            if not p or p[0].isspace() or p[-1].isspace():  # beside another piece, its white space would run on
                self._learn([p])
                continue
            k = int(self._plain(p))
            runs[k].append(p)
            sizes[k] += len(p) + 1
            if sizes[k] >= AT_ONCE:
                self._learn(runs[k], bool(k))
                runs[k].clear()
                sizes[k] = 0
        for k, run in enumerate(runs):
            if run:
                self._learn(run, bool(k))
        self.sums = np.array(self._sums, np.int64).reshape(-1, 4).T
        self.count = np.array(self._count, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.pairs, self.times = np.array(self._pairs, np.int64), np.array(self._times, np.int64)
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def linked(self, owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, pair, times) of all links of the pieces ``code``, summed by owner and pair and sorted by them."""
        key, often = np.unique(owner << 32 | code, return_counts=True)
        owner, code = key >> 32, key & 0xFFFFFFFF
        n = self.count[code]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[code], n)
        return _summed(np.repeat(owner, n), self.pairs[at], self.times[at] * np.repeat(often, n))


def pieces_of(text: str) -> list[str]:
    """A space and ``text``, cut at single spaces between two characters that aren't white space; each piece is given without the space it begins with."""
    return CUT.split(text) if text else []


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


DOCS = (("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()))
BLOCKS = "dictionary long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, sizes array<int>, n_codes long, packed binary, offsets binary, pairs array<long>, held array<int>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def packed_links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = DICTIONARY) -> DataFrame:
    """Rows for blocks of documents with their packed pair frequencies, and behind those of a dictionary one with its pairs and in how many of its documents each is linked (``held``).

    ``packed`` holds, document after document, the steps between the ascending codes of its pairs, then how often each
    is linked. A dictionary's number follows from how the rows lie, so the table is to be stored before it is used twice.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = (pa.int64(), *(pa.list_(k) for _, k in DOCS), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        number, code, held, size = TaskContext.get().partitionId() << 32, {}, [], 0

        def row(*values) -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], k) for v, k in zip((number, *values), kinds)], names)

        def closing() -> pa.RecordBatch:
            return row(*[[] for _ in DOCS], [], 0, b"", np.zeros(1, "<u4").tobytes(), list(code), held)

        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in piecewise.blocks(texts, block):
                parts = [pieces_of(t) for t in texts[i:j]]
                doc = np.repeat(np.arange(j - i), [len(p) for p in parts])
                piece = align.codes([p for some in parts for p in some])
                bad = np.zeros(j - i, bool)
                bad[doc[align.sums[0][piece] == 0]] = True
                piece, doc, groups = piece[~bad[doc]], doc[~bad[doc]], align.groups
                sums = [np.bincount(doc, x[piece], j - i).astype(np.int64).tolist() for x in align.sums]
                edge = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
                along = piece.tolist()
                shas = [hashlib.sha256("".join([groups[k] for k in along[x:y]])[:-1].encode()).hexdigest() if x < y else "" for x, y in zip(edge, edge[1:])]
                own, pair, n = align.linked(doc, piece)
                distinct, index, docs_of = np.unique(pair, return_inverse=True, return_counts=True)
                codes = np.array([code.setdefault(x, len(code)) for x in distinct.tolist()], np.int64)
                held += [0] * (len(code) - len(held))
                for k, more in zip(codes.tolist(), docs_of.tolist()):
                    held[k] += more
                order = np.lexsort((codes[index], own))
                along, n = codes[index][order], n[order]
                sizes = np.bincount(own, minlength=j - i)
                steps = np.diff(along, prepend=0)
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                steps[first] = along[first]
                words, offsets = simple8b.encode(np.concatenate((steps, n)).astype(np.uint64))
                packed = words.astype("<u8").tobytes()
                yield row(b.column(0).slice(i, j - i).to_pylist(), *sums, shas, sizes.tolist(), len(along), packed, offsets.astype("<u4").tobytes(), [], [])
                size += len(packed) + 150 * (j - i)
                if len(code) >= most or size >= PACKED:
                    yield closing()
                    number, code, held, size = number + 1, {}, [], 0
        if size:
            yield closing()

    return rows.mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n_docs, most): in how many documents a pair is linked, and the largest such number among the pairs of its A id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("x.pairs", "x.held")
    counts = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n_docs"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "n_docs", "most")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, most: int = DICTIONARY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row of ``docs``.

    A is a byte-level vocabulary of the tokenizers library, which gets a space and the text, B one of sentencepiece,
    which adds the space itself. Texts that are null or empty, or whose tokens don't give back their bytes (a U+2581 in
    a text becomes a space in B), have no tokens: zeros and an empty string. A pair's count is the number of rows of
    ``docs`` that hold it linked; ``n_best`` counts links whose pair has the highest count of its A id, ``count_sum``
    adds up counts over links. Null and repeated ids keep a row each and count as documents of their own; other columns
    don't matter. An empty table gives an empty result.
    """
    blocks = stored(packed_links(docs, a_path, b_path, id_col, text_col, block, most), "alignment")
    each = blocks.select("dictionary", F.posexplode("pairs").alias("code", "pair"))
    # The counts were summed by pair; both sides come to the join by another key, so a pair of many dictionaries can be split.
    found = each.withColumn("other", F.bitwise_not("pair")).join(pair_counts(blocks).withColumn("other", F.bitwise_not("pair")).drop("pair"), "other").select(F.col("dictionary").alias("of"), "code", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    kinds = [*DOCS, ("n_best", pa.int64()), ("count_sum", pa.int64())]

    def total(rows: pa.Table, counts: pa.Table) -> pa.Table:
        out = [pa.table({n: pa.array([], t) for n, t in kinds})]
        n_docs, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
        code = counts.column("code").to_numpy()
        n_docs[code], best[code] = counts.column("n_docs").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
        for row in rows.to_pylist():
            sizes, n = np.array(row["sizes"], np.int64), row["n_codes"]
            both = simple8b.decode(np.frombuffer(row["packed"], "<u8"), np.frombuffer(row["offsets"], "<u4").astype(np.int64), 2 * n).astype(np.int64)
            along, start = np.cumsum(both[:n]), np.cumsum(sizes) - sizes
            codes, times = along - np.repeat(np.concatenate(([0], along))[start], sizes), both[n:]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.zeros((2, len(sizes)), np.int64)
            if n:
                np.add.at(sums[0], owner, times * best[codes])
                np.add.at(sums[1], owner, times * n_docs[codes])
            out.append(pa.table({**{c: pa.array(row[c], t) for c, t in DOCS}, "n_best": sums[0], "count_sum": sums[1]}))
        return pa.concat_tables(out)

    return blocks.where(F.size("doc_id") > 0).drop("pairs", "held").groupBy("dictionary").cogroup(found.groupBy("of")).applyInArrow(total, ALIGNED)
