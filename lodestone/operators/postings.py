"""Postings in blocks of documents: sparse and hybrid searches that pair nothing out, and indexes that take changes.

Documents are dealt to blocks by a hash of their id. A block is one row: its ids, their vectors, and for each term the
documents that have it, with weights and the largest of them. So the postings of a frequent term lie in all blocks, and a
search is a pass over the blocks with the queries at hand, which sends on k rows for each query and task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.operators import exact
from lodestone.operators.exact import DimensionMismatchError, _exact, top_k
from lodestone.plans.storage import saved, ship
from lodestone.sources.vectors import latest_version, read_meta, write_meta

BLOCK, LARGE = 500, 2048  # documents of a block, about: at least and, of many documents, at most, which bounds what a task holds
REPEATED = 100_000  # repeated ids that are sent to every task, at most
TEXTS = 256  # texts whose words are in memory at once
MET = 1_000_000  # meetings of words and products in memory at once, about
ROWS = "block int, number int, ids array<long>, gone array<long>, vectors array<double>, dim int, terms array<string>, ends array<int>, docs array<int>, weights array<double>, bounds array<double>"
_KINDS = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_WHITE = re.compile(r"[\x20\x09-\x0D]+")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, terms, weights) of (id, text), TEXTS rows at a time: a word and its count as objects take many times their room in a batch."""
    for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
        counts = [Counter(w for w in _WHITE.split(t or "") if w) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.float64()))], ["id", "terms", "weights"])


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", named: bool = True) -> DataFrame:
    """(id, terms, weights): the distinct words of each text, runs without ASCII white space, and how often they occur. Null texts have none; rows without id are left out if ``named``."""
    ship(docs.sparkSession)
    return (docs.where(F.col(id_col).isNotNull()) if named else docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_counted, "id long, terms array<string>, weights array<double>")


def merged_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts of rows with the same id, one after the other; rows without id are one document.

    Ids alone are counted first. Texts whose id comes once stay where they are; unless more than REPEATED ids repeat, only the others are shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    merged = lambda some: some.groupBy("doc_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    again = saved(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    n = again.count()
    if n == 0:
        return rows
    if n > REPEATED:
        return merged(rows)
    named, again = rows.where("doc_id is not null"), F.broadcast(again)
    return named.join(again, "doc_id", "left_anti").unionByName(merged(named.join(again, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))))


def products(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, dot, norm, qnorm) of all that share a term: ``docs`` has (id, terms, weights), ids unique, ``asked`` (query_id, term, qweight), each pair once.

    Every task goes through its documents with a block of the queries at hand, as postings by term, and gives out the
    products of a few documents at a time: nothing is shuffled, and what is in memory doesn't depend on the tables' sizes.
    Words of many queries are met by a matrix product, the others by their postings.
    """
    ship(docs.sparkSession)
    rows = saved(asked.where("query_id is not null and term is not null"))
    schema = "query_id long, id long, dot double, norm double, qnorm double"
    found = None
    for table in _dealt(rows, rows.groupBy("query_id").agg(F.count("*").alias("n"))):
        shared = docs.sparkSession.sparkContext.broadcast(table)

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            if not known.num_rows:
                return
            ids, query = np.unique(known.column("query_id").to_numpy(), return_inverse=True)
            words = known.column("term").combine_chunks().dictionary_encode()
            qweight = known.column("qweight").to_numpy().astype(np.float64)
            qnorm = np.sqrt(np.bincount(query, qweight * qweight))
            code = np.asarray(words.indices).astype(np.int64)
            order = np.argsort(code, kind="stable")
            query, qweight = query[order], qweight[order]
            ends = np.cumsum(np.bincount(code, minlength=len(words.dictionary)))
            starts = np.concatenate(([0], ends[:-1]))
            often = np.argsort(starts - ends, kind="stable")[: max(1, MET // len(ids))]
            often = often[(ends - starts)[often] >= 0.05 * len(ids)]
            column = np.full(len(ends), -1)
            column[often] = np.arange(len(often))
            of_often = column[code[order]]
            dense = np.zeros((len(often), len(ids)))
            np.add.at(dense, (of_often[of_often >= 0], query[of_often >= 0]), qweight[of_often >= 0])
            positive = bool((qweight > 0).all())
            for b in batches:
                terms = b.column(1)
                length = np.asarray(pa.compute.list_value_length(terms).fill_null(0)).astype(np.int64)
                owner = np.repeat(np.arange(b.num_rows), length)
                weight = np.asarray(b.column(2).flatten(), np.float64)
                norm = np.sqrt(np.bincount(owner, weight * weight, b.num_rows))
                at = np.asarray(pa.compute.index_in(terms.flatten(), value_set=words.dictionary).fill_null(-1)).astype(np.int64)
                owner, weight, at = owner[at >= 0], weight[at >= 0], at[at >= 0]
                above = positive and bool((weight > 0).all())
                n = np.where(column[at] < 0, ends[at] - starts[at], 0)
                first = np.searchsorted(owner, np.arange(b.num_rows + 1))
                cost = np.concatenate(([0], np.cumsum(n)))[first] + np.arange(b.num_rows + 1) * len(ids)
                i = 0
                while i < b.num_rows:
                    j = max(i + 1, int(np.searchsorted(cost, cost[i] + MET, "right")) - 1)
                    part = slice(first[i], first[j])
                    m, col = n[part], column[at[part]]
                    hit = np.arange(int(m.sum())) + np.repeat(starts[at[part]] - np.cumsum(m) + m, m)
                    cell = np.repeat((owner[part] - i) * len(ids), m) + query[hit]
                    rows = np.zeros((j - i, len(often)))
                    rows[owner[part][col >= 0] - i, col[col >= 0]] = weight[part][col >= 0]
                    dot = np.bincount(cell, np.repeat(weight[part], m) * qweight[hit], (j - i) * len(ids)) + (rows @ dense).ravel()
                    here = dot if above else np.bincount(cell, minlength=len(dot)) + ((rows != 0) @ (dense != 0).astype(np.float64)).ravel()
                    some = np.flatnonzero(here)
                    doc, q = i + some // len(ids), some % len(ids)
                    if len(some):
                        yield pa.record_batch([pa.array(ids[q]), b.column(0).take(pa.array(doc)), pa.array(dot[some]), pa.array(norm[doc]), pa.array(qnorm[q])], ["query_id", "id", "dot", "norm", "qnorm"])
                    i = j

        one = docs.select(F.col("id").cast("long").alias("id"), "terms", "weights").mapInArrow(meet, schema)
        found = one if found is None else found.unionByName(one)
    return found


def packed(docs: DataFrame, n_blocks: int, vectors: DataFrame | None = None, number: int = 0) -> DataFrame:
    """Rows of ROWS for ``docs`` (id, terms, weights; ids unique) and ``vectors`` (id, vector), either of which a document can lack."""
    ship(docs.sparkSession)
    both = docs.select("id", "terms", "weights")
    if vectors is None:
        both = both.withColumn("vector", F.lit(None).cast("array<double>"))
    else:
        known = vectors.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        both = both.join(known, "id", "full")
    rows = both.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        n, terms = table.num_rows, table.column("terms").combine_chunks()
        flat = terms.flatten().dictionary_encode()
        owner = np.repeat(np.arange(n), np.nan_to_num(np.asarray(pa.compute.list_value_length(terms).fill_null(0))).astype(np.int64))
        code, weight = np.asarray(flat.indices).astype(np.int64), np.asarray(table.column("weights").combine_chunks().flatten(), np.float64)
        order = np.lexsort((owner, code))
        vectors = table.column("vector").combine_chunks()
        long = np.asarray(pa.compute.list_value_length(vectors).fill_null(0)).astype(np.int64)
        dim = int(long.max(initial=0))
        x = np.full((n, dim), np.nan)
        if not np.isin(long, (0, dim)).all():
            raise DimensionMismatchError("vectors of different lengths")
        x[long > 0] = np.asarray(vectors.flatten(), np.float64).reshape(-1, dim) if dim else 0.0
        ends = np.cumsum(np.bincount(code, minlength=len(flat.dictionary)))
        bounds = np.maximum.reduceat(weight[order], np.concatenate(([0], ends[:-1]))) if len(ends) else np.zeros(0)
        values = (key[0].as_py(), number, table.column("id").to_pylist(), [], x.ravel(), dim, flat.dictionary.to_pylist(), ends.astype(np.int32), owner[order].astype(np.int32), weight[order], bounds)
        return pa.table({k: pa.array([v], t) for k, v, t in zip(_NAMES, values, _KINDS)})

    return rows.groupBy("block").applyInArrow(pack, ROWS)


@dataclass
class Block:
    """A block as arrays; ``live`` tells which documents count, ``x`` is NaN where one has no vector."""

    ids: np.ndarray
    live: np.ndarray
    x: np.ndarray
    at: dict[str, int]
    ends: np.ndarray
    docs: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray

    def numbers(self, words: pa.Array) -> np.ndarray:
        """For each of ``words`` its number here, -1 if it doesn't occur."""
        return np.asarray(pa.compute.index_in(words, value_set=pa.array(list(self.at), pa.string())).fill_null(-1)).astype(np.int64)

    def summed(self, lists: np.ndarray, qweights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every document, its product with the query over ``lists``, and in how many of them it is."""
        start = np.where(lists > 0, self.ends[lists - 1], 0) if len(lists) else lists
        n = self.ends[lists] - start if len(lists) else lists
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        docs = self.docs[at]
        return np.bincount(docs, self.weights[at] * np.repeat(qweights, n), len(self.ids)), np.bincount(docs, minlength=len(self.ids))


@dataclass
class Asked:
    """Queries' terms as arrays, each distinct word once: those of query i are ``codes[ends[i] : ends[i + 1]]``."""

    ids: list[int]
    words: pa.Array
    codes: np.ndarray
    weights: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Asked:
        """From (query_id, terms, qweights); queries without terms have null."""
        terms = table.column("terms").combine_chunks()
        flat = terms.flatten().dictionary_encode()
        ends = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.list_value_length(terms).fill_null(0)).astype(np.int64))))
        return cls(table.column("query_id").to_pylist(), flat.dictionary, np.asarray(flat.indices).astype(np.int32), np.asarray(table.column("qweights").combine_chunks().flatten()).astype(np.float64), ends)

    def met(self, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its id, the numbers of its terms that occur in ``block``, and its weights for them."""
        number = block.numbers(self.words)
        for i, q_id in enumerate(self.ids):
            mine = slice(self.ends[i], self.ends[i + 1])
            lists = number[self.codes[mine]]
            yield q_id, lists[lists >= 0], self.weights[mine][lists >= 0]


def _joined(parts: list[Block]) -> Block:
    """One block of the live documents of several."""
    words: dict[str, int] = {}
    docs, codes, weights, base = [], [], [], 0
    dim = max(p.x.shape[1] for p in parts)
    for p in parts:
        number = np.array([words.setdefault(t, len(words)) for t in p.at], np.int64)
        keep = p.live[p.docs]
        docs.append((np.cumsum(p.live) - 1 + base)[p.docs[keep]])
        codes.append(np.repeat(number, np.diff(p.ends, prepend=0))[keep])
        weights.append(p.weights[keep])
        base += int(p.live.sum())
    ids = np.concatenate([p.ids[p.live] for p in parts])
    x = np.concatenate([np.pad(p.x[p.live], ((0, 0), (0, dim - p.x.shape[1])), constant_values=np.nan) for p in parts])
    doc, code, weight = np.concatenate(docs), np.concatenate(codes), np.concatenate(weights)
    order = np.lexsort((doc, code))
    doc, weight = doc[order], weight[order]
    kept, code = np.unique(code[order], return_inverse=True)
    names = list(words)
    ends = np.cumsum(np.bincount(code, minlength=len(kept))).astype(np.int64)
    bounds = np.maximum.reduceat(weight, np.concatenate(([0], ends[:-1]))) if len(ends) else np.zeros(0)
    return Block(ids, np.ones(len(ids), bool), x, {names[c]: i for i, c in enumerate(kept.tolist())}, ends, doc, weight, bounds)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Block]]:
    """The blocks of each row or, where a block has several versions of its documents, of all its rows, which come one after the other with ascending numbers."""
    held: list[dict] = []

    def out() -> list[Block]:
        last: dict[int, int] = {}
        for r in held if len(held) > 1 else []:
            last.update(dict.fromkeys([*r["ids"].tolist(), *r["gone"].tolist()], r["number"]))
        made = []
        for r in held:
            ids = r["ids"]
            if len(ids):
                live = np.array([last[i] == r["number"] for i in ids.tolist()]) if last else np.ones(len(ids), bool)
                made.append(Block(ids, live, r["vectors"].reshape(len(ids), r["dim"]), {t: i for i, t in enumerate(r["terms"])}, r["ends"].astype(np.int64), r["docs"].astype(np.int64), r["weights"], r["bounds"]))
        made = [b for b in made if b.live.any()]
        return [_joined(made)] if len(made) > 1 else made

    for b in batches:
        for i in range(b.num_rows):
            r = {n: b.column(k)[i] for k, n in enumerate(_NAMES)}
            r = {n: v.as_py() if n in ("block", "number", "dim", "terms") else v.values.to_numpy(zero_copy_only=False) for n, v in r.items()}
            if held and held[-1]["block"] != r["block"]:
                yield out()
                held = []
            held.append(r)
    if held:
        yield out()


def _top(q_id: int, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` smallest scores, ties to the smaller id."""
    if len(ids) > 4 * k:
        cut = score <= np.partition(score, k - 1)[k - 1]
        score, ids = score[cut], ids[cut]
    order = np.lexsort((ids, score))[:k]
    return np.full(len(order), q_id), ids[order], score[order]


class _Best:
    """A task's best ``k`` of each query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def add(self, q_id: int, score: np.ndarray, ids: np.ndarray) -> None:
        old = self.held.get(q_id)
        _, i, s = _top(q_id, score if old is None else np.concatenate((old[1], score)), ids if old is None else np.concatenate((old[0], ids)), self.k)
        self.held[q_id] = (i, s)

    def last(self, q_id: int) -> float:
        """The score of the k-th, infinite if there are fewer."""
        got = self.held.get(q_id)
        return float(got[1][-1]) if got is not None and len(got[1]) == self.k else np.inf

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.record_batch([pa.array(np.repeat(list(self.held), [len(i) for i, _ in self.held.values()]), pa.int64()), pa.array(np.concatenate([i for i, _ in self.held.values()]), pa.int64()), pa.array(np.concatenate([s for _, s in self.held.values()]), pa.float64())], ["query_id", "id", "distance"])


def max_score(block: Block, lists: np.ndarray, w: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents whose product with the query (numbers of its terms here and its weights) can reach ``floor``, and the product.

    Lists are taken in the order of their bounds, query's weight times the largest of the list. Those whose bounds
    together stay below ``floor`` can't bring in a document alone: only the others make candidates.
    """
    order = np.argsort(w * block.bounds[lists], kind="stable")
    lists, w = lists[order], w[order]
    idle = int(np.searchsorted(np.cumsum(w * block.bounds[lists]), floor))
    _, often = block.summed(lists[idle:], w[idle:])
    some = np.flatnonzero((often > 0) & block.live)
    if not len(some):
        return some, np.zeros(0)
    return some, block.summed(lists, w)[0][some]


def _dealt(queries: DataFrame, cells: DataFrame) -> Iterator[pa.Table]:
    """``queries`` (query_id, ...) in blocks of at most about BROADCAST_CELLS numbers and terms; ``cells`` has (query_id, n)."""
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    n = max(1, -(-total // exact.BROADCAST_CELLS))
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow()


@dataclass(frozen=True)
class PostingsIndex:
    """A version of an index in a folder: the packed base, and segments of documents that were put in or went later.

    Documents keep their block whatever version they are in, so a search gathers a block's rows and lets each document's
    last change hold. Versions are never changed; see ``lists.ListIndex``.
    """

    spark: SparkSession
    path: str
    n_blocks: int
    version: int = 0
    segments: tuple[int, ...] = field(default=(0,))

    @classmethod
    def build(cls, docs: DataFrame, path: str, vectors: DataFrame | None = None, block: int | None = None) -> PostingsIndex:
        """From ``docs`` (id, terms, weights), as ``doc_terms`` gives them, and ``vectors`` (id, vector).

        A search takes every query to every block, so many documents make larger blocks rather than more of them: about 64, while these stay below LARGE.
        """
        n = docs.count()
        index = cls(docs.sparkSession, path, max(1, -(-n // (block or max(BLOCK, min(LARGE, n // 64))))))
        packed(docs, index.n_blocks, vectors).write.mode("overwrite").parquet(f"{path}/segment-0")
        return index._described()

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> PostingsIndex:
        meta = read_meta(spark, path, latest_version(spark, path) if version is None else version)
        return cls(spark, path, meta["n_blocks"], meta["version"], tuple(meta["segments"]))

    def _described(self) -> PostingsIndex:
        write_meta(self.spark, self.path, self.version, {"version": self.version, "n_blocks": self.n_blocks, "segments": self.segments})
        return self

    def _with(self, rows: DataFrame) -> PostingsIndex:
        number = self.version + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/segment-{number}")
        return replace(self, version=number, segments=(*self.segments, number))._described()

    def upsert(self, docs: DataFrame, vectors: DataFrame | None = None) -> PostingsIndex:
        """The next version, in which ``docs`` (and ``vectors``) are new or take the place of those of their ids, terms and vector together."""
        return self._with(packed(docs, self.n_blocks, vectors, self.version + 1))

    def delete(self, ids: DataFrame) -> PostingsIndex:
        """The next version, without ``ids`` (id)."""
        rows = ids.where("id is not null").select(F.col("id").cast("long").alias("id")).distinct().groupBy(F.pmod(F.xxhash64("id"), F.lit(self.n_blocks)).cast("int").alias("block")).agg(F.collect_list("id").alias("gone"))
        none = {n: F.array().cast(t) for n, t in (x.split() for x in ROWS.split(", ")) if t.startswith("array") and n != "gone"}
        return self._with(rows.withColumns({"number": F.lit(self.version + 1), "dim": F.lit(0)} | none).select(*_NAMES))

    def rows(self) -> DataFrame:
        """The packed rows, those of a block together and in the order of their numbers."""
        rows = self.spark.read.schema(ROWS).parquet(*[f"{self.path}/segment-{n}" for n in self.segments])
        return rows if len(self.segments) == 1 else rows.repartition("block").sortWithinPartitions("block", "number")

    def sparse(self, asked: DataFrame, k: int, scored: Accumulator | None = None) -> DataFrame:
        """(query_id, rank, id, distance): the ``k`` documents with the largest product of weights with those of ``asked`` (query_id, term, qweight > 0), which is minus the distance; ties to the smaller id. What shares no term isn't found. ``scored`` counts the products made."""
        if k <= 0:
            raise ValueError("the limit must be above 0")
        ship(self.spark)
        terms = saved(asked.where("term is not null and qweight > 0").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("qweight").alias("qweights")))
        found = None
        for table in _dealt(terms, terms.select("query_id", F.size("terms").alias("n"))):
            shared = self.spark.sparkContext.broadcast(Asked.of(table))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                best = _Best(k)
                for blocks in _blocks(batches):
                    for b in blocks:
                        for q_id, lists, w in shared.value.met(b):
                            some, dot = max_score(b, lists, w, -best.last(q_id))
                            if scored is not None:
                                scored.add(len(some))
                            best.add(q_id, -dot, b.ids[some])
                yield from best.out()

            one = self.rows().mapInArrow(scan, "query_id long, id long, distance double")
            found = one if found is None else found.unionByName(one)
        return top_k(found, k).select("query_id", "rank", "id", "distance")

    def hybrid(self, queries: DataFrame, asked: DataFrame, k: int, dense_weight: float = 0.6, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
        """(query_id, rank, id, distance): documents that share a term with the query (all, if none does) and have a vector, scored by distance and product, each scaled to [0, 1] within the query's candidates.

        One pass over the blocks finds each query's smallest and largest distance and product, a second scores by them.
        Neither pairs anything out: the first sends a row for each query and task, the second its best ``k``.
        """
        if k <= 0:
            raise ValueError("the limit must be above 0")
        ship(self.spark)
        terms = asked.where("term is not null").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("qweight").alias("qweights"))
        known = saved(queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).join(terms, "query_id", "left"))
        found = None
        for table in _dealt(known, known.select("query_id", (F.size("vector") + F.coalesce(F.size("terms"), F.lit(0))).alias("n"))):
            shared = self.spark.sparkContext.broadcast((Asked.of(table), table.column("vector").combine_chunks()))

            def measured(b: Block, q: np.ndarray, lists: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
                """Rows with a vector, their distances, products, and for each whether it shares a term; and whether any document here does."""
                dot, often = b.summed(lists, w)
                some = np.flatnonzero(b.live & ~np.isnan(b.x).all(1)) if b.x.shape[1] else np.zeros(0, np.int64)
                d = _exact(metric, q[None], b.x[some][None])[0] if len(some) else np.zeros(0)
                return some, d, np.where(often[some] > 0, dot[some], np.nan), bool((often[b.live] > 0).any())

            def spans(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ends: dict[int, np.ndarray] = {}
                inf = np.inf
                for blocks in _blocks(batches):
                    for b in blocks:
                        for (q_id, lists, w), q in zip(shared.value[0].met(b), shared.value[1]):
                            some, d, dot, any_ = measured(b, q.values.to_numpy(), lists, w)
                            own = d[~np.isnan(dot)]
                            new = np.array([min(own, default=inf), -max(own, default=-inf), np.nanmin(dot, initial=inf), -np.nanmax(dot, initial=-inf), min(d, default=inf), -max(d, default=-inf), -float(any_)])
                            ends[q_id] = np.minimum(ends[q_id], new) if q_id in ends else new
                if ends:
                    yield pa.record_batch([pa.array(list(ends), pa.int64()), pa.array([e.tolist() for e in ends.values()], pa.list_(pa.float64()))], ["query_id", "least"])

            rows = self.rows().mapInArrow(spans, "query_id long, least array<double>").groupBy("query_id").agg(*[F.min(F.col("least")[i]).alias(f"e{i}") for i in range(7)]).toArrow()  # a row for each query of the block
            ends = self.spark.sparkContext.broadcast({r["query_id"]: [r[f"e{i}"] for i in range(7)] for r in rows.to_pylist()})

            def scan(batches: Iterator[pa.RecordBatch], shared=shared, ends=ends) -> Iterator[pa.RecordBatch]:
                best = _Best(k)
                scale = lambda x, low, high: np.full(len(x), 0.5) if high - low < 1e-10 else np.clip((x - low) / (high - low), 0, 1)
                for blocks in _blocks(batches):
                    for b in blocks:
                        for (q_id, lists, w), q in zip(shared.value[0].met(b), shared.value[1]):
                            dl, dh, sl, sh, al, ah, any_ = ends.value[q_id]
                            some, d, dot, _ = measured(b, q.values.to_numpy(), lists, w)
                            if any_:
                                keep = ~np.isnan(dot)
                                some, d, dot, low, high, lowest, largest = some[keep], d[keep], dot[keep], dl, -dh, sl, -sh
                            else:
                                dot, low, high, lowest, largest = np.zeros(len(d)), al, -ah, 0.0, 0.0
                            near = 1 - scale(d, low, high)
                            fused = np.round(1 - (dense_weight * near + (1 - dense_weight) * scale(dot, lowest, largest)), 12)
                            best.add(q_id, fused, b.ids[some])
                yield from best.out()

            one = self.rows().mapInArrow(scan, "query_id long, id long, distance double")
            found = one if found is None else found.unionByName(one)
        return top_k(found, k).select("query_id", "rank", "id", "distance")

    def compact(self) -> PostingsIndex:
        """The next version, with every document's last change in one base."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for blocks in _blocks(batches):
                for b in blocks:
                    words = sorted(b.at, key=b.at.get)
                    term = np.repeat(np.arange(len(words)), np.diff(b.ends, prepend=0))
                    keep = b.live[b.docs]
                    by = [([], []) for _ in b.ids]
                    for d, t, w in zip(b.docs[keep].tolist(), term[keep].tolist(), b.weights[keep].tolist()):
                        by[d][0].append(words[t])
                        by[d][1].append(w)
                    live = np.flatnonzero(b.live).tolist()
                    vectors = [None if not b.x.shape[1] or np.isnan(b.x[i]).all() else b.x[i].tolist() for i in live]
                    yield pa.record_batch([pa.array(b.ids[live], pa.int64()), pa.array([by[i][0] for i in live], pa.list_(pa.string())), pa.array([by[i][1] for i in live], pa.list_(pa.float64())), pa.array(vectors, pa.list_(pa.float64()))], ["id", "terms", "weights", "vector"])

        live = saved(self.rows().mapInArrow(merge, "id long, terms array<string>, weights array<double>, vector array<double>"))
        number = self.version + 1
        packed(live.drop("vector"), self.n_blocks, live.select("id", "vector"), number).write.mode("overwrite").parquet(f"{self.path}/segment-{number}")
        return replace(self, version=number, segments=(number,))._described()
