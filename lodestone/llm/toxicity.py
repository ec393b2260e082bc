"""Toxicity by a bag of subword embeddings under a linear softmax, learned jointly in numpy.

A text is lower-cased and cut into words of letters and digits; its features are the character 3- to 5-grams of the
words with their borders, hashed into 2^16 buckets. The mean of the buckets' embeddings goes through a linear
softmax. A misspelt word shares most of its n-grams with the word it stands for, and so its vectors.

``compared`` chooses the settings: it fits each on one half of the rows that may be learned from and judges it by the
other, so rows that are held out have no part in it. Run as a module with a folder of tables, it prints the comparison.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.piecewise import blocks
from lodestone.plans.storage import ship

BITS = 16
DIM = 8
SAMPLE = (6000, 1500)  # labelled rows of class 0 and class 1 that the model is fitted on, at most
EPOCHS = 30
RATE = 40.0
PRIOR = 1000  # n-grams without a say that are counted in with every text, so that a few words don't decide alone
SETTINGS = [{"prior": p, "rate": r, "epochs": e} for p, r, e in product((300, 1000), (10.0, 20.0, 40.0), (20, 30))]  # what ``compared`` chose among


def _word_chars() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(1 << 16)], bool)


_IS_WORD: list[np.ndarray] = []


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams in a row, and how many each text has."""
    if not _IS_WORD:
        _IS_WORD.append(_word_chars())
    lowered = [t.lower() for t in texts]
    joined = "\0".join(["", *lowered, ""])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.ones(len(c), bool)
    low = c < 1 << 16
    word[low] = _IS_WORD[0][c[low]]
    word[c == 0] = False
    c = np.where(word, c, 0).astype(np.uint32)
    sizes = np.array([len(t) for t in lowered], np.int64)
    first = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    edges = np.concatenate((first - 1, [len(c)]))
    found, owner = [], []
    h = c * np.uint32(0x9E3779B1) + np.roll(c, -1)
    inner = np.roll(word, -1)
    for n in (3, 4, 5):
        h = h * np.uint32(0x85EBCA6B) + np.roll(c, -(n - 1)) + np.uint32(n)
        if n > 3:
            inner = inner & np.roll(word, -(n - 2))
        ok = inner.copy()
        ok[max(0, len(ok) - n + 1) :] = False
        at = np.flatnonzero(ok)
        x = h[at]
        x = (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        found.append((x >> np.uint32(32 - BITS)).astype(np.int32))
        owner.append(np.searchsorted(at, edges))
    counts = sum(np.diff(o) for o in owner)
    pieces = [found[k][owner[k][i] : owner[k][i + 1]] for i in range(len(texts)) for k in range(3)]
    return (np.concatenate(pieces) if pieces else np.zeros(0, np.int32)), counts


@dataclass
class Model:
    """What scoring needs: each bucket's part in the difference of the two logits, and the biases' difference."""

    parts: np.ndarray
    bias: float
    prior: float = PRIOR

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; a text without n-grams has the biases' alone."""
        ids, n = buckets(texts)
        total = np.concatenate(([0.0], np.cumsum(self.parts[ids], dtype=np.float64)))
        end = np.cumsum(n)
        return self._chance((total[end] - total[end - n]) / (n + self.prior))

    def of_row(self, ids: np.ndarray, times: np.ndarray) -> float:
        """The score of a text given by its distinct buckets and how often each occurs."""
        return float(self._chance((self.parts[ids].astype(np.float64) * times).sum() / (times.sum() + self.prior)))

    def _chance(self, mean):
        return 1 / (1 + np.exp(-(mean + self.bias)))


def fit(given: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, dim: int = DIM, rate: float = RATE, batch: int = 128, seed: int = 7, prior: float = PRIOR) -> Model:
    """Embeddings and softmax together, by gradient descent. given: distinct buckets, how often each occurs, label.

    The classes weigh the same. Each step has the length of its rate, whatever the gradient's, and a rate for all
    buckets alike: a bucket that few texts have moves little. Without rows of both classes there is nothing to tell
    apart: every score is then the smoothed share of label 1 (without any rows, 0).
    """
    rows = [(ids, (times / (times.sum() + prior)).astype(np.float32), y) for ids, times, y in given]
    y = np.array([r[2] for r in rows], float)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-12
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))), prior)
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    e, w, b = rng.normal(0, 0.1, (1 << BITS, dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    squares = [1e-8] * 3
    for epoch in range(epochs):
        left = 1 - epoch / epochs
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            ids = np.concatenate([rows[i][0] for i in mine]).astype(np.int64)
            share = np.concatenate([rows[i][1] for i in mine])
            doc = np.repeat(np.arange(len(mine)), [len(rows[i][0]) for i in mine])
            apart = w[:, 1] - w[:, 0]
            z = np.bincount(doc, share * (e @ apart)[ids], len(mine)) + b[1] - b[0]
            g = weight[mine] * (1 / (1 + np.exp(-z)) - y[mine]) / len(mine)  # of the loss by the second logit; by the first it is the opposite
            r = np.bincount(ids, share * g[doc], 1 << BITS)
            back = e.T @ r
            grads = (np.outer(r, apart), np.stack((-back, back), 1), np.array([-g.sum(), g.sum()]))
            for i, (p, grad, step) in enumerate(zip((e, w, b), grads, (rate, 0.05, 0.05))):
                squares[i] = 0.95 * squares[i] + 0.05 * float((grad * grad).sum())
                p -= step * left / np.sqrt(squares[i]) * grad
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0]), prior)


def sampled(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, y, ids, times), the last two packed: distinct buckets and how often each occurs, of the rows of at most ``sample`` labelled ids of class 0 and 1, the first ones by a hash.

    Rows without id or with a label other than 0 and 1 are left out; an id with both labels counts as 1.
    """
    ship(docs.sparkSession)
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    given = given.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = texts.select("doc_id").join(given, "doc_id").distinct()  # labels without a text don't use up the sample
    picked = None
    for label in (0, 1):
        part = known.where(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[label])
        picked = part if picked is None else picked.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, n = buckets([r["text"]])
                ids, times = np.unique(ids, return_counts=True)
                yield pa.record_batch([pa.array([r["doc_id"]], pa.int64()), pa.array([r["y"]], pa.int32()), pa.array([ids.astype(np.uint16).tobytes()], pa.binary()), pa.array([times.astype(np.int32).tobytes()], pa.binary())], ["doc_id", "y", "ids", "times"])

    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, ids binary, times binary")


def labelled(docs: DataFrame, labels: DataFrame, **kw) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(id, distinct buckets, how often each occurs, label) of the rows that ``sampled`` gives, for ``compared``: the driver holds at most 2^16 buckets for each."""
    rows = sampled(docs, labels, **kw).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.ids), bytes(r.times)))
    return [(r.doc_id, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.times, np.int32), r.y) for r in rows]


def train(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    """A model from the rows that ``sampled`` gives, in the order of ``labelled``. It is fitted in a task, so the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = []
        for b in batches:
            y, ids, times = (b.column(b.schema.get_field_index(c)) for c in ("y", "ids", "times"))
            given += [(np.frombuffer(i.as_buffer(), np.uint16), np.frombuffer(t.as_buffer(), np.int32), label) for i, t, label in zip(ids, times, y.to_pylist())]
        if given:
            m = fit(given)
            yield pa.record_batch([pa.array([m.parts.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([m.prior], pa.float64())], ["parts", "bias", "prior"])

    rows = sampled(docs, labels, **kw).repartition(1).sortWithinPartitions("doc_id", "ids", "times")
    found = rows.mapInArrow(run, "parts binary, bias double, prior double").collect()
    return Model(np.frombuffer(found[0].parts, np.float32), found[0].bias, found[0].prior) if found else fit([])


def compared(rows: list[tuple[int, np.ndarray, np.ndarray, int]], settings: list[dict], threshold: float = 0.7) -> list[tuple[float, float, float, dict]]:
    """(loss, misses, false alarms, setting), the least loss first, from ``labelled`` rows that may be learned from.

    Each setting is fitted on the rows whose crc32(id) is even and judged by the others: the loss is the mean of both
    classes' mean logarithmic losses, the other two are the shares of each class on the wrong side of the threshold.
    """
    even = [zlib.crc32(str(r[0]).encode()) // 3 % 2 == 0 for r in rows]  # the remainder by 3 is spoken for
    out = []
    for setting in settings:
        model = fit([r[1:] for r, e in zip(rows, even) if e], **setting)
        judged = [(model.of_row(r[1], r[2]), r[3]) for r, e in zip(rows, even) if not e]
        loss = [np.mean([-np.log(max(1e-12, s if label else 1 - s)) for s, y in judged if y == label]) for label in (0, 1)]
        wrong = [np.mean([(s >= threshold) != bool(y) for s, y in judged if y == label]) for label in (1, 0)]
        out.append((float(np.mean(loss)), float(wrong[0]), float(wrong[1]), setting))
    return sorted(out, key=lambda x: x[0])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``, from its whole text alone.

    Null and empty texts, and those without letters or digits, get the score of the biases. Null and repeated ids
    keep a row each. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.parts, model.bias, model.prior))  # 2^16 numbers
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in blocks(texts, 1_000_000):
                s = m.scores(texts[i:j])
                yield pa.record_batch([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches ``threshold``. Rows, repeated or not, are judged one by one."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.parts, model.bias, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            for i, j in blocks(texts, 1_000_000):
                yield b.slice(i, j - i).filter(pa.array(m.scores(texts[i:j]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 when divided by 3. Null ids never are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _main(sf_dir: str) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    for loss, misses, alarms, setting in compared(labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels), SETTINGS):
        print(f"loss {loss:.4f}, misses {misses:.4f}, false alarms {alarms:.4f}: {setting}", flush=True)
    spark.stop()


if __name__ == "__main__":
    import sys

    _main(sys.argv[1])
