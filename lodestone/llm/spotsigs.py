"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Every common word (an anchor) begins a signature: the anchor and the CHAIN content words after it, DISTANCE apart. A
text's fingerprint is the set of its signatures' 32-bit hashes. Texts whose anchors give no signature take chains from
all words; with fewer words than a chain, all words make one; without words the whole text does. So equal texts have
equal fingerprints and only empty texts have an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.storage import saved, ship

CHAIN, DISTANCE = 3, 1
# Common words of English, German, French and Spanish.
ANCHORS = frozenset("""
the of and to a in is it that for on with as was be by this are from or an at not he his have but
der die das und in zu den von mit ist des sich auf für nicht ein eine als auch es an werden aus er hat dass
le la les de des et un une du en est que qui dans pour pas sur il au ce plus par avec se
el los las y del que es por una con no para su al lo como más pero sus se
""".split())
_WORD = re.compile(r"\w+")
_KEPT = 300_000


class Signatures:
    """Signature sets of texts, with a bounded memory of word hashes."""

    def __init__(self, chain: int = CHAIN, distance: int = DISTANCE, anchors: frozenset[str] = ANCHORS) -> None:
        self.chain, self.distance, self.anchors = chain, distance, anchors
        self.known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _KEPT:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w, 0) & ~1 | (w in self.anchors)
            out.append(h)
        return np.array(out, np.uint64)

    def _mixed(self, head: np.ndarray, body: np.ndarray, first: np.ndarray) -> np.ndarray:
        h = head
        for k in range(self.chain):
            h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + body[first + k * self.distance]
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique((h >> np.uint64(32)).astype(np.uint32))

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct signatures of ``text``."""
        words = _WORD.findall(text.lower())
        if not words:
            return np.array([xxhash.xxh32_intdigest(text, 1)] if text else [], np.uint32)
        h = self._hashes(words)
        anchor = (h & np.uint64(1)).astype(bool)
        content = np.flatnonzero(~anchor)
        heads = np.flatnonzero(anchor)
        reach = (self.chain - 1) * self.distance
        first = np.searchsorted(content, heads) + self.distance - 1
        fits = first + reach < len(content)
        if fits.any():
            return self._mixed(h[heads[fits]], h[content], first[fits])
        if len(h) > reach:
            return self._mixed(np.zeros(len(h) - reach, np.uint64), h, np.arange(len(h) - reach))
        return np.array([xxhash.xxh32_intdigest(" ".join(words), 2)], np.uint32)


def written(signatures: np.ndarray) -> str:
    """A fingerprint as text: its signatures in ascending order, eight hex digits each."""
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets. If their sizes alone rule out ``least``, 0 without a comparison. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large or not small:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, signatures array<long>) for every row of ``docs``, sorted and distinct. Null texts count as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signatures(**kw)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([sign(t or "").astype(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "signatures"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, signatures array<long>")


def near_duplicates(marked: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, class_id) and links (a, b, likeness) between classes with likeness >= ``least`` > 0.

    A class is all documents with one and the same fingerprint, named by its smallest id; so copies cost one row
    each. Classes are partitioned by the length of their sets, in bands in which the shorter has at least ``least`` of
    the longer's length, so only one band and the next can match. Within a band, sets are put under their rarest
    signatures: of n, any match shares one of the first n - ceil(least * n) + 1 in order of frequency. What meets
    there is compared by size, then in full. Rows without id are left out; an empty fingerprint is a class like any
    other, alike to none but itself.
    """
    if not 0 < least <= 1:
        raise ValueError("least lies above 0 and is at most 1")
    key = F.col("signatures")
    rows = saved(marked.where("doc_id is not null").select("doc_id", "signatures"))
    classes = saved(rows.groupBy(key).agg(F.min("doc_id").alias("class_id")))
    members = rows.join(classes, "signatures").select("doc_id", "class_id")
    each = classes.select("class_id", "signatures", F.size("signatures").alias("n"), F.explode("signatures").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("f"))
    ranked = each.join(common, "s").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("by_rarity"), F.first("n").alias("n"))
    prefix = F.slice("by_rarity", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    band = F.floor(F.log("n") / (-np.log(least) if least < 1 else 1e-3) + 1e-9)
    places = ranked.select("class_id", "n", band.alias("band"), F.explode(F.transform(prefix, lambda x: x["s"])).alias("s"))
    own = places.select("s", "band", F.col("class_id").alias("a"), F.col("n").alias("na"))
    other = places.select("s", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("band").alias("own"))
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9) & ((F.col("own") != F.col("band")) | (F.col("a") < F.col("b")))
    pairs = own.join(other, ["s", "band"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = classes.select(F.col("class_id").alias("a"), F.col("signatures").alias("x"))
    two = classes.select(F.col("class_id").alias("b"), F.col("signatures").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.join(one, "a").join(two, "b").withColumn("likeness", both / (F.size("x") + F.size("y") - both))
    return members, links.where(F.col("likeness") >= least).select("a", "b", "likeness")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document's.

    The edited text has its last floor(n / 2) code points replaced by the next document's first as many, or all of them.
    Next is by ascending id (nulls first), equal ids by their texts' hash; after the last comes the first. A single
    document is its own next. Null texts count as empty. An empty table gives an empty result.

    Ids are cut into ranges at ids that occur, found by approximate quantiles. Each range is sorted in one task and gets
    a copy of the next range's first document, so texts are shuffled once and no task sees all.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("doc_id").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("at"), F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    cuts = np.array(sorted({x for x in found["at"] or [] if x > found["least"]}), np.int64)
    head = None if found["nulls"] else found["least"]

    @F.pandas_udf("int")
    def range_of(ids):
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32))

    last = len(cuts)
    is_cut = F.col("doc_id").isin(cuts.tolist()) if last else F.lit(False)
    places = F.filter(F.array(
        F.struct(F.col("range"), F.lit(False).alias("guest")),
        F.when(is_cut, F.struct((F.col("range") - 1).alias("range"), F.lit(True).alias("guest"))),
        F.when(F.col("doc_id").isNull() if head is None else F.col("doc_id") == head, F.struct(F.lit(last).alias("range"), F.lit(True).alias("guest"))),
    ), lambda p: p.isNotNull())
    placed = rows.withColumn("range", range_of(F.coalesce("doc_id", F.lit(-(1 << 63))))).select("doc_id", "text", F.explode(places).alias("p")).select("p.range", "p.guest", "doc_id", "text")
    tie = F.xxhash64("text")
    sorted_ = placed.repartition("range").sortWithinPartitions("range", "guest", "doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signatures(**kw)
        names = [x.split()[0] for x in EDITED.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before, closed = None, None
        for b in batches:
            out = []
            for range_, guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                if guest and closed == range_:
                    continue
                own = sign(text)
                if before is not None and before[0] == range_:
                    _, at, old, sigs = before
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new = sign(edited)
                    out.append((at, len(old), hashlib.sha256(edited.encode()).hexdigest(), written(sigs), written(new), likeness(sigs, new), likeness(sigs, own)))
                before, closed = (None, range_) if guest else ((range_, doc_id, text, own), closed)
                if len(out) >= 500:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return sorted_.mapInArrow(run, EDITED)
