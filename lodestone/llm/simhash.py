"""Near-duplicates by SimHash: fingerprints of word shingles, linked through anchor points of a covering code.

Every 64-bit fingerprint is cut into three blocks of at most 22 bits. The anchors of a block are the codewords of the
binary Golay code of length 23, whose balls of radius 3 fill the space, so each block value has exactly one anchor
within 3, its home. If two fingerprints differ in e bits of a block, the home of the one lies within 3 + e of the
other. With at most four differing bits one of these holds:

* ``single``: some block has at most one differing bit. Every fingerprint goes to its three homes and, as a guest, to
  all anchors within 3 + 1 (about 5.3 for each block).
* ``pairs``: some two blocks have at most (1, 1) differing bits, or (0, 2) in cyclic order. Anchors are pairs of
  codewords, 2^24 for each of the three pairs of blocks; a fingerprint has about 45 guests' places for each.

In either form two linked fingerprints meet, as home and guest, below one anchor. Both are exact; they differ in rows
written and comparisons made, so the planner takes the one that costs less for the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.plans.storage import saved, ship

BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and width
PAIRS_FROM = 4_000_000  # distinct fingerprints from which pairs of anchors cost less than single ones
SLICE = 4096  # homes below one anchor that are compared at a time, about; more are dealt to several tasks
GUESTS = 1 << 15  # guests likewise
AT_ONCE = 1 << 22  # comparisons held in memory
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of UTF-8 ``text``, as an unsigned number.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``shingle`` words joined by
    a space and counted as often as they occur. Fewer words form one shingle; without a word it is zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    last = ends[width - 1 :]
    first = np.concatenate(([0], ends[: len(last) - 1] + 1))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), SHINGLES_AT_ONCE):
        spans = zip(first[at : at + SHINGLES_AT_ONCE].tolist(), last[at : at + SHINGLES_AT_ONCE].tolist())
        h = np.array([digest(flat[i:j], seed) for i, j in spans], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(last), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row of ``docs``; the fingerprint's 64 bits as a signed long.

    A null text counts as empty. Ids may be null or repeat; each row gets its own result row. Other columns of
    ``docs`` don't matter.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t or b"", shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# --- anchors ---------------------------------------------------------------------------------------------------


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Remainder tables of the low 12 and high 11 bits, and by remainder the error patterns of weight <= 3, 4, 5."""
    generator = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1

    def remainder(w: int) -> int:
        for bit in range(22, 10, -1):
            if w >> bit & 1:
                w ^= generator << (bit - 11)
        return w

    low = np.array([remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([remainder(i << 12) for i in range(1 << 11)], np.int64)
    unit = [remainder(1 << i) for i in range(23)]
    found: dict[int, list[list[int]]] = {0: [[] for _ in range(2048)], 1: [[] for _ in range(2048)], 2: [[] for _ in range(2048)]}
    for weight in range(6):
        for bits in combinations(range(23), weight):
            s = e = 0
            for i in bits:
                s ^= unit[i]
                e |= 1 << i
            found[max(0, weight - 3)][s].append(e)
    home = np.array([x[0] for x in found[0]], np.int64)
    return low, high, home, [found[k] for k in (1, 2)]


@cache
def _layer(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight 3 + k: the first and the count for each remainder, and all of them in a row."""
    lists = _golay()[3][k - 1]
    counts = np.array([len(x) for x in lists], np.int64)
    return np.cumsum(counts) - counts, counts, np.array([e for x in lists for e in x], np.int64)


def _blocks(fp: np.ndarray) -> list[np.ndarray]:
    return [(fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in BLOCKS]


def _near(block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and 12-bit names of the anchors in layer k: the home (0), those at distance 3 + k (1, 2)."""
    low, high, home, _ = _golay()
    s = low[block & 0xFFF] ^ high[block >> 12]
    if k == 0:
        return np.arange(len(block)), (block ^ home[s]) >> 11
    first, counts, errors = _layer(k)
    n = counts[s]
    rows = np.repeat(np.arange(len(block)), n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[s], n)
    return rows, (block[rows] ^ errors[at]) >> 11


def anchored(fp: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is the home, for all places of the fingerprints ``fp`` (unsigned)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    blocks = _blocks(fp)

    def put(rows: np.ndarray, key: np.ndarray, home: bool) -> None:
        out.append((rows, key, np.full(len(rows), home)))

    if not pairs:
        for t, block in enumerate(blocks):
            rows, names = _near(block, 0)
            put(rows, names | t << 24, True)
            put(rows, names | t << 24, False)
            rows, names = _near(block, 1)
            put(rows, names | t << 24, False)
    else:
        for t in range(3):
            one, two = blocks[t], blocks[(t + 1) % 3]
            for k, m in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2)):
                rows, names = _near(one, k)
                more, others = _near(two[rows], m)
                key = names[more] << 12 | others | t << 24
                put(rows[more], key, False)
                if (k, m) == (0, 0):
                    put(rows[more], key, True)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable, for nodes 0..n-1 and links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _star_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (u, v) that join what lies within ``most`` bits below one anchor; each block of comparisons gives stars.

    Rows come sorted by key, homes first. Comparisons are made in blocks of AT_ONCE, and of the pairs found only a
    spanning star is kept, so a group of n near copies gives about n links and not n^2 / 2.
    """
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    homes = np.add.reduceat(home.astype(np.int64), edge[:-1])
    group = np.repeat(np.arange(len(size)), size)
    guests = np.flatnonzero(~home)
    work = homes[group[guests]]
    guests, work = guests[work > 0], work[work > 0]
    done = np.cumsum(work)
    start = 0
    while start < len(guests):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + AT_ONCE, "right")))
        g, w = guests[start:stop], work[start:stop]
        right = np.repeat(g, w)
        left = np.repeat(edge[group[g]], w) + np.arange(len(right)) - np.repeat(np.cumsum(w) - w, w)
        gap = np.bitwise_count(fp[left] ^ fp[right])
        hit = (gap <= most) & (gap > 0)
        if hit.any():
            nodes, index = np.unique(np.concatenate((fp[left[hit]], fp[right[hit]])), return_inverse=True)
            half = len(index) // 2
            root = _roots(len(nodes), index[:half], index[half:])
            off = np.flatnonzero(root != np.arange(len(nodes)))
            yield nodes[off], nodes[root[off]]
        start = stop


def hamming_links(distinct: DataFrame, most: int = 4, form: str = "auto") -> DataFrame:
    """(u long, v long): links that connect what differs in ``most`` bits or fewer (at most four).

    ``distinct`` has each fingerprint once (fp long). The links are a spanning part: two fingerprints within ``most``
    bits are joined directly or through others that are, never through anything else. ``form`` is ``single``,
    ``pairs`` or ``auto`` (by the number of rows).
    """
    if not 0 <= most <= 4:
        raise ValueError("anchors are laid out for at most four differing bits")
    ship(distinct.sparkSession)
    pairs = distinct.count() >= PAIRS_FROM if form == "auto" else form == "pairs"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 2000):
                fp = every[at : at + 2000]
                rows, key, home = anchored(fp, pairs)
                yield pa.record_batch([key, fp[rows].view(np.int64), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def out(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            for u, v in _star_links(rows[0], rows[1], rows[2], most):
                yield pa.record_batch([u.view(np.int64), v.view(np.int64)], ["u", "v"])

        for b in batches:
            new = (b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False))
            if not len(new[0]):
                continue
            rows = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on in the next batch
            if cut:
                yield from out(tuple(x[:cut] for x in rows))
            held = tuple(x[cut:] for x in rows)
        if held is not None and len(held[0]):
            yield from out(held)

    places = distinct.select("fp").mapInArrow(place, "anchor long, fp long, home boolean")
    sorted_ = dealt(places).repartition("key").sortWithinPartitions("key", F.col("home").desc())
    return sorted_.mapInArrow(compare, "u long, v long").distinct()


def dealt(places: DataFrame) -> DataFrame:
    """(key, fp, home): ``places`` (anchor, fp, home) with the anchors cut into cells that one task can hold.

    The homes below an anchor are dealt to slices of about SLICE, its guests to slices of about GUESTS; every slice of
    homes meets every slice of guests in a cell (``key``) of its own. Anchors without a home have nothing to compare and
    go. The counts that tell how many slices an anchor has are joined to its places by a key other than that which
    they were counted by, so the places come straight from a shuffle and the adaptive skew join can split a hot anchor.
    """
    counts = places.groupBy("anchor").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("guests"))
    crowded = counts.where((F.col("homes") > SLICE) | (F.col("guests") > GUESTS) & (F.col("homes") > 0))
    cells = crowded.select(F.bitwise_not("anchor").alias("other"), F.ceil(F.col("homes") / SLICE).cast("int").alias("h"), F.greatest(F.ceil(F.col("guests") / GUESTS), F.lit(1)).cast("int").alias("g"))
    met = places.withColumn("other", F.bitwise_not("anchor")).join(cells, "other", "left")
    h, g = F.coalesce("h", F.lit(1)), F.coalesce("g", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), h).otherwise(g)).cast("int")
    cell = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), g - 1), lambda i: i * h + own)).otherwise(F.transform(F.sequence(F.lit(0), h - 1), lambda i: own * h + i))
    key = (F.col("anchor") * F.lit(1 << 34) + F.col("cell")).alias("key")
    return met.select("anchor", "fp", "home", F.explode(cell).alias("cell")).select(key, "fp", "home")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, form: str = "auto") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits. ``component_id`` is the smallest doc_id reached over links between
    fingerprints that differ in ``most`` bits or fewer; equal fingerprints are one node, so copies cost nothing.
    Empty, blank and null texts share fingerprint zero and are linked like any other. A null doc_id gets its
    component as well (null only if no member has an id). Repeated rows stay repeated. An empty table gives an empty
    result. Joins by a key that many rows share (copies of one text, members of one component) have a plain shuffle on
    either side, which the adaptive skew join splits.
    """
    fps = saved(fingerprints(docs, id_col, text_col, shingle))
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(hamming_links(nodes.select("fp"), most, form))
    joined = saved(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "root"))
    # A component's least id goes to its members by a key of its own, so that a large component can be split.
    least = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("least")).select(F.bitwise_not("root").alias("other"), "least")
    linked = joined.where("root is not null").withColumn("other", F.bitwise_not("root")).join(least, "other").select("fp", F.col("least").alias("component_id"))
    named = saved(linked.unionByName(joined.where("root is null").select("fp", F.col("first").alias("component_id"))))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
