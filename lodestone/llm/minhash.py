"""Near-duplicates by MinHash, with candidates from bands and sequential Bayesian verification.

A document is the set of its word shingles; documents with one and the same set are one node. A node's signature has
BANDS x BAND hashes; nodes that agree in a whole band share a bucket. Two nodes of likeness 0.8 share none of 48 bands
of five with a probability of 5e-9. Of each hash eight bits are kept, and they are compared STEP at a time: with m
matches among n, a uniform prior gives the posterior probability that the likeness is 0.8 or more, and a pair whose
probability falls below MISS is dropped. What survives is verified on the full sets.

Buckets are never paired out. First every node is compared with one other only, the pivot that it shares most buckets
with; the links found this way are contracted, which leaves a group of near copies with fewer components. Then nodes of different components within a bucket are compared by signature, in cells of bounded size, and
only a spanning forest of what survives goes on: its trees are the neighbourhoods outside of which no link is left. In
cells of a neighbourhood the full sets meet, and every surviving pair whose components aren't joined yet is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.simhash import _roots
from lodestone.plans.storage import saved, ship, stored

BAND, BANDS = 5, 48
STEP = 16  # hashes compared at a time
MISS = 1e-9  # posterior probability of a link below which a pair is dropped
SLICE = 1024  # nodes of a bucket that one cell takes from either side, about
AT_ONCE = 1 << 18  # pairs compared at a time
SALTS = 256  # tasks that the partners of one node can be dealt to
SHINGLES_AT_ONCE = 1 << 12
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(1, 1 << 63, BAND * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SEEDS = _RNG.integers(1, 1 << 63, BANDS, np.uint64)


def shingles(text: bytes, shingle: int = 4) -> np.ndarray:
    """The set of shingles of UTF-8 ``text`` as sorted distinct 64-bit hashes.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``shingle`` words joined by a
    space. Fewer words form one shingle; without a word the set is empty.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.array([digest(flat[i:j]) for i, j in zip(first, last)], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set (not empty) under each of the hash functions, 32 bits each."""
    least = np.full(len(_FACTORS), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        np.minimum(least, (hashes[at : at + SHINGLES_AT_ONCE, None] * _FACTORS).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature (rows)."""
    h = (signatures.reshape(-1, BANDS, BAND).astype(np.uint64) * _MIX).sum(2, dtype=np.uint64) + _BAND_SEEDS
    h = (h ^ h >> np.uint64(31)) * _MIX[0]
    return h ^ h >> np.uint64(29)


def tail(m: int, n: int, p: float) -> float:
    """P(at most m of n) of a binomial, which is the posterior P(likelihood >= p) after m matches in n - 1 trials under a uniform prior."""
    return sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * log(p) + (n - j) * log1p(-p)) for j in range(min(m, n) + 1))


@cache
def needed(least: float, miss: float = MISS) -> tuple[int, ...]:
    """After each step of STEP hashes, the fewest matches with which a pair may still have a likeness of ``least``, but for a posterior probability of ``miss``.

    Eight bits of two different hashes match once in 256 times.
    """
    p = least + (1 - least) / 256
    if p >= 1:
        return tuple(range(STEP, BAND * BANDS + 1, STEP))
    return tuple(next(m for m in range(n + 1) if tail(m, n + 1, p) >= miss) for n in range(STEP, BAND * BANDS + 1, STEP))


def surviving(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Numbers of those rows of two equally long tables of signatures (uint8) that are not dropped on the way."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, need in enumerate(needed(least)):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (left[alive, cut] == right[alive, cut]).sum(1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for two sets as sorted distinct arrays."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, n, digest, sig, bands) for every row of ``docs``: the set's size and 128-bit digest, eight bits of each hash, and a key for each band. An empty set has neither."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, sigs, bands = [], [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                mine = shingles(text or b"", shingle)
                n.append(len(mine))
                digests.append(_digest(mine))
                sig = signature(mine) if len(mine) else None
                sigs.append(None if sig is None else sig.astype(np.uint8).tobytes())
                bands.append(None if sig is None else band_keys(sig)[0].view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sig", "bands"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, digest binary, sig binary, bands array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(node, data): the full sets of ``nodes`` (node, first, digest), made again from the texts of the documents ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t or b"", shingle) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "data"])

    wanted = nodes.select(F.col("first").alias("doc_id")).distinct()
    rows = _rows(docs, id_col, text_col)
    texts = rows.join(wanted, rows.doc_id.eqNullSafe(wanted.doc_id), "left_semi").select("text")
    return texts.mapInArrow(run, "digest binary, data binary").join(nodes.select("digest", "node"), "digest").select("node", "data").dropDuplicates(["node"])


def met(pairs: DataFrame, data: DataFrame, test: Callable[[bytes, list[bytes]], list[int]]) -> DataFrame:
    """Those ``pairs`` (a, b) that pass ``test``, which gets a's data and those of some of its partners and returns the numbers of those that pass; ``data`` has (node, data).

    a's data goes to its partners, once for each of up to SALTS tasks that they are dealt to.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    partners = salted.join(data.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "data")
    hubs = salted.select("a", "salt").distinct().join(data.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "data")
    rows = partners.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, b""
        for batch in batches:
            a, salt, b, data = (c.to_pylist() for c in batch.columns)
            out: tuple[list[int], list[int]] = ([], [])
            at = 0
            while at < len(a):
                if b[at] is None:
                    now, own = (a[at], salt[at]), data[at]
                    at += 1
                    continue
                stop = at
                while stop < len(a) and b[stop] is not None and (a[stop], salt[stop]) == now:
                    stop += 1
                if stop == at:
                    raise ValueError(f"partners without {a[at]}")
                good = [at + i for i in test(own, data[at:stop])]
                out[0].extend([now[0]] * len(good))
                out[1].extend(b[i] for i in good)
                at = stop
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those ``pairs`` (a, b) that comparing the signatures of ``nodes`` step by step doesn't drop."""

    def test(own: bytes, others: list[bytes]) -> list[int]:
        right = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), -1)
        return surviving(np.broadcast_to(np.frombuffer(own, np.uint8), right.shape), right, least).tolist()

    return met(pairs, nodes.select("node", F.col("sig").alias("data")), test)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b) that are links by their full ``sets``."""

    def test(own: bytes, others: list[bytes]) -> list[int]:
        mine = np.frombuffer(own, np.uint64)
        return [i for i, x in enumerate(others) if alike(mine, np.frombuffer(x, np.uint64), percent)]

    return met(pairs, sets, test)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, node, pivot): nodes of the buckets that more than one node is in, and the least of them."""
    places = nodes.select("node", F.explode("bands").alias("key"))
    # The key's complement: both sides are shuffled for this join and nothing else, so a hot bucket can be split.
    least = places.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select(F.bitwise_not("key").alias("other"), "pivot")
    return places.withColumn("other", F.bitwise_not("key")).join(least, "other").select("key", "node", "pivot")


def _celled(kept: dict[str, Callable[[pa.Array], np.ndarray]], compare: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``compare`` on every cell, a run of equal first two columns (key, cell); a cell can span batches. ``kept`` has the other columns and how to read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def out(rows: list) -> Iterator[pa.RecordBatch]:
            key = rows[0]
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                for a, b in compare(*(x[i:j] for x in rows[1:])):
                    yield pa.record_batch([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)], 1)
            new = [key, *(read(b.column(name)) for name, read in kept.items())]
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            same = (rows[0] == rows[0][-1]).all(1)
            cut = int(np.argmax(same))  # the last cell may go on in the next batch
            if cut:
                yield from out([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield from out(held)

    return run


def _plain(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _signed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _survivors(own: np.ndarray, root: np.ndarray, sig: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the pairs of a cell that lie in different components and aren't dropped, AT_ONCE pairs at a time.

    Rows are sorted by slice; in a cell of two slices only pairs across them are compared, the others have their own cells.
    """
    n, half = len(own), int((own == own[0]).sum())
    first = np.arange(n) + 1 if half == n else np.where(np.arange(n) < half, half, n)
    work = np.cumsum(n - first)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + AT_ONCE, "right")))
        w = (n - first)[start:stop]
        left = np.repeat(np.arange(start, stop), w)
        right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + first[left]
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
        if len(left):
            keep = surviving(sig[left], sig[right], least)
            yield left[keep], right[keep]
        start = stop


def neighbourhoods(shared: DataFrame, roots: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): a forest whose trees hold all pairs that share a bucket, lie in different components (``roots``: node, root) and aren't dropped on the way.

    A bucket's nodes are dealt to slices of about SLICE; any two slices meet in a cell, which sends on a spanning forest
    of its pairs. Buckets within one component are left out as a whole.
    """
    placed = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    slices = mixed.select(F.bitwise_not("key").alias("other"), F.ceil(F.col("n") / SLICE).cast("int").alias("s"))
    own = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    dealt = placed.withColumn("other", F.bitwise_not("key")).join(slices, "other").withColumn("own", own)
    cell = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.least("own", j) * F.col("s") + F.greatest("own", j))
    cells = dealt.select("key", F.explode(cell).alias("cell"), "own", "node", "root").join(nodes.select("node", "sig"), "node")
    rows = cells.select("key", "cell", "own", "node", "root", "sig").repartition("key", "cell").sortWithinPartitions("key", "cell", "own", "node")

    def compare(own: np.ndarray, node: np.ndarray, root: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        tree = np.arange(len(node))
        for left, right in _survivors(own, root, sig, least):
            tree = _roots(len(node), np.concatenate((left, np.arange(len(node)))), np.concatenate((right, tree)))
        off = np.flatnonzero(tree != np.arange(len(node)))
        if len(off):
            yield node[off], node[tree[off]]

    kept = {"own": _plain, "node": _plain, "root": _plain, "sig": _signed}
    return rows.mapInArrow(_celled(kept, compare), "a long, b long").distinct()


def joined_within(trees: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): true links that join all of the components (``roots``) which any link joins within one of ``trees`` (node, tree).

    A tree's largest component and its other nodes are dealt to slices of about SLICE of their own. Any two slices meet
    in a cell but for those of the largest component, so its nodes' sets go out once for each slice of the others.
    """
    least = percent / 100
    placed = saved(trees.join(roots, "node", "left").select("tree", "node", F.coalesce("root", "node").alias("root")))
    sizes = placed.groupBy("tree", "root").agg(F.count("*").alias("n"))
    of = sizes.groupBy("tree").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("n"))
    parts = of.select(F.bitwise_not("tree").alias("other"), F.col("major.root").alias("major"), F.ceil(F.col("major.n") / SLICE).cast("int").alias("p"), F.ceil((F.col("n") - F.col("major.n")) / SLICE).cast("int").alias("q"))
    dealt = placed.withColumn("other", F.bitwise_not("tree")).join(parts, "other").withColumn("high", F.col("p") + F.col("q"))
    inside = F.col("root") == F.col("major")
    own = F.when(inside, F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.greatest("q", F.lit(1)))).cast("int")
    others = F.when(inside, F.sequence("p", F.col("high") - 1)).otherwise(F.sequence(F.lit(0), F.col("high") - 1))
    cell = F.transform(others, lambda j: F.least("own", j) * F.col("high") + F.greatest("own", j))
    cells = dealt.where("q > 0").withColumn("own", own).select("tree", F.explode(cell).alias("cell"), "own", "node", "root")
    rows = cells.join(nodes.select("node", "sig"), "node").join(sets, "node").select("tree", "cell", "own", "node", "root", "sig", "data").repartition("tree", "cell").sortWithinPartitions("tree", "cell", "own", "node")

    def compare(own: np.ndarray, node: np.ndarray, root: np.ndarray, sig: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, group = np.unique(root, return_inverse=True)
        up = list(range(int(group.max()) + 1))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        found: tuple[list[int], list[int]] = ([], [])
        arrays = [np.frombuffer(d, np.uint64) for d in data]
        for left, right in _survivors(own, root, sig, least):
            for i, j in zip(left.tolist(), right.tolist()):
                x, y = top(group[i]), top(group[j])
                if x != y and alike(arrays[i], arrays[j], percent):
                    up[x] = y
                    found[0].append(node[i])
                    found[1].append(node[j])
        if found[0]:
            yield np.array(found[0], np.int64), np.array(found[1], np.int64)

    kept = {"own": _plain, "node": _plain, "root": _plain, "sig": _signed, "data": _objects}
    return rows.mapInArrow(_celled(kept, compare), "a long, b long").distinct()


def stars(shared: DataFrame) -> DataFrame:
    """(a, b): for every node b of ``shared`` the pivot a that it shares most buckets with, other than itself."""
    often = shared.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    best = often.groupBy("node").agg(F.max(F.struct("n", (-F.col("pivot")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), F.col("node").alias("b"))


def near_links(docs: DataFrame, nodes: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(u, v): links that connect all ``nodes`` (node, first, digest, sig, bands) of a likeness of ``percent`` or more; each is a true link, but within a component not every link is listed."""
    least = percent / 100
    shared = stored(shared_buckets(nodes), "minhash-buckets")
    # Texts are gone through once more, for the nodes that share a bucket with another, whose sets are kept.
    sets = stored(full_sets(docs, nodes.select("node", "first", "digest").join(shared.select("node").distinct(), "node", "left_semi"), id_col, text_col, shingle), "minhash-sets")
    pairs = plausible(stars(shared), nodes, least)
    links = saved(confirmed(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = saved(connected_components(links))
    forest = neighbourhoods(shared, roots, nodes, least).select(F.col("a").alias("u"), F.col("b").alias("v"))
    trees = connected_components(forest).withColumnRenamed("root", "tree")
    more = joined_within(trees, roots, nodes, sets, percent)
    return saved(links.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of shingles; ``component_id`` is the
    smallest doc_id reached over links, ``kept`` says whether it is the row's own. Sets are held as 64-bit hashes. Null
    and blank texts have an empty set and are linked with nothing. A null doc_id gets its component as well (null if no
    member has an id; it is kept then); repeated ids and rows keep a row each. Other columns don't matter. An empty
    table gives an empty result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent lies above 0 and is at most 100")
    # Rows get a number of their own, which the smallest row of a set lends to its node; it holds once they are stored.
    rows = stored(signatures(docs, id_col, text_col, shingle).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    classes = saved(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")))
    nodes = stored(rows.select(F.col("row").alias("node"), "sig", "bands").join(classes, "node"), "minhash-nodes")
    roots = connected_components(near_links(docs, nodes, percent, id_col, text_col, shingle))
    joined = saved(classes.join(roots, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root")))
    # A component's least id goes to its members by a key of its own, so that a large component can be split.
    least = joined.groupBy("root").agg(F.min("first").alias("component_id")).select(F.bitwise_not("root").alias("other"), "component_id")
    named = saved(joined.withColumn("other", F.bitwise_not("root")).join(least, "other").select("digest", "component_id"))
    linked = rows.where("n > 0").select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id")
    every = linked.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
