"""Neighbour graphs by descent: a neighbour's neighbours are likely neighbours, so lists are improved from each other.

The start is exact within small groups of vectors that lie on the same side of a few random planes. In every round each
vector looks at a bounded sample of its list and of the lists that it is in, and these meet each other: what was new on
either side is measured, and whoever is nearer than the last of the other's list takes its place. Rounds end once few
places change. Work is proportional to n in each round, and the number of rounds grows slowly with n.

Neighbourhoods meet in cells of many vectors: a vector goes once to each cell that needs it, not to each neighbourhood,
and a cell sends on no more than k finds for each vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import Metric
from lodestone.operators.exact import DimensionMismatchError, _distances, _exact, _matrix
from lodestone.plans.storage import saved, ship

GROUP = 1024  # vectors of a group at the start, about; none has more than twice as many. Better lists at the start save rounds
STARTS = 3  # sets of planes
CELL = 49_152  # vectors whose neighbourhoods meet in one task, at most about
STEP = 16_384  # pairs measured at once
HELD = 4_000_000  # finds that a cell holds before it drops all but the best
EDGE = "src long, dst long, distance double"


def _improved(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance, fresh, before): the ``k`` nearest of each src of (src, dst, distance, before, unseen); fresh unless an edge was there before and has been looked at."""
    held = edges.repartition("src")  # this way the rest needs no other exchange
    once = held.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.max("before").alias("before"), F.max("unseen").alias("unseen"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return once.withColumn("place", place).where(F.col("place") <= k).select("src", "dst", "distance", (~F.col("before") | F.col("unseen")).alias("fresh"), "before")


def cells_of(spark, n: int) -> int:
    """Into how many cells ``n`` vectors go: of CELL at most about, and where that would leave cores idle, smaller ones."""
    return max(1, -(-n // CELL), min(spark.sparkContext.defaultParallelism, -(-n // 1024)))


def in_cells(refs: DataFrame, by: str, members: list[str], data: DataFrame, cells: int, of_cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``of_cell`` of ``refs``, dealt to cells by a hash of column ``by``, and those rows of ``data`` (id, ...) that its ``members`` name, once for each cell."""
    placed = refs.withColumn("cell", F.pmod(F.xxhash64(by), F.lit(cells)).cast("int"))
    named = placed.select("cell", F.explode(F.array(*members)).alias("id")).groupBy("id").agg(F.collect_set("cell").alias("cells"))
    sent = named.join(data, "id").select(F.explode("cells").alias("cell"), *data.columns)
    return placed.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(of_cell, schema)


def sorted_rows(known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, their vectors, and the order."""
    ids = known.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], _matrix(known.column("vector"))[order], order


def _best_finds(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of finds (a, b, distance), each pair once, the ``k`` nearest of each a, in order."""
    pair = a * n + b
    order = np.lexsort((d, pair))
    order = order[np.diff(pair[order], prepend=-1) != 0]
    order = order[np.lexsort((b[order], d[order], a[order]))]
    first = np.flatnonzero(np.diff(a[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
    order = order[place < k]
    return a[order], b[order], d[order]


def _finds(centre: np.ndarray, member: np.ndarray, fresh: np.ndarray, worst: np.ndarray, x: np.ndarray, k: int) -> tuple[tuple[np.ndarray, ...], int]:
    """What the members of each centre find in each other, (a, b, distance) as places in ``x``, the ``k`` nearest of each a at most; and the number of distances."""
    worst, n, work = worst.copy(), len(x), 0
    order = np.lexsort((~fresh, member, centre))
    centre, member, fresh = centre[order], member[order], fresh[order]
    once = (np.diff(centre, prepend=centre[0] - 1) != 0) | (np.diff(member, prepend=-1) != 0)
    centre, member, fresh = centre[once], member[once], fresh[once]
    first = np.flatnonzero(np.diff(centre, prepend=centre[0] - 1))
    size = np.diff(first, append=len(centre))
    some = np.add.reduceat(fresh.astype(np.int64), first) > 0
    none = np.zeros(0, np.int64)
    best, held, n_held = (none, none, np.zeros(0)), [], 0

    def settle() -> None:
        nonlocal best, held, n_held
        best = _best_finds(*(np.concatenate(c) for c in zip(best, *held)), n, k)
        full = np.flatnonzero(np.bincount(best[0], minlength=n) >= k)
        last = np.searchsorted(best[0], full, "right") - 1
        worst[full] = np.minimum(worst[full], best[2][last])
        held, n_held = [], 0

    for s in np.unique(size[some]).tolist():  # centres with as many members are measured together
        mine = first[some & (size == s)]
        step = max(1, 1_000_000 // (s * s + s * x.shape[1]))
        for at in range(0, len(mine), step):
            rows = mine[at : at + step, None] + np.arange(s)
            m, new = member[rows], fresh[rows]
            y = x[m].astype(np.float64)
            square = (y * y).sum(2)
            d = np.sqrt(np.maximum(square[:, :, None] + square[:, None] - 2 * y @ y.transpose(0, 2, 1), 0))
            work += d.size
            g, i, j = np.nonzero((new[:, :, None] | new[:, None]) & (d < worst[m][:, :, None]) & ~np.eye(s, dtype=bool))
            held.append((m[g, i], m[g, j], d[g, i, j]))
            n_held += len(g)
            if n_held > HELD:
                settle()
    settle()
    return best, work


def _streamed(batches: Iterator[pa.RecordBatch], of_group) -> Iterator[pa.RecordBatch]:
    """What ``of_group`` makes of every run of equal first columns (src, dst, distance); a run can span batches."""
    held: pa.Table | None = None

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key = table.column(0).to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        columns = [c.to_numpy() if not pa.types.is_list(c.type) else _matrix(c) for c in table.columns[1:]]
        made = [of_group(*(c[i:j] for c in columns)) for i, j in zip(edge[:-1], edge[1:])]
        cols = [np.concatenate(x) for x in zip(*made)]
        yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["src", "dst", "distance"])

    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        table = table if held is None else pa.concat_tables([held, table])
        key = table.column(0).to_numpy()
        cut = int(np.argmax(key == key[-1]))
        if cut:
            yield from out(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None:
        yield from out(held)


def start_lists(data: DataFrame, k: int, n: int, seed: int = 42, work: Accumulator | None = None) -> DataFrame:
    """(src, dst, distance): the ``k`` nearest within each of STARTS groups that a vector is in.

    A group's vectors lie on the same side of log2(n / GROUP) random planes through the mean; larger groups are dealt to
    slices by a hash of the id.
    """
    mean = np.array(data.agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(len(data.first().vector))]).alias("m")).first().m)
    rng = np.random.default_rng(seed)
    bits = max(0, ceil(log2(max(1, n / GROUP))))
    planes = rng.normal(size=(STARTS, bits, len(mean)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                side = np.einsum("tbd,nd->tnb", planes, _matrix(b.column(1)) - mean) > 0
                group = (side * (1 << np.arange(bits))).sum(2) + (np.arange(STARTS) << bits)[:, None]
                take = pa.array(np.tile(np.arange(b.num_rows), STARTS))
                yield pa.record_batch([pa.array(group.ravel().astype(np.int64)), b.column(0).take(take), b.column(1).take(take)], ["group", "id", "vector"])

    def nearest(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        x = x.astype(np.float64)
        d = _distances(Metric.EUCLIDEAN, x, x)
        np.fill_diagonal(d, np.inf)
        most = min(k, len(ids) - 1)
        if work is not None:
            work.add(len(ids) ** 2)
        near = np.argpartition(d, most - 1, 1)[:, :most] if 0 < most < len(ids) - 1 else np.argsort(d, 1, kind="stable")[:, :most]
        return np.repeat(ids, most), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()

    grouped = data.select("id", "vector").mapInArrow(placed, f"group long, id long, vector {data.schema['vector'].dataType.simpleString()}")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n")).select(F.bitwise_not("group").alias("other"), F.ceil(F.col("n") / GROUP).alias("slices"))
    sliced = grouped.withColumn("other", F.bitwise_not("group")).join(sizes, "other")
    cell = F.col("group") * F.lit(1 << 20) + F.pmod(F.xxhash64("id"), F.col("slices"))
    rows = sliced.select(cell.alias("cell"), "id", "vector").repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(lambda batches: _streamed(batches, nearest), EDGE)


def _shrunk(data: DataFrame, metric: Metric) -> DataFrame:
    """(id, vector array<float>): vectors whose Euclidean distances rank as ``data``'s by ``metric``: of length 1 under cosine, else around the mean and within 1."""
    dim = len(data.first().vector)
    spread = data.agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(dim)]).alias("mean"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    mean, most = np.array(spread.mean, float), 2 * float(spread.most)
    if not (np.isfinite(mean).all() and np.isfinite(most) and most > 0):
        mean, most = np.zeros(dim), 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                if x.shape[1] != dim:
                    raise DimensionMismatchError(f"expected dimension {dim}, got {x.shape[1]}")
                if metric is Metric.EUCLIDEAN:
                    y = (x - mean) / most
                else:
                    norm = np.linalg.norm(x, axis=1)
                    if not norm.all():
                        raise ValueError("cosine distance of a zero vector")
                    y = x / norm[:, None]
                flat = pa.array(y.astype(np.float32).ravel())
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(y) * dim + 1, dim, dtype=np.int32)), flat)], ["id", "vector"])

    return saved(data.mapInArrow(run, "id long, vector array<float>"))


def descended(data: DataFrame, k: int, metric: Metric = Metric.EUCLIDEAN, sample: int | None = None, settled: float = 0.005, rounds: int = 24, seed: int = 42, work: Accumulator | None = None) -> DataFrame:
    """(src, rank, dst, distance): about the ``k`` nearest others of every row of ``data`` (id, vector); ids are unique.

    In a round each vector takes ``sample`` (1.5 k, if None) of its list and as many of the lists it is in. Rounds end once
    fewer than ``settled`` of all places change, or after ``rounds``. Approximate, and rounds measure in floats; the
    distances given are exact. Rows without id or vector take no part; with fewer than two rows there are no edges.
    ``work`` counts the distances measured.
    """
    if k <= 0:
        raise ValueError("the limit must be above 0")
    spark = data.sparkSession
    ship(spark)
    sample = sample or ceil(1.5 * k)
    data = saved(data.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")))
    n = data.count()
    if n < 2:
        return spark.createDataFrame([], "src long, rank int, dst long, distance double")
    small, cells = _shrunk(data, metric), cells_of(spark, n)

    def meet(refs: pa.Table, known: pa.Table) -> pa.Table:
        ids, x, order = sorted_rows(known)
        member = np.searchsorted(ids, refs.column("member").to_numpy())
        (a, b, d), n_measured = _finds(refs.column("centre").to_numpy(), member, refs.column("fresh").to_numpy(zero_copy_only=False).astype(bool), known.column("worst").to_numpy()[order], x, k)
        if work is not None:
            work.add(n_measured)
        return pa.table({"src": ids[a], "dst": ids[b], "distance": d})

    start = start_lists(small, k, n, seed, work).withColumns({"before": F.lit(False), "unseen": F.lit(True)})
    lists = saved(_improved(start, k))
    for turn in range(rounds):
        shuffled = F.xxhash64("src", "dst", F.lit(seed + turn))
        place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.col("fresh").desc(), shuffled))
        # No list is longer than k, so a sample of k or more is all of it.
        own = (lists.withColumn("seen", F.lit(True)) if sample >= k else lists.withColumn("seen", place("src") <= sample)).drop("before")
        mine = own.where("seen").select(F.col("src").alias("centre"), F.col("dst").alias("member"), "fresh")
        others = lists.withColumn("p", place("dst")).where(F.col("p") <= sample).select(F.col("dst").alias("centre"), F.col("src").alias("member"), "fresh")
        # A list that isn't full takes anything.
        last = lists.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") < k, F.lit(float("inf"))).otherwise(F.max("distance")).alias("worst"))
        known = small.join(last, "id", "left").select("id", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "vector")
        met = in_cells(mine.unionByName(others), "centre", ["member"], known, cells, meet, EDGE)
        # What was looked at is no longer new; what had no place in the sample stays so.
        old = own.select("src", "dst", "distance", F.lit(True).alias("before"), (F.col("fresh") & ~F.col("seen")).alias("unseen"))
        lists = saved(_improved(old.unionByName(met.withColumns({"before": F.lit(False), "unseen": F.lit(False)})), k))
        if lists.where("not before").count() < settled * n * k:
            break
    # Floats and products can be off by their rounding; the distances given are measured term by term.
    place = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    return measured(lists.select("src", "dst"), data, metric).withColumn("rank", place).select("src", "rank", "dst", "distance")


def measured(pairs: DataFrame, data: DataFrame, metric: Metric = Metric.EUCLIDEAN) -> DataFrame:
    """(src, dst, distance) for ``pairs`` (src, dst), term by term, many in one call."""
    ship(data.sparkSession)

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        ids, x, _ = sorted_rows(known)
        src, dst = asked.column("src").to_numpy(), asked.column("dst").to_numpy()
        a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        d = [_exact(metric, x[a[i : i + STEP]], x[b[i : i + STEP], None])[:, 0] for i in range(0, len(a), STEP)]
        return pa.table({"src": src, "dst": dst, "distance": np.concatenate(d)})

    return in_cells(pairs.select("src", "dst"), "src", ["src", "dst"], data.select("id", "vector"), cells_of(data.sparkSession, data.count()), run, EDGE)
