"""Mixing sources to target weights, by hierarchical budgeting. DataFrame functions only.

A budget of tokens flows down a tree (domain, language, source). Every node's capacity is what its leaves hold, times
the epochs allowed. Among siblings the budget is dealt by weight; a child that can't take its share is filled, and
what it leaves goes to its siblings by weight. A node's own shortage shows in its capacity, so it is dealt to the
node's siblings one level up before it moves further. Each leaf then takes whole seeded epochs and, of the last one, the
prefix in seeded order that fits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.storage import saved

SMALL = 50_000  # leaves that are sent to every task, at most
DIGITS = 3  # hex digits of the order's hash that name a bucket of a leaf's epoch


def word_count(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in sorted(weights.items()):
        if w < 1:
            raise ValueError("weights are positive whole numbers")
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def dealt(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``children`` (parent columns, name, weight, capacity, budget of the parent) with ``given``, the child's budget.

    A child is filled if its capacity is no more than its share of what the children filled before it leave; they are
    gone through by capacity for each unit of weight. All numbers are whole, shares are rounded down. The windows run
    over the children of one node, not over documents.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", name) if parent else Window.partitionBy(F.lit(0)).orderBy("ratio", name)
    ahead, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    out = children.withColumn("ratio", F.col("capacity").cast("double") / F.col("weight"))
    out = out.withColumn("taken", F.coalesce(F.sum("capacity").over(ahead), F.lit(0))).withColumn("heavy", F.sum("weight").over(behind))
    wide = lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    out = out.withColumn("full", wide(F.col("capacity"), F.col("heavy")) <= wide(F.col("weight"), F.greatest(F.col("budget") - F.col("taken"), F.lit(0))))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(all_), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_)
    share = F.floor(wide(rest, F.col("weight")) / open_).cast("long")
    given = F.when(F.col("full"), F.col("capacity")).otherwise(share)
    return out.withColumn("given", given).drop("ratio", "taken", "heavy", "full")


def leaf_budgets(have: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], budget: int | None, max_epochs: int) -> DataFrame:
    """(levels, have, given) for each leaf of ``have`` (levels, have); ``budget`` None stands for all tokens there are."""
    leaves = have.withColumn("capacity", F.col("have") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("have"), F.lit(0)).alias("have"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("capacity")).first()
    nodes = leaves.groupBy(levels[0]).agg(F.sum("capacity").alias("capacity")).withColumn("budget", F.lit(min(total.have if budget is None else budget, total.capacity)).cast("long"))
    for i, level in enumerate(levels):
        above = list(levels[:i])
        nodes = dealt(nodes.withColumn("weight", _weight(level, weights[i])), above, level).select(*levels[: i + 1], F.col("given").alias("budget"))
        if i + 1 < len(levels):
            below = leaves.groupBy(*levels[: i + 2]).agg(F.sum("capacity").alias("capacity"))
            nodes = below.join(nodes, list(levels[: i + 1]))
    return leaves.join(nodes, list(levels)).select(*levels, "have", F.col("budget").alias("given"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, int]], budget: int | None = None, max_epochs: int = 4, seed: int = 1, tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs``, its columns as they are, as often as they are selected, with the levels, the number of tokens and ``epoch`` (from 0).

    A new column whose name ``docs`` has already gets underscores behind it. A null in a level is its empty name; names
    without a weight weigh 1. Epoch e of a leaf is its documents in the order of md5(seed:e:id), then of id and text
    hash; documents are taken as long as the sum of tokens stays within the leaf's budget. Null ids sort as the word
    null; repeated rows are separate documents, in any order among themselves. Documents without tokens ride along where
    their place in the order is within the prefix; a leaf of none but such documents is taken once, as epoch 0, whatever
    the budget. An empty table gives an empty result.

    The order is found in two steps: sums by bucket of the hash, then a window within the bucket in which the budget
    ends, and in that alone. The window over a leaf's buckets has at most 16^DIGITS = 4,096 rows, however many
    documents the leaf has; it is all that a hot leaf puts into one task.
    """
    names, kept = [f"level{i}" for i in range(len(levels))], [f"c{i}" for i in range(len(docs.columns))]
    base = docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)],
        *[F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in zip(names, levels.values())],
        (word_count(F.col(text_col)) if tokens is None else tokens).alias("tokens"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"),
    )
    have = saved(base.groupBy(*names).agg(F.sum("tokens").alias("have")))
    leaves = saved(leaf_budgets(have, names, weights, budget, max_epochs).select(
        *names, F.when(F.col("have") == 0, 1).otherwise(F.coalesce(F.expr("given div nullif(have, 0)"), F.lit(0))).cast("int").alias("full"), F.coalesce(F.expr("given % nullif(have, 0)"), F.lit(0)).alias("rest")))
    small = F.broadcast if leaves.count() <= SMALL else lambda df: df  # then a leaf's documents stay where they are
    rows = base.join(small(leaves), names)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"))
    rows = rows.withColumn("order", order).withColumn("bucket", F.substring("order", 1, DIGITS))
    sums = rows.groupBy(*names, "bucket").agg(F.sum("tokens").alias("own"))
    ahead = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("own").over(ahead), F.lit(0)))
    ends = sums.join(small(leaves), names).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("own")))
    # A leaf has one bucket in which its budget ends (none if it ends with the epoch, of which nothing is left then).
    ends = ends.select(*names, F.col("bucket").alias("end"), "before")
    rows = rows.join(small(ends), names, "left")
    epochs = rows.where("full > 0").withColumn("epoch", F.explode(F.expr("sequence(0, full - 1)")))
    below = rows.where("rest > 0 and bucket < end").withColumn("epoch", F.col("full"))
    within = Window.partitionBy(*names, "bucket").orderBy("order", "id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("rest > 0 and bucket = end").withColumn("upto", F.col("before") + F.sum("tokens").over(within))
    edge = edge.where("upto <= rest").withColumn("epoch", F.col("full"))
    inner, new = [*kept, *names, "tokens", "epoch"], []
    for name in (*levels, n_tokens, "epoch"):
        while name.lower() in {c.lower() for c in (*docs.columns, *new)}:
            name += "_"
        new.append(name)
    out = epochs.select(*inner).unionByName(below.select(*inner)).unionByName(edge.select(*inner))
    return out.select(*[F.col(i).alias(o) for i, o in zip(inner, (*docs.columns, *new))])


# What the query and the pipeline use: domains by the source's number, and whole-number weights.
DOMAINS = ("web", "books", "forum")
WEIGHTS = ({"web": 5, "books": 3, "forum": 3}, {"en": 6, "de": 2, "fr": 2, "es": 2}, {})


def document_levels() -> dict[str, Column]:
    """domain, lang and source of the table documents: the source's number modulo three names the domain."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long"), F.lit(0))
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (number % 3 + 1).cast("int"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
