"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a budget by weight; none takes more than `most` times its own
size, the excess goes to the others.  A source takes whole passes over all its
documents while they fit; the rest of its budget is filled from its counts of
documents by exact length: in proportion down to LONGEST times the longest
length, and from there by bounded-knapsack dynamic programming over the
lengths, which finds the nearest sum there is.  Where that rest is above CELLS
words, it is first fitted in larger units, and again in smaller ones.  The plan says how many documents of each
length join in; which ones is decided by a seeded hash.

Sources may be many: their targets are found by sums over the table of
sources, of which the driver holds a few numbers only.

A hot (source, length) is never ranked in one task: its documents fall into
buckets of about BUCKET rows by their hash, bucket counts tell which bucket is
cut, and ranks are taken inside buckets only.

Defined results: null and empty texts have size 0, take nothing and change
nothing; a null source is a source and the last one; sources of size 0 have
target 0; repeated rows are documents of their own; reruns agree.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (3, 1, 2)
SHARE, MOST = Fraction(3, 2), 2
#: Words that the knapsack fits, in lengths of the longest document, and its greatest number of cells.
LONGEST, CELLS = 16, 1 << 24
#: Rows of sources that are broadcast.
BROADCAST_SOURCES = 100_000
BUCKET = 1000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of every row of sources(source, source_size).

    Sources are ordered by code point, null last, and weigh as they stand in
    turn.  A source held at its limit stays so: the others' level only rises.
    """
    # the place of a source among all, from the counts of sorted partitions
    ranged = cut(sources.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    placed = ranged.join(F.broadcast(parts.select("part", "before")), "part").withColumn("place", F.col("before") + inside - 1)
    weight = F.array(*map(F.lit, weights))[F.pmod("place", F.lit(len(weights))).cast("int")]
    weighed = cut(placed.select("source", "source_size", weight.cast("decimal(38,0)").alias("weight")))
    size = F.col("source_size").cast("decimal(38,0)")
    budget = Fraction(share) * int(weighed.agg(F.sum(size)).first()[0] or 0)
    level, held = Fraction(0), (-1, 0, 0)
    above = F.lit(False)
    while True:
        # words of the sources at their limit, and the weight of the others
        words, free, n = weighed.agg(F.sum(F.when(above, size)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == held[0] or not free:
            break
        held = (n, int(words or 0), int(free))
        level = (budget - most * held[1]) / held[2]
        above = F.expr(f"weight * cast('{level.numerator}' as decimal(38,0)) > source_size * cast('{most * level.denominator}' as decimal(38,0))")
    target = F.when(above, (most * F.col("source_size")).cast("double"))
    for w in dict.fromkeys(weights):
        target = target.when(F.col("weight") == w, F.lit(float(level * w)))
    return weighed.select("source", "source_size", target.alias("target"))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length, their sum as near below the budget as can be."""
    out = [0] * len(lengths)
    made = np.full(budget + 1, -1, dtype=np.int32)  # the part that first made a sum
    made[0] = 0
    parts: list[tuple[int, int]] = [(0, 0)]
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, part = min(count, budget // length), 1
        while left > 0 and made[budget] < 0:  # multiples by binary parts
            n = min(part, left)
            step = n * length
            new = np.flatnonzero((made[: budget + 1 - step] >= 0) & (made[step:] < 0)) + step
            made[new] = len(parts)
            parts.append((k, n))
            left -= n
            part *= 2
        if made[budget] >= 0:
            break
    at = int(np.flatnonzero(made >= 0)[-1])
    while at:  # what a part was added to had been made before it
        k, n = parts[made[at]]
        out[k] += n
        at -= n * lengths[k]
    return out


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length fill the budget; lengths are positive and distinct."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = min(budget, total)
    if not total or budget <= 0:
        return [0] * len(lengths)
    rest = min(budget, LONGEST * max(lengths))
    take = [(budget - rest) * c // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    # the greatest remainders first, until the rest is the knapsack's
    for k in sorted(range(len(lengths)), key=lambda k: (-((budget - rest) * counts[k] % total), lengths[k])):
        if left <= rest:
            break
        if take[k] < counts[k] and lengths[k] <= left:
            take[k] += 1
            left -= lengths[k]
    while left > 0:
        unit = -(-left // CELLS)
        order = sorted((k for k in range(len(lengths)) if take[k] < counts[k] and lengths[k] <= left), key=lambda k: -lengths[k])
        more = knapsack([-(-lengths[k] // unit) for k in order], [counts[k] - take[k] for k in order], left // unit)
        for k, n in zip(order, more, strict=True):
            take[k] += n
            left -= n * lengths[k]
        if unit == 1 or not any(more):
            break
    return take


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row, and `row`, a hash of doc_id and text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("row")))
    counts = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = cut(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))))
    few = goals.count() <= BROADCAST_SOURCES

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["size"] > 0].sort_values("size")
        if not len(group):
            return pd.DataFrame({"source": [], "size": [], "n": [], "passes": [], "extra": []})
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = int(target // whole)
        extra = fill(group["size"].tolist(), group["n"].tolist(), int(round(target - passes * whole)))
        return pd.DataFrame({"source": group["source"], "size": group["size"], "n": group["n"], "passes": passes, "extra": np.array(extra, dtype=np.int64)})

    known = counts.alias("c").join(goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.source", "size", "n", "source_size", "target")
    planned = cut(known.groupBy("source").applyInPandas(plan, "source string, size long, n long, passes long, extra long"))
    p = planned.select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "passes", "extra")
    drawn = rows.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "left").drop("p_source", "p_size")
    luck = F.xxhash64(F.lit(seed), "row")
    share = F.shiftrightunsigned(luck, 11) / float(1 << 53)
    bucket = F.floor(share * F.ceil(F.col("n") / BUCKET))
    drawn = drawn.withColumns({"luck": share, "bucket": F.when((F.col("extra") > 0) & (F.col("extra") < F.col("n")), bucket)})
    cutting = F.col("bucket").isNotNull()
    spread = F.when(cutting, F.lit(0)).otherwise(F.col("row"))  # rows that need no rank are dealt anywhere
    drawn = cut(drawn.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket", spread).orderBy("luck", "doc_id", "row"))))
    sums = drawn.where(cutting).groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in"), F.first("extra").alias("extra"))
    upto = F.sum("in").over(Window.partitionBy("source", "size").orderBy("bucket"))
    edges = sums.withColumn("upto", upto).where("upto >= extra and upto - `in` < extra").select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("bucket").alias("edge"), (F.col("extra") - F.col("upto") + F.col("in")).alias("need"))
    out = drawn.join(edges, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")), "left")
    picked = F.expr("case when extra >= n then 1 when edge is null then 0 when bucket < edge then 1 when bucket = edge and rank <= need then 1 else 0 end")
    taken = F.coalesce(F.col("size") * (F.col("passes") + picked), F.lit(0)).cast("long")
    g = goals.select(F.col("source").alias("g_source"), "source_size", "target")
    out = out.join(F.broadcast(g) if few else g, F.col("source").eqNullSafe(F.col("g_source")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "row")


def apply(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs that the mix takes, with `copies` (theirs of that name is replaced), how often; rows of size 0 are not taken."""
    taken = cut(mix(docs, seed).where("taken > 0").groupBy("row").agg((F.sum("taken") / F.max("size")).cast("long").alias("all"), F.count(F.lit(1)).alias("same")))
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(doc.alias("doc"), F.xxhash64("doc_id", "text").alias("row"))
    if taken.where("same > 1").isEmpty():
        kept = named.join(taken, "row").select("doc", F.col("all").alias("copies"))
    else:
        # rows equal in doc_id and text can't be told apart: they share what all of them take
        turn = F.row_number().over(Window.partitionBy("row").orderBy(F.lit(0)))
        copies = F.floor(F.col("all") / F.col("same")) + F.when(turn <= F.col("all") % F.col("same"), 1).otherwise(0)
        kept = named.join(taken, "row").select("doc", copies.cast("long").alias("copies")).where("copies > 0")
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "copies"], "copies")
