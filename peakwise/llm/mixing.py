"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight.  A source whose share lies above
``max_epochs`` times its size is clamped there and the excess goes to the
others by weight, until no share is above.  A document is then repeated
``floor(target / source size)`` times, and the rest of the target is filled
with one more copy of the source's first documents in a seeded hash order.

The hash order is cut by three levels of counting (1024 buckets, 1024 parts of
the bucket at the cut, the rows of that part), so no task ever sorts a source,
whatever share of all rows it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.llm.common import n_words, null_safe_key, set_aside, stored

LEVEL_BITS = 10


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights given in turn to the sources by code point, NULL last.

    ``sources`` has one row per source; this ranks that list, not documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.row_number().over(order) - 1) % len(weights)
    return sources.select("source", F.element_at(turn, (place + 1).cast("int")).alias("weight"))


def water_level(sources: DataFrame, budget: float, max_epochs: float) -> float:
    """The level ``L`` at which the shares min(weight * L, max_epochs * size) use up the budget.

    Each round clamps what lies above its cap and spreads the rest by weight;
    the driver sees three sums a round.  Infinite when all sources are clamped.
    """
    cap, level, clamped = F.col("source_size") * F.lit(float(max_epochs)), 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > cap
        n, used, free = sources.agg(
            F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == clamped:
            return level
        clamped, level = n, ((budget - used) / free if free > 0 else math.inf)
        if level == math.inf:
            return level


def source_targets(
    sizes: DataFrame, weights: DataFrame | None, budget_share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """One row per source: ``source, source_size, target``; ``sizes`` has ``source, size``.

    ``weights`` (``source, weight``) may leave sources out: they get nothing,
    as do weights that are NULL, NaN or not above 0.  None: 3, 1, 2 in turn.
    """
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    weights = cyclic_weights(totals) if weights is None else weights.groupBy("source").agg(F.max("weight").alias("weight"))
    key = null_safe_key(F.col("source"))
    weighed = totals.withColumn("k", key).join(weights.select(key.alias("k"), "weight"), "k", "left")
    weight = F.col("weight").cast("double")
    weighed = stored(weighed.withColumn(
        "weight", F.when((weight > 0) & ~F.isnan(weight), weight).otherwise(F.lit(0.0))), "mix-weights")
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(weighed, budget_share * total, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    share = F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * F.lit(level), cap))
    return weighed.select("source", "source_size", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)).alias("target"))


def seeded_hash(doc_id: Column, seed: int) -> Column:
    """32 bits of md5 of seed and id, as a long that SQL engines agree on."""
    keyed = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(keyed.cast("binary")), 1, 8), 16, 10).cast("long")


def _cut(counted: DataFrame, bucket: str, start: Column) -> DataFrame:
    """Per source the bucket in which the running size first reaches ``need``, and the size before it."""
    before = start + F.coalesce(
        F.sum("n").over(W.partitionBy("k").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("before", before).filter(
        (F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("n")))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17
) -> DataFrame:
    """Every row of ``docs`` plus ``size, source_size, target`` and ``copies``, the times the mix takes it.

    Size is the number of words.  No document is taken more than
    ``ceil(max_epochs)`` times, and a source's taken words miss its target by
    at most half of one document.  NULL or empty texts have size 0; a NULL
    source is a source of its own; repeated rows are taken one by one, in the
    order of hash, id and size.  Columns of ``docs`` with the names of the
    results are replaced, other columns pass through.  Empty tables give no rows.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    prefix = "mix_plan_"
    k, h, extra = "mix_k", "mix_h", "mix_extra"
    docs, back = set_aside(docs, [k, h, extra, *[prefix + c for c in ("k", "source_size", "target", "whole", "need", "b1", "b2", "before")]])
    size, key, bits = n_words(F.col("text")), null_safe_key(F.col("source")), LEVEL_BITS
    part = lambda col, level: F.shiftright(col, 32 - bits * level) % (1 << bits)
    narrow = stored(docs.select("source", size.alias("size"), key.alias("k"), seeded_hash(F.col("doc_id"), seed).alias("h")), "mix-sizes")
    targets = source_targets(narrow, weights, budget_share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = stored(targets.select(null_safe_key(F.col("source")).alias("k"), "source_size", "target", whole.alias("whole"),
                                 (F.col("target") - whole * F.col("source_size")).alias("need")), "mix-plan")
    first = narrow.groupBy("k", part(F.col("h"), 1).alias("b1")).agg(F.sum("size").alias("n")).join(plan.select("k", "need"), "k")
    cut1 = _cut(first, "b1", F.lit(0)).select("k", "need", "b1", F.col("before").alias("before1"))
    cut1 = stored(cut1, "mix-cut")
    second = narrow.withColumn("b1", part(F.col("h"), 1)).join(cut1, ["k", "b1"]).groupBy(
        "k", "need", "before1", "b1", part(F.col("h"), 2).alias("b2")).agg(F.sum("size").alias("n"))
    cut2 = _cut(second, "b2", F.col("before1")).select("k", "b1", "b2", "before")
    plan = stored(plan.join(cut2, "k", "left"), "mix-plan")

    rows = docs.withColumn(k, key).withColumn(h, seeded_hash(F.col("doc_id"), seed))
    held = rows.join(plan.select(*[F.col(c).alias(prefix + c) for c in plan.columns]), F.col(k) == F.col(prefix + "k"))
    p = lambda name: F.col(prefix + name)
    place, at = F.shiftright(F.col(h), 32 - 2 * bits), p("b1") * (1 << bits) + p("b2")
    sized = lambda df: df.withColumn("size", size)
    # Outside the cut's part a comparison decides; a source without a cut needs no further copies.
    outside = sized(held.filter(at.isNull() | (place != at))).withColumn(
        extra, F.when(place < at, F.lit(1)).otherwise(F.lit(0)))
    inside = sized(held.filter(place == at))
    earlier = W.partitionBy(k).orderBy(F.col(h), F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    middle = p("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.col("size") / 2
    inside = inside.withColumn(extra, F.when(middle < p("need"), F.lit(1)).otherwise(F.lit(0)))
    both = outside.unionByName(inside)
    return both.select(*back, "size", p("source_size").alias("source_size"), p("target").alias("target"),
                       (p("whole") + F.col(extra)).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    renamed, back = set_aside(docs, ["size", "source_size", "target", "copies", "mix_copy"])
    mixed = mix_sources(renamed, **options).filter(F.col("copies") > 0)
    return mixed.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back)
