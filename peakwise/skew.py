"""Grouped statistics that stay distributed when one group is very large.

A window partitioned by spectrum or source puts the whole group into one task.
These helpers aggregate first (partial sums before the shuffle) and join the
small result back, or rank in two levels: parts of a group between splitters
from a quantile sketch first, the values of one part second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.session import write_once

# A group with more distinct values than PART_VALUES is cut into parts of about
# that many, at most CUTS + 1, at splitters from a quantile sketch of the group.
PART_VALUES = 10_000
CUTS = 1023
SKETCH = 16_384  # the sketch's rank error is the group's size divided by this


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounded for output, without a negative zero.

    As SQL engines do, the value is scaled first: ``F.round`` with digits rounds its decimal text, so one just below a half
    (0.16368749999999999) goes down there and up in SQL.
    """
    scale = F.lit(10.0**digits)
    return F.round((F.col(col) if isinstance(col, str) else col) * scale) / scale + F.lit(0.0)


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """``df`` plus per-group aggregates, by aggregate and join instead of a window.

    The aggregate has one row per group; the join back is a skew-splittable
    sort-merge join.  Rows with a NULL key are dropped.
    """
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(totals, list(keys))


def _unbounded(rows: DataFrame) -> DataFrame:
    """``rows`` that joins must not broadcast: Spark judges a written table by its compressed files, a fraction of its rows."""
    return rows.hint("merge")


def cut_groups(counted: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, bool]:
    """``counted`` plus ``part``, which never decreases with the value inside a group, and the group's ``total``.

    ``counted`` (keys, value, n) is written once: its values are looked at before they are dealt.  The splitters
    come from a mergeable sketch, so parts of a group hold about equally many values however dense the values lie;
    where they lie exactly changes no result.  The second result tells whether any group has several parts.
    """
    counted = write_once(counted, "counted-values")
    v = F.col(value).cast("double")
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"), F.sum("n").alias("total"))
    large = sizes.filter(F.col("__d") > PART_VALUES)
    if large.isEmpty():  # every group is one part
        return counted.withColumns({"total": F.sum("n").over(W.partitionBy(*keys)), "part": F.lit(0)}), False
    shares = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    rows = counted.join(large.select(*keys, "__d"), keys)
    cuts = rows.groupBy(*keys, "__d").agg(F.percentile_approx(v, shares, F.lit(SKETCH)).alias("__q"))
    parts = F.least(F.ceil(F.col("__d") / PART_VALUES), F.lit(CUTS + 1)).cast("int")
    thin = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("__q", F.floor(i * F.lit(CUTS + 1) / parts).cast("int") - 1))
    cuts = write_once(cuts.select(*keys, F.array_sort(thin).alias("__cuts")), "splitters")
    rows = counted.join(sizes.drop("__d").join(cuts, keys, "left"), keys).withColumn("part", F.lit(0))
    half = (CUTS + 1) // 2
    while half:  # binary search: how many splitters lie below the value
        below = F.get("__cuts", F.col("part") + half - 1) < v
        rows = rows.withColumn("part", F.when(below, F.col("part") + half).otherwise(F.col("part")))
        half //= 2
    return rows.drop("__cuts"), True


def _counted_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value): ``n`` rows, ``before`` rows below it, group ``total``."""
    group = list(keys) or ["__all"]
    rows = df.filter(F.col(value).isNotNull())
    if not keys:
        rows = rows.withColumn("__all", F.lit(0))
    cut, several = cut_groups(rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")), group, value)
    # This window sees the values of one part, the next one a row per part of a group.
    inside = W.partitionBy(*group, "part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(inside), F.lit(0))
    if not several:
        return cut.withColumn("before", before).select(*keys, value, "n", "before", "total")
    by_part = cut.groupBy(*group, "part").agg(F.sum("n").alias("__part_n"))
    earlier = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_part = by_part.withColumn("__part_before", F.coalesce(F.sum("__part_n").over(earlier), F.lit(0)))
    out = cut.join(by_part, [*group, "part"]).withColumn("before", F.col("__part_before") + before)
    return out.select(*keys, value, "n", "before", "total")


def row_positions(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """``df`` plus ``out``, the rank from 1 by descending ``value`` and ascending ``tie`` within a group, without a window over the group.

    Rows need a value and a tie, both numbers; rows equal in both share a rank.  Ties are only ranked where there are any.
    """
    first = _counted_positions(df, keys, value).select(*keys, value, "n", (F.col("total") - F.col("before") - F.col("n")).alias("__ahead"))
    rows = write_once(df.join(_unbounded(first), [*keys, value]), "ranked-rows")
    tied = _counted_positions(rows.filter("n > 1"), [*keys, value], tie).select(*keys, value, tie, F.col("before").alias("__same"))
    alone = rows.filter("n = 1").withColumn("__same", F.lit(0).cast("long"))
    both = alone.unionByName(rows.filter("n > 1").join(_unbounded(tied), [*keys, value, tie]))
    return both.withColumn(out, (F.col("__ahead") + F.col("__same") + 1).cast("int")).drop("__ahead", "__same", "n")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank from 1 with ties sharing their mean rank, added as column ``out``."""
    ranks = _counted_positions(df, keys, value).select(
        *keys, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out)
    )
    return df.join(_unbounded(ranks), [*keys, value])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group.

    Columns: the keys, ``n`` and one per entry of ``quantiles``.
    """
    keys = list(keys)
    pos = _counted_positions(df, keys, value)
    picks = []
    for name, q in quantiles.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        for side, target in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= target) & (target < F.col("before") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"{name}_{side}"))
    picked = pos.groupBy(*keys, "total").agg(*picks)
    cols = []
    for name, q in quantiles.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, F.col("total").alias("n"), *cols)


def lower_medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The middle value of each group, the lower of two middle ones, as column ``out``."""
    pos = _counted_positions(df, keys, value)
    at = F.floor((F.col("total") - 1) / 2)
    return pos.filter((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select(*keys, F.col(value).alias(out))
