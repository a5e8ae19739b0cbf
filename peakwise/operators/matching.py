"""Range and nearest matching without cross joins.

A range join becomes an equi join on buckets: one side keeps its bucket, the
other is copied to its bucket and both neighbours, and the exact predicate is
checked on the result.  Every true pair meets exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.operators.metrics import cosine_expr
from peakwise.operators.transforms import ID, TINY
from peakwise.skew import cut_groups, exact_quantiles

MIN_RELATIVE_MZ = 200.0


def tolerance_bucket(mz: Column, tol: float, relative: bool, min_mz: float = MIN_RELATIVE_MZ) -> Column:
    """Bucket whose neighbours contain everything within the tolerance.

    Relative buckets grow with m/z (logarithmic above ``min_mz``), so no upper
    m/z limit is needed.  The scale is shrunk slightly to absorb rounding and
    the choice of divisor.
    """
    if not relative:
        return F.floor(mz / F.lit(tol * (1 + 1e-9)))
    low = mz / F.lit(min_mz)
    grown = F.when(mz <= min_mz, low).otherwise(1.0 + F.log(F.greatest(low, F.lit(1.0))))
    return F.floor(grown / F.lit(tol) * F.lit(1.0 - 2.0 * tol))


def range_join(
    left: DataFrame, right: DataFrame, left_mz: str, right_mz: str, tol: float, keys: Sequence[str] = (),
    relative: bool = False, min_mz: float = MIN_RELATIVE_MZ, divisor: str = "left", inclusive: bool = False,
    how: str = "inner",
) -> DataFrame:
    """All pairs of the same keys with |left - right| below (or at) the tolerance.

    ``relative`` divides by the larger of ``min_mz`` and the ``divisor`` side's
    value.  The right side is the one copied; pass the smaller table there.
    Without keys the pairs grow with the product of both sides: they are merged
    bucket by bucket, so alike pairs lie side by side and are stored small.
    """
    a, b = F.col(left_mz), F.col(right_mz)
    l_rows = left.withColumn("__bucket", tolerance_bucket(a, tol, relative, min_mz))
    at = tolerance_bucket(b, tol, relative, min_mz)
    r_rows = right.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumn(
        "__rb", F.explode(F.sequence(at - 1, at + 1))
    )
    if not keys:
        r_rows = r_rows.hint("merge")
    gap = F.abs(a - b)
    if relative:
        base = a if divisor == "left" else b
        gap = gap / F.greatest(base, F.lit(min_mz))
    close = (gap <= tol) if inclusive else (gap < tol)
    cond = (F.col("__bucket") == F.col("__rb")) & close
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__r_{k}"))
    return l_rows.join(r_rows, cond, how).drop("__bucket", "__rb", *[f"__r_{k}" for k in keys])


def nearest_distance(true: DataFrame, cand: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """``true`` rows plus ``distance`` to the closest candidate m/z (NULL without candidates).

    A sweep over the distinct m/z values of both sides in parts of bounded
    size, cut where the values lie (``cut_groups``): each part hands its last
    candidate on to the next ones and its first to those before.  Rows without
    m/z or key are left out.
    """
    keys = list(keys)
    none = F.lit(None).cast("double")
    both = true.select(*keys, "mz", none.alias("__cand")).unionByName(cand.select(*keys, "mz", F.col("mz").cast("double").alias("__cand")))
    values = both.filter(F.col("mz").isNotNull()).groupBy(*keys, "mz").agg(F.count(F.lit(1)).alias("n"), F.max("__cand").alias("__cand"))
    cut, several = cut_groups(values, keys, "mz")
    inside = W.partitionBy(*keys, "part")
    below = F.last("__cand", ignorenulls=True).over(inside.orderBy("mz").rowsBetween(W.unboundedPreceding, 0))
    above = F.last("__cand", ignorenulls=True).over(inside.orderBy(F.col("mz").desc()).rowsBetween(W.unboundedPreceding, 0))
    swept = cut.withColumn("__below", below).withColumn("__above", above)
    if several:
        parts = cut.groupBy(*keys, "part").agg(F.min("__cand").alias("lo"), F.max("__cand").alias("hi"))
        per_key = W.partitionBy(*keys)  # the parts of a group are bounded in number
        parts = parts.select(
            *keys, "part",
            F.last("hi", ignorenulls=True).over(per_key.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("__far_below"),
            F.last("lo", ignorenulls=True).over(per_key.orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("__far_above"))
        swept = swept.join(parts, [*keys, "part"])
        swept = swept.withColumns({"__below": F.coalesce("__below", "__far_below"), "__above": F.coalesce("__above", "__far_above")})
    distance = F.least(F.col("mz") - F.col("__below"), F.col("__above") - F.col("mz"))
    return true.join(swept.select(*keys, "mz", distance.alias("distance")), [*keys, "mz"]).select(
        *keys, "mz", *[c for c in true.columns if c not in (*keys, "mz")], "distance")


TOLERANCES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.10)


def tolerance_curve(
    true: DataFrame, cand: DataFrame, keys: Sequence[str] = ID, tolerances: Sequence[float] = TOLERANCES
) -> DataFrame:
    """Recall and intensity coverage at each tolerance, and the median and p90 distance."""
    near = nearest_distance(true, cand, keys)
    hit = lambda t: F.coalesce(F.col("distance") <= t, F.lit(False))
    aggs = []
    for t in tolerances:
        name = f"{t:g}".replace(".", "_")
        aggs += [
            F.avg(hit(t).cast("double")).alias(f"recall_{name}"),
            (F.sum(F.when(hit(t), F.col("intensity")).otherwise(0.0))
             / F.greatest(F.sum("intensity"), F.lit(TINY))).alias(f"coverage_{name}"),
        ]
    curve = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("true_n"), *aggs)
    spread = exact_quantiles(near, keys, "distance", {"nearest_p50": 0.5, "nearest_p90": 0.9}).drop("n")
    return curve.join(spread, list(keys), "left")


def bin_window_support(
    true_bins: DataFrame, cand_bins: DataFrame, window: int, keys: Sequence[str] = ID, examples: int = 5
) -> DataFrame:
    """Per true bin: candidate bins within ``window`` bins, candidates there and the first few ids."""
    true = true_bins.select(*keys, F.col("bin").alias("true_bin"))
    hits = range_join(true, cand_bins.select(*keys, "bin", "cand_id").distinct(), "true_bin", "bin", window, keys, inclusive=True)
    group = [*keys, "true_bin"]
    order = W.partitionBy(*group).orderBy("cand_id")
    firsts = (
        hits.select(*group, "cand_id").distinct()
        .withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= examples)
        .groupBy(*group).agg(F.array_sort(F.collect_list("cand_id")).alias("examples"))
    )
    counts = hits.groupBy(*group).agg(
        F.count_distinct("bin").alias("n_bins"), F.count(F.lit(1)).alias("n_hits")
    )
    return counts.join(firsts, group)


def fragment_match_stats(
    peaks: DataFrame, theory: DataFrame, precursors: DataFrame, tol: float, ppm: bool = False
) -> DataFrame:
    """How the theoretical peaks of a spectrum's formulas explain its measured peaks.

    Equal m/z of a spectrum, and of one formula, are merged first.  A ppm
    tolerance is relative to the measured peak (no floor).
    """
    t = peaks.groupBy("spectrum_id", "mz").agg(F.sum("intensity").alias("intensity"))
    f = theory.select("spectrum_id", "cand_id", F.col("mz").alias("theory_mz")).distinct()
    width = tol * 1e-6 if ppm else tol
    # The smallest floor makes the bucket width follow the measured m/z itself.
    args = dict(relative=ppm, min_mz=1.0) if ppm else {}
    match = range_join(t, f, "mz", "theory_mz", width, ID, **args)
    per_peak = match.groupBy("spectrum_id", "mz", "intensity").agg(
        F.count(F.lit(1)).alias("n_peaks"), F.count_distinct("cand_id").alias("n_formulas")
    )
    explained = per_peak.groupBy("spectrum_id").agg(
        F.count(F.lit(1)).alias("__hit_n"), F.sum("intensity").alias("__hit_i"),
        F.avg("n_peaks").alias("matches_per_peak"), F.avg("n_formulas").alias("formulas_per_peak"),
    )
    used = match.select("spectrum_id", "cand_id", "theory_mz").distinct().groupBy("spectrum_id").agg(
        F.count(F.lit(1)).alias("__used")
    )
    sizes = t.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("__n"), F.sum("intensity").alias("__i"))
    offered = f.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("__offered"))
    pre = precursors.select("spectrum_id", "precursor_mz")

    def finds(rows: DataFrame, col: str, out: str) -> DataFrame:
        limit = F.col("precursor_mz") * width if ppm else F.lit(width)
        return rows.join(pre, "spectrum_id").groupBy("spectrum_id").agg(
            F.max((F.abs(F.col(col) - F.col("precursor_mz")) < limit).cast("int")).alias(out)
        )

    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        sizes.join(explained, "spectrum_id", "left").join(used, "spectrum_id", "left")
        .join(offered, "spectrum_id", "left")
        .join(finds(f, "theory_mz", "precursor_in_theory"), "spectrum_id", "left")
        .join(finds(t, "mz", "precursor_in_spectrum"), "spectrum_id", "left")
        .select(
            "spectrum_id",
            (zero("__hit_n") / F.col("__n")).alias("recall"),
            (F.coalesce("__hit_i", F.lit(0.0)) / F.col("__i")).alias("weighted_recall"),
            (zero("__used") / F.col("__offered")).alias("precision"),
            "matches_per_peak", "formulas_per_peak",
            zero("precursor_in_theory").alias("precursor_in_theory"),
            zero("precursor_in_spectrum").alias("precursor_in_spectrum"),
        )
    )


def mutual_best_cosine(true: DataFrame, pred: DataFrame, tol: float, keys: Sequence[str] = ID) -> DataFrame:
    """Cosine over one-to-one peak pairs that choose each other within the tolerance.

    A pair is kept when it has the largest intensity product of both its peaks
    (ties: smaller m/z).  Peaks with equal m/z of one spectrum are merged.
    """
    keys = list(keys)
    t = true.groupBy(*keys, "mz").agg(F.sum("intensity").alias("t"))
    p = pred.groupBy(*keys, F.col("mz").alias("pred_mz")).agg(F.sum("intensity").alias("p"))
    pairs = range_join(t, p, "mz", "pred_mz", tol, keys).withColumn("__w", F.col("t") * F.col("p"))
    best_t = F.row_number().over(W.partitionBy(*keys, "mz").orderBy(F.col("__w").desc(), "pred_mz"))
    best_p = F.row_number().over(W.partitionBy(*keys, "pred_mz").orderBy(F.col("__w").desc(), "mz"))
    mutual = pairs.withColumn("__a", best_t).withColumn("__b", best_p).filter("__a = 1 AND __b = 1")
    dots = mutual.groupBy(*keys).agg(F.sum("__w").alias("dot"), F.count(F.lit(1)).alias("n_pairs"))
    norm_t = t.groupBy(*keys).agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("nt"))
    norm_p = p.groupBy(*keys).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("np"))
    zero = F.lit(0.0)
    return norm_t.join(norm_p, keys, "full_outer").join(dots, keys, "left").select(
        *keys, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"),
        cosine_expr(F.coalesce("dot", zero), F.coalesce("nt", zero), F.coalesce("np", zero)).alias("cosine"),
    )


def gather_at_candidates(cand_bins: DataFrame, true_bins: DataFrame, tol_bins: int = 0) -> DataFrame:
    """Candidate peak rows plus ``true_exact`` and ``true_near``.

    ``true_exact`` is the true value in the candidate's bin, ``true_near`` the
    largest true value within ``tol_bins`` bins; both 0 where there is none.
    """
    keys = [*ID, "bin"]
    exact = true_bins.select(*keys, F.col("intensity").alias("true_exact"))
    rows = cand_bins.join(exact, keys, "left")
    if tol_bins > 0:
        spread = F.explode(F.sequence(F.col("bin") - tol_bins, F.col("bin") + tol_bins))
        near = (
            true_bins.select(*ID, spread.alias("bin"), "intensity")
            .groupBy(*keys).agg(F.max("intensity").alias("true_near"))
        )
        rows = rows.join(near, keys, "left")
    else:
        rows = rows.withColumn("true_near", F.col("true_exact"))
    return rows.fillna(0.0, ["true_exact", "true_near"])


def retrieval_hits(ranked: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Share of queries whose true library id is among the first k, per k."""
    best = ranked.join(truth, ["query_id", "library_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    total = truth.select("query_id").distinct().join(best, "query_id", "left")
    rows = total.select("rank", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    return rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("hit_rate"),
    )
