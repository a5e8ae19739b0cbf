"""Similarity and quality of a predicted spectrum against a measured one.

Two binned spectra become one pair table (keys, bin, t, p) by a union and one
aggregate, so a full outer join is never needed and the map side combines
first.  Pair rows of a spectrum are bounded by the number of bins on the axis,
which bounds the windows used for shares and ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.functions import spectrum as S
from peakwise.operators.transforms import ID, TINY

LN2 = math.log(2.0)


def pair_bins(true: DataFrame, pred: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Outer pairing on (keys, bin): ``t`` true and ``p`` predicted intensity, 0 where absent."""
    zero = F.lit(0.0)
    sides = true.select(*keys, "bin", F.col("intensity").alias("t"), zero.alias("p")).unionByName(
        pred.select(*keys, "bin", zero.alias("t"), F.col("intensity").alias("p"))
    )
    return sides.groupBy(*keys, "bin").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))


def pair_peaks(
    true: DataFrame, pred: DataFrame, parts: int, bin_width: float = S.BIN_WIDTH, max_mz: float = S.MAX_MZ, keys: Sequence[str] = ID
) -> DataFrame:
    """``pair_bins`` of the binned peaks, from the peaks themselves.

    Peaks of a spectrum and bin meet in one of ``parts`` partitions before anything is summed: they rarely share a bin, so sums
    on the map side would hold a task's whole input.  A spectrum of any number of peaks is dealt over the partitions by its bins.
    """
    rows = _both_sides(true, pred, keys).filter(S.is_peak(F.col("mz"), F.col("intensity"))).withColumn("bin", S.bin_index(F.col("mz"), bin_width))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("intensity")).otherwise(0.0))
    rows = rows.filter(F.col("bin").between(0, S.last_bin(bin_width, max_mz))).repartition(parts, *keys, "bin")
    return rows.groupBy(*keys, "bin").agg(of("t").alias("t"), of("p").alias("p"))


def pair_peaks_max(true: DataFrame, pred: DataFrame, precursors: DataFrame, parts: int, resolution: float, keys: Sequence[str] = ID) -> DataFrame:
    """``pair_peaks`` in bins between right-open edges, the largest intensity of each; the precursor's bin counts as zero."""
    rows = _both_sides(true, pred, keys).withColumn("bin", S.bin_edge(F.col("mz"), resolution)).repartition(parts, *keys, "bin")
    of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("intensity"))), F.lit(0.0))
    rows = rows.groupBy(*keys, "bin").agg(of("t").alias("t"), of("p").alias("p"))
    rows = rows.join(precursors.select(*keys, "precursor_mz"), list(keys), "left")
    same = F.coalesce(F.col("bin") == S.bin_edge(F.col("precursor_mz"), resolution), F.lit(False))
    return rows.select(*keys, "bin", *[F.when(same, 0.0).otherwise(F.col(c)).alias(c) for c in ("t", "p")])


def _both_sides(true: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = lambda rows, name: rows.select(*keys, "mz", "intensity", F.lit(name).alias("side"))
    return side(true, "t").unionByName(side(pred, "p"))


def pair_bins_inner(true: DataFrame, pred: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Bins present on both sides."""
    return pair_bins(true, pred, keys).filter((F.col("t") > 0) & (F.col("p") > 0))


def cosine_expr(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    ok = (norm_a > TINY) & (norm_b > TINY)
    return F.when(ok, dot / (norm_a * norm_b + F.lit(TINY))).otherwise(0.0)


def _count(cond: Column) -> Column:
    return F.sum(cond.cast("long"))


def _share(part: Column, whole: Column) -> Column:
    """part / whole, NULL where the whole is tiny."""
    return F.when(whole > TINY, part / whole)


def cosine(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Cosine and square-root cosine; 0 when a side is empty."""
    t, p = F.col("t"), F.col("p")
    return pairs.groupBy(*keys).agg(
        cosine_expr(F.sum(t * p), F.sqrt(F.sum(t * t)), F.sqrt(F.sum(p * p))).alias("cosine"),
        cosine_expr(F.sum(F.sqrt(t * p)), F.sqrt(F.sum(t)), F.sqrt(F.sum(p))).alias("sqrt_cosine"),
    )


def with_shares(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Adds ``pt`` and ``pp``: t and p divided by their totals (0 for an empty side)."""
    whole = W.partitionBy(*keys)
    for src, out in (("t", "pt"), ("p", "pp")):
        total = F.sum(src).over(whole)
        pairs = pairs.withColumn(out, F.when(total > TINY, F.col(src) / total).otherwise(0.0))
    return pairs


def _js_terms() -> Column:
    a, b = F.col("pt"), F.col("pp")
    m = (a + b) * 0.5
    return F.when(a > 0, a * F.log(a / m)).otherwise(0.0) * 0.5 + F.when(b > 0, b * F.log(b / m)).otherwise(0.0) * 0.5


def _js_similarity() -> Column:
    st, sp = F.sum("t"), F.sum("p")
    sim = 1.0 - F.greatest(F.sum(_js_terms()), F.lit(0.0)) / F.lit(LN2)
    return (
        F.when((st <= TINY) & (sp <= TINY), 1.0)
        .when((st <= TINY) | (sp <= TINY), 0.0)
        .otherwise(F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0)))
    )


def js_similarity(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """1 - JS / ln 2; both sides empty 1, one side empty 0."""
    return with_shares(pairs, keys).groupBy(*keys).agg(_js_similarity().alias("js"))


def evaluate(pairs: DataFrame, keys: Sequence[str] = ID, k: int = 20) -> DataFrame:
    """The evaluation row per spectrum: similarity, coverage, recall and support counts.

    One shuffle builds the pairs, one more brings a spectrum's bins together;
    shares, the rank of the true bins and all sums share that exchange.
    """
    t, p = F.col("t"), F.col("p")
    rank = W.partitionBy(*keys).orderBy(t.desc(), F.col("bin"))
    rows = with_shares(pairs, keys).withColumn("__rank", F.row_number().over(rank))
    both = (t > 0) & (p > 0)
    top = (t > 0) & (F.col("__rank") <= k)
    return rows.groupBy(*keys).agg(
        cosine_expr(F.sum(t * p), F.sqrt(F.sum(t * t)), F.sqrt(F.sum(p * p))).alias("cosine"),
        cosine_expr(F.sum(F.sqrt(t * p)), F.sqrt(F.sum(t)), F.sqrt(F.sum(p))).alias("sqrt_cosine"),
        _js_similarity().alias("js"),
        _share(F.sum(F.when(p > 0, t).otherwise(0.0)), F.sum(t)).alias("coverage"),
        F.when(_count(top) > 0, _count(top & (p > 0)) / _count(top)).alias("topk_recall"),
        _count(p > 0).alias("pred_n"),
        _count(t > 0).alias("true_n"),
        _count(both).alias("overlap_n"),
        _count((p > 0) & (t <= 0)).alias("false_pred_n"),
        _share(F.sum(F.when(t > 0, p).otherwise(0.0)), F.sum(p)).alias("pred_on_true"),
    )


def weighted_dot(pairs: DataFrame, mass_pow: float, intensity_pow: float, keys: Sequence[str] = ID) -> DataFrame:
    """Dot product with weights bin^mass_pow * intensity^intensity_pow (scale free)."""
    m = F.pow(F.col("bin").cast("double"), F.lit(mass_pow))
    a = m * F.pow("t", F.lit(intensity_pow))
    b = m * F.pow("p", F.lit(intensity_pow))
    norm = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    return pairs.groupBy(*keys).agg(F.when(norm > TINY, F.sum(a * b) / norm).alias("weighted_dot"))


def integer_bins(peaks: DataFrame, tops: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Unit bins around integer masses up to the edge below the largest mass.

    ``tops(keys, top)`` is the largest mass of the pair; the last edge is
    ceil(top) - 1.5 and closed, heavier peaks are dropped.
    """
    n = F.ceil("top")
    return (
        peaks.join(tops, list(keys))
        .filter((F.col("mz") >= -0.5) & (F.col("mz") <= n - 1.5))
        .withColumn("bin", F.least(F.floor(F.col("mz") + 0.5), n - 2))
        .groupBy(*keys, "bin").agg(F.sum("intensity").alias("intensity"))
    )


def distances(pairs: DataFrame, n_bins: int, mix: float = 0.8, keys: Sequence[str] = ID) -> DataFrame:
    """L1, KL, cosine, square-root cosine and mixed distance of the two distributions.

    Logs and roots are clamped at 1e-12, also for the ``n_bins`` minus present
    bins that are empty on both sides.
    """
    floor = F.lit(TINY)
    pt, pp = F.col("pt"), F.col("pp")
    ct, cp = F.greatest(pt, floor), F.greatest(pp, floor)
    empty = (F.lit(n_bins) - F.count(F.lit(1))) * floor
    num = F.sum(F.sqrt(ct * cp)) + empty
    den = F.sqrt(F.sum(ct) + empty) * F.sqrt(F.sum(cp) + empty)
    plain = F.sum(pt * pp) / F.greatest(F.sqrt(F.sum(pt * pt)) * F.sqrt(F.sum(pp * pp)), floor)
    return (
        with_shares(pairs, keys).groupBy(*keys).agg(
            F.sum(F.abs(pt - pp)).alias("l1"),
            F.sum(F.when(pt > 0, pt * (F.log(pt) - F.log(cp))).otherwise(0.0)).alias("kl"),
            (1.0 - plain).alias("cosine_distance"),
            (1.0 - num / F.greatest(den, floor)).alias("sqrt_cosine_distance"),
        )
        .withColumn("mixed_distance",
                    F.lit(mix) * F.col("cosine_distance") + F.lit(1.0 - mix) * F.col("sqrt_cosine_distance"))
    )


def false_mass(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Predicted share on bins whose true share is below 1e-3, at most 5e-3, or absent."""
    pt, pp = F.col("pt"), F.col("pp")
    return with_shares(pairs, keys).groupBy(*keys).agg(
        F.sum(F.when(pt < 1e-3, pp).otherwise(0.0)).alias("invalid_mass"),
        F.sum(F.when(pt <= 5e-3, pp).otherwise(0.0)).alias("weak_mass"),
        F.sum(F.when(F.col("t") <= TINY, pp).otherwise(0.0)).alias("false_support_mass"),
    )


def support_scores(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Precision, recall and IoU of the predicted support; NULL for an empty denominator."""
    t, p = F.col("t") > 0, F.col("p") > 0
    both = _count(t & p)
    return pairs.groupBy(*keys).agg(
        F.when(_count(p) > 0, both / _count(p)).alias("precision"),
        F.when(_count(t) > 0, both / _count(t)).alias("recall"),
        F.when(_count(t | p) > 0, both / _count(t | p)).alias("iou"),
    )


def top_overlap(pairs: DataFrame, k: int, keys: Sequence[str] = ID) -> DataFrame:
    """How many of the k strongest bins both sides share, as count and over k."""
    rt = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("bin")))
    rp = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("p").desc(), F.col("bin")))
    rows = pairs.withColumn("__rt", rt).withColumn("__rp", rp)
    hit = (F.col("__rt") <= k) & (F.col("__rp") <= k) & (F.col("t") > 0) & (F.col("p") > 0)
    return rows.groupBy(*keys).agg(
        _count(hit).alias("shared_n"), (_count(hit) / F.lit(float(k))).alias("topk_precision")
    )


def barcode(pairs: DataFrame, cutoff: float = 1e-3, keys: Sequence[str] = ID) -> DataFrame:
    """Predicted weight on masses holding more than ``cutoff`` of the true total."""
    good = F.sum(F.when(F.col("pt") > cutoff, F.col("p")).otherwise(0.0)) / (F.sum("p") + F.lit(1e-10))
    return with_shares(pairs, keys).groupBy(*keys).agg(
        good.alias("barcode_precision"), (1.0 - good).alias("false_positive_rate")
    )


def concentration(binned: DataFrame, k: int = 5, keys: Sequence[str] = ID) -> DataFrame:
    """Share of the k strongest bins, entropy and entropy over ln(n) of one spectrum."""
    order = W.partitionBy(*keys).orderBy(F.col("intensity").desc(), F.col("bin"))
    whole = W.partitionBy(*keys)
    rows = binned.withColumn("__r", F.row_number().over(order)).withColumn(
        "__p", F.col("intensity") / F.sum("intensity").over(whole)
    )
    p = F.col("__p")
    entropy = -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("__r") <= k, p).otherwise(0.0)).alias("topk_fraction"),
        entropy.alias("entropy"),
        F.when(F.count(F.lit(1)) > 1, entropy / F.log(F.count(F.lit(1)).cast("double"))).alias("scaled_entropy"),
    )


def integer_mass_recall(
    peaks: DataFrame, fragments: DataFrame, cutoff: float = 1e-3, keys: Sequence[str] = ID
) -> DataFrame:
    """Recall of peaks holding ``cutoff`` of the total whose truncated mass a fragment can reach.

    A fragment reaches the floor and the ceiling of its mass.  Equal m/z of one
    spectrum are merged first.
    """
    from peakwise.skew import with_group_stats

    merged = peaks.groupBy(*keys, "mz").agg(F.sum("intensity").alias("intensity"))
    strong = with_group_stats(merged, keys, __t=F.sum("intensity")).filter(
        F.col("intensity") / F.col("__t") >= cutoff
    ).withColumn("mass", F.floor("mz"))
    reach = fragments.select(*keys, F.explode(F.array(F.floor("mz"), F.ceil("mz"))).alias("mass")).distinct()
    hit = strong.join(reach.withColumn("__hit", F.lit(1)), [*keys, "mass"], "left")
    got = F.col("__hit").isNotNull()
    return hit.groupBy(*keys).agg(
        (_count(got) / F.count(F.lit(1))).alias("recall"),
        (F.sum(F.when(got, F.col("intensity")).otherwise(0.0)) / F.sum("intensity")).alias("weighted_recall"),
    )


def shift_diagnosis(
    true: DataFrame, support: DataFrame, shift_bins: int, keys: Sequence[str] = ID
) -> DataFrame:
    """Recall and intensity coverage of the support with true bins moved by 0, + and - ``shift_bins``."""
    moves = F.explode(F.array(F.lit(0), F.lit(shift_bins), F.lit(-shift_bins)))
    moved = true.select(*keys, "bin", "intensity", moves.alias("shift")).withColumn(
        "bin", F.col("bin") + F.col("shift")
    )
    has = support.select(*keys, "bin").distinct().withColumn("__hit", F.lit(1))
    got = F.col("__hit").isNotNull()
    return moved.join(has, [*keys, "bin"], "left").groupBy(*keys, "shift").agg(
        (_count(got) / F.count(F.lit(1))).alias("recall"),
        (F.sum(F.when(got, F.col("intensity")).otherwise(0.0))
         / F.greatest(F.sum("intensity"), F.lit(TINY))).alias("coverage"),
    )


def ndcg(pairs: DataFrame, union: bool = True, optimistic: bool = False, keys: Sequence[str] = ID) -> DataFrame:
    """Gain of the true intensities in predicted order over their ideal order.

    With ``union`` all bins count and unpredicted true bins follow the
    predicted ones (strongest first when optimistic, weakest first otherwise);
    without it only shared bins do.
    """
    rows = pairs if union else pairs.filter((F.col("t") > 0) & (F.col("p") > 0))
    missed = (F.col("p") <= 0).cast("int")
    late = F.when(missed == 1, F.col("t")).otherwise(0.0)
    late_order = late.desc() if optimistic else late.asc()
    by_pred = W.partitionBy(*keys).orderBy(missed, F.col("p").desc(), late_order, F.col("bin"))
    by_true = W.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("bin"))
    rows = rows.withColumn("__g", F.log2(F.row_number().over(by_pred) + 1.0)).withColumn(
        "__i", F.log2(F.row_number().over(by_true) + 1.0)
    )
    ideal = F.sum(F.col("t") / F.col("__i"))
    return rows.groupBy(*keys).agg(
        F.when(ideal > TINY, F.sum(F.col("t") / F.col("__g")) / ideal).otherwise(0.0).alias("ndcg")
    )


def optimistic_cosine(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Cosine when every matched prediction had the true intensity and all others zero."""
    t = F.col("t")
    best = F.when(F.col("p") > 0, t).otherwise(0.0)
    return pairs.groupBy(*keys).agg(
        cosine_expr(F.sum(t * best), F.sqrt(F.sum(t * t)), F.sqrt(F.sum(best * best))).alias("optimistic_cosine")
    )


def out_of_support(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """1 - true intensity inside the candidate support / true total; NULL for an empty spectrum."""
    inside = F.sum(F.when(F.col("p") > 0, F.col("t")).otherwise(0.0))
    ratio = 1.0 - inside / F.sum("t")
    return pairs.groupBy(*keys).agg(
        F.when(F.sum("t") > TINY, F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).alias("oos_ratio")
    )


def argmax_agreement(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Whether the strongest true and predicted bins coincide (ties: lowest bin)."""
    key = lambda c: F.struct(F.col(c), -F.col("bin"))
    return pairs.groupBy(*keys).agg(
        (F.max_by("bin", key("t")) == F.max_by("bin", key("p"))).cast("int").alias("same_top")
    )


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "pearson") -> DataFrame:
    """Correlation per group; NULL for one row or a constant side."""
    varied = (F.stddev_pop(x) > TINY) & (F.stddev_pop(y) > TINY)
    r = F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y))
    return df.groupBy(*keys).agg(F.when(varied, r).alias(out))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "spearman") -> DataFrame:
    """Correlation of average ranks; ranks come from the two-level rank, not from one window."""
    from peakwise.skew import average_rank

    ranked = average_rank(df, keys, x, "__rx")
    ranked = average_rank(ranked, keys, y, "__ry")
    return pearson(ranked, keys, "__rx", "__ry", out)


def ensemble_log(df: DataFrame, keys: Sequence[str], log_value: str) -> DataFrame:
    """Mean and standard deviation over runs of exp(log_value), returned as logs."""
    from peakwise.skew import with_group_stats

    rows = with_group_stats(df, keys, __top=F.max(log_value))
    w = F.exp(F.col(log_value) - F.col("__top"))
    n = F.count(F.lit(1))
    mean = F.sum(w) / n
    var = F.sum(w * w) / n - mean * mean
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        (F.max("__top") + F.log(mean)).alias("log_mean"),
        F.when((n > 1) & (var > TINY),
               F.max("__top") + 0.5 * (F.log(var) + F.log(n.cast("double")) - F.log(n - 1.0))).alias("log_std"),
    )


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays, 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na > TINY) & (nb > TINY), dot(a, b) / (na * nb + F.lit(TINY))).otherwise(0.0)


def dice(pairs: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """2 * sum of minima over the sum of both count vectors."""
    total = F.sum(F.col("t") + F.col("p"))
    return pairs.groupBy(*keys).agg(
        F.when(total > 0, 2.0 * F.sum(F.least("t", "p")) / total).otherwise(0.0).alias("dice")
    )
