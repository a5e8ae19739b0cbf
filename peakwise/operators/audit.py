"""Counters, summaries, leakage and quality reports over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.functions import spectrum as S
from peakwise.operators import metrics as M
from peakwise.operators.transforms import ID, TINY, log_sum_exp, top_peaks
from peakwise.skew import exact_quantiles, with_group_stats

KEYS = ["spectrum_id", "cand_id"]


def value_counts(df: DataFrame, column: str, missing: str = "__MISSING__", by_key: bool = False, top: int | None = None) -> DataFrame:
    """Counts per value, most frequent first (or by key), optionally the first ``top``."""
    out = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy("value") if by_key else out.orderBy(F.col("n").desc(), "value")
    return out.limit(top) if top else out


def facet_counts(df: DataFrame, facets: dict[str, Column], partial: bool = False) -> DataFrame:
    """Joint counts of boolean facets; ``partial`` also counts every subset of them (NULL: any)."""
    rows = df.select(*[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in facets.items()])
    grouped = rows.cube(*facets) if partial else rows.groupBy(*facets)
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def numeric_summary(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """n, mean, p50, p90, p99 of the finite values of each column, one row per column and group.

    Quantiles are exact and linear through the two-level rank;
    ``approximate`` uses the built-in sketch instead.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    group = [*keys, "column"]
    if approximate:
        q = F.percentile_approx("v", [0.5, 0.9, 0.99], 10000)
        return long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), q.alias("q")).select(
            *group, "n", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])
    means = long.groupBy(*group).agg(F.avg("v").alias("mean"))
    return exact_quantiles(long, group, "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).join(means, group)


def missing_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs per column, one row per column, from one scan."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])
    return one.select(F.explode(cells).alias("x")).select("x.*")


def split_summary(df: DataFrame, split: str, group: str, kept: Column) -> DataFrame:
    """Rows, distinct groups, kept rows and keep ratio per split and in total.

    Distinct groups are counted from one row per (split, group), so no task
    holds a split.
    """
    pairs = df.groupBy(F.col(split).alias("split"), group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(kept, F.lit(False)).cast("long")).alias("k"))
    per = pairs.groupBy("split").agg(F.sum("n").alias("rows"), F.count(group).alias("groups"), F.sum("k").alias("kept"))
    whole = pairs.groupBy(group).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).agg(
        F.sum("n").alias("rows"), F.count(group).alias("groups"), F.sum("k").alias("kept")).select(
        F.lit("total").alias("split"), "rows", "groups", "kept")
    return per.unionByName(whole).withColumn("keep_ratio", F.col("kept") / F.col("rows"))


def leakage(df: DataFrame, split: str, group: str, examples: int = 20) -> DataFrame:
    """Groups present in two splits: number and first keys per pair of splits."""
    sides = df.groupBy(F.col(group).alias("g")).agg(F.array_sort(F.collect_set(split)).alias("s"))  # a few names each
    pair = lambda a, b: F.struct(a.alias("left_split"), b.alias("right_split"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: pair(a, b))))
    rows = sides.filter(F.size("s") > 1).select("g", F.explode(pairs).alias("p")).select("g", "p.*")
    key = ["left_split", "right_split"]
    first = rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy("g"))).filter(F.col("__r") <= examples)
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list("g")).alias("examples"))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(listed, key)


def alignment_audit(left: DataFrame, right: DataFrame, key: str, text: str, mz_tol: float = 1e-4, int_tol: float = 1e-6) -> DataFrame:
    """Reason counts of comparing two interchange tables by key: all rows, not a sample.

    Both sides have ``text``, ``first_mz`` and ``first_intensity``.
    """
    r = right.withColumnsRenamed({c: f"__{c}" for c in (text, "first_mz", "first_intensity")}).withColumn("__in", F.lit(1))
    rows = left.withColumn("__l", F.lit(1)).join(r, key, "full_outer")
    reason = (
        F.when(F.col("__in").isNull(), "missing right").when(F.col("__l").isNull(), "missing left")
        .when(~F.col(text).eqNullSafe(F.col(f"__{text}")), text)
        .when(F.col("first_mz").isNull() | F.col("__first_mz").isNull(), "peak_parse")
        .when((F.abs(F.col("first_mz") - F.col("__first_mz")) > mz_tol)
              | (F.abs(F.col("first_intensity") - F.col("__first_intensity")) > int_tol), "first_peak").otherwise("ok"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def resolution_report(peaks: DataFrame, in_subset: Column, top: int = 20) -> DataFrame:
    """How close m/z values are to integers: all and top peaks, overall and in a subset of spectra.

    ``peaks`` carries what ``in_subset`` needs.
    """
    ranked = top_peaks(peaks, top, ID, "intensity", "mz").select(*ID, "mz", F.lit("top").alias("peaks"), in_subset.alias("__sub"))
    rows = peaks.select(*ID, "mz", F.lit("all").alias("peaks"), in_subset.alias("__sub")).unionByName(ranked)
    scopes = F.array_compact(F.array(F.lit("overall"), F.when(F.coalesce("__sub", F.lit(False)), F.lit("subset"))))
    rows = rows.select("peaks", F.explode(scopes).alias("scope"), F.abs(F.col("mz") - F.rint("mz")).alias("frac"))
    group = ["scope", "peaks"]
    near = lambda e: F.avg((F.col("frac") < e).cast("double"))
    ratios = rows.groupBy(*group).agg(
        near(1e-6).alias("integer_1e6"), near(1e-4).alias("integer_1e4"), near(1e-3).alias("integer_1e3"),
        near(1e-2).alias("integer_1e2"), F.sum((F.col("frac") >= 1e-4).cast("long")).alias("non_integer_n"))
    return exact_quantiles(rows, group, "frac", {"frac_p50": 0.5, "frac_p90": 0.9, "frac_p99": 0.99}).join(ratios, group)


def low_coverage(
    true_bins: DataFrame, support: DataFrame, precursors: DataFrame, bin_width: float = S.BIN_WIDTH, tol_da: float = 0.03,
    isotopes: int = 2, n_peaks: int = 5,
) -> DataFrame:
    """Coverage per spectrum with what is missing and its strongest peaks as text, worst first when ordered by coverage."""
    has = support.select(*ID, "bin").distinct().withColumn("__hit", F.lit(1))
    rows = true_bins.join(has, [*ID, "bin"], "left").join(precursors.select(*ID, "precursor_mz"), ID, "left")
    x, missed = F.col("intensity"), F.col("__hit").isNull()
    mz = F.col("bin") * F.lit(bin_width)
    like = S.near_precursor(mz, F.col("precursor_mz"), tol_da, isotopes)
    order = W.partitionBy(*ID).orderBy(x.desc(), "bin")  # bounded by the bins of the axis
    rows = rows.withColumn("__r", F.row_number().over(order))
    label = F.format_string("%.4f:%s", mz, F.when(missed, "MISS").otherwise("hit"))
    tops = F.filter(F.array_sort(F.collect_list(F.when(F.col("__r") <= n_peaks, F.struct("__r", label.alias("t"))))), lambda s: s.isNotNull())
    total = F.greatest(F.sum(x), F.lit(TINY))
    return rows.groupBy(*ID).agg(
        (F.sum(F.when(missed, 0.0).otherwise(x)) / total).alias("coverage"),
        (F.sum(F.when(missed, x).otherwise(0.0)) / total).alias("missing_ratio"),
        (F.sum(F.when(missed & like, x).otherwise(0.0)) / total).alias("missing_precursor_like"),
        F.count(F.lit(1)).alias("true_n"), F.array_join(F.transform(tops, lambda s: s["t"]), ";").alias("top_peaks"))


def energy_bucket(energy: Column) -> Column:
    return F.when(energy.isNull() | F.isnan(energy), "missing").when(energy < 20, "low").when(energy < 45, "mid").otherwise("high")


def bucket_means(df: DataFrame, energy: str, columns: Sequence[str]) -> DataFrame:
    """Row count and column means per energy bucket."""
    return df.groupBy(energy_bucket(F.col(energy)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def structure_report(cands: DataFrame, cand_bins: DataFrame) -> DataFrame:
    """Pool shape per spectrum: valid, active, teacher counts and entropy, duplicates, positives, peaks.

    ``cands`` has ``group_id``, ``active``, ``teacher`` (probability) and ``label``.
    """
    peaks = cand_bins.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("__p"))
    p = F.col("teacher")
    per = cands.join(peaks, KEYS, "left").groupBy(*ID).agg(
        F.count(F.lit(1)).alias("valid_n"), F.sum((F.col("active") > 0.5).cast("long")).alias("active_n"),
        F.sum((p > TINY).cast("long")).alias("teacher_n"),
        F.sum(F.when(p > 0, -p * F.log(p + TINY)).otherwise(0.0)).alias("teacher_entropy"),
        F.avg((F.col("label") > 0.5).cast("double")).alias("positive_ratio"), F.avg(F.coalesce("__p", F.lit(0))).alias("peak_mean"))
    groups = cands.select(*ID, "group_id").distinct().groupBy(*ID).agg(F.count(F.lit(1)).alias("group_n"))
    return per.join(groups, ID).withColumn("dup_ratio", 1.0 - F.col("group_n") / F.col("valid_n"))


def peak_stage_counts(cand_peaks: DataFrame, bin_width: float = S.BIN_WIDTH, max_mz: float = S.MAX_MZ) -> DataFrame:
    """Per candidate: raw peaks, binned peaks and distinct bins."""
    on_axis = S.is_peak(F.col("mz"), F.col("intensity")) & (F.col("mz") >= 0) & (F.col("mz") < max_mz)
    bins = cand_peaks.withColumn("bin", F.when(on_axis, S.bin_index(F.col("mz"), bin_width)))
    per_bin = bins.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("n"))
    return per_bin.groupBy(*KEYS).agg(
        F.sum("n").alias("raw_n"), F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))), F.lit(0)).alias("binned_n"),
        F.count("bin").alias("unique_n"))


# Quality gate (statistic, must be above / below, threshold).
QUALITY_GATE = (
    ("peak_mean", "above", 2.5), ("peak_p25", "above", 2.0), ("bin_mean", "above", 2.5),
    ("single_ratio", "below", 0.5), ("multi_ratio", "above", 0.85), ("repeat_ratio", "below", 0.35),
)


def peak_audit(stage_counts: DataFrame, gate: Sequence[tuple[str, str, float]] = QUALITY_GATE) -> DataFrame:
    """One-row summary of the stage counts with the failed gates and whether all passed."""
    peaks, unique = F.col("binned_n").cast("double"), F.col("unique_n")
    one = stage_counts.agg(
        F.count(F.lit(1)).alias("candidates"), F.avg(peaks).alias("peak_mean"), F.avg(unique).alias("bin_mean"),
        F.avg((peaks <= 1).cast("double")).alias("single_ratio"), F.avg((peaks >= 2).cast("double")).alias("multi_ratio"),
        F.avg(1.0 - unique / F.greatest(peaks, F.lit(1.0))).alias("repeat_ratio"))
    p25 = exact_quantiles(stage_counts.select(F.lit(1).alias("one"), peaks.alias("v")), ["one"], "v", {"peak_p25": 0.25})
    row = one.withColumn("one", F.lit(1)).join(p25.drop("n"), "one").drop("one")
    fails = []
    for name, side, limit in gate:
        bad = (F.col(name) <= limit) if side == "above" else (F.col(name) >= limit)
        fails.append(F.when(F.coalesce(bad, F.lit(True)), F.lit(f"{name} not {side} {limit}")))
    return row.withColumn("errors", F.array_join(F.array_compact(F.array(*fails)), "; ")).withColumn("passed", F.col("errors") == "")


def assert_quality(report: DataFrame) -> DataFrame:
    """The report, failing the job when a gate failed."""
    check = F.assert_true(F.col("passed"), F.concat(F.lit("quality gate: "), F.col("errors")))
    return report.filter(check.isNull())


def consistency_audit(recomputed: DataFrame, stored: DataFrame) -> DataFrame:
    """Recomputed against stored binned spectra: cosine and whether the bins are the same."""
    pairs = M.pair_bins(recomputed, stored)
    same = F.sum(((F.col("t") > 0) != (F.col("p") > 0)).cast("long")) == 0
    return M.cosine(pairs).drop("sqrt_cosine").join(pairs.groupBy(*ID).agg(same.alias("support_same")), ID)


def masked_peaks(cands: DataFrame, cand_peaks: DataFrame) -> DataFrame:
    """Masked candidates that still have peaks, counted per spectrum (empty: all is well)."""
    masked = cands.filter(F.coalesce(F.col("mask") <= 0.5, F.lit(True)))
    bad = masked.join(cand_peaks.select(*KEYS), KEYS, "left_semi")
    return bad.groupBy(*ID).agg(F.count(F.lit(1)).alias("masked_with_peaks"))


def metric_means(history: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Mean of the finite values per metric key."""
    v = F.col("value")
    finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return history.groupBy(*keys).agg(F.count(finite).alias("n"), F.avg(finite).alias("mean"))


def group_reduce(df: DataFrame, keys: Sequence[str], value: str, id_col: str) -> DataFrame:
    """sum, max, mean, variance, argmax (largest id of the maximum) and log-sum-exp per group."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(
        F.sum(v).alias("sum"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("var"), F.max_by(id_col, F.struct(v, F.col(id_col))).alias("argmax"))
    return out.join(log_sum_exp(df, keys, value, "lse"), list(keys))


def group_arg_topk(df: DataFrame, keys: Sequence[str], value: str, id_col: str, k: int) -> DataFrame:
    return top_peaks(df, k, keys, value, id_col).select(*keys, id_col, "rank")


def group_distribution(df: DataFrame, keys: Sequence[str], value: str, mask: str | None = None) -> DataFrame:
    """softmax, L1 and L2 shares per group; masked rows (0) get softmax 0."""
    v = F.col(value)
    rows = df.withColumn("__v", v if mask is None else F.when(F.col(mask) > 0, v))
    rows = with_group_stats(rows, keys, __top=F.max("__v"), __l1=F.sum(v), __l2=F.sqrt(F.sum(v * v)))
    rows = with_group_stats(rows, keys, __z=F.sum(F.exp(F.col("__v") - F.col("__top"))))
    return rows.withColumns({
        "softmax": F.coalesce(F.exp(F.col("__v") - F.col("__top")) / F.col("__z"), F.lit(0.0)),
        "l1": v / F.greatest("__l1", F.lit(1e-9)), "l2": v / F.greatest("__l2", F.lit(1e-9)),
    }).drop("__v", "__top", "__l1", "__l2", "__z")


def source_aggregate(records: DataFrame, keys: Sequence[str], local: Sequence[str], clip: int = 16) -> DataFrame:
    """Source features per formula: counts, hydrogen shifts, flags, depth, ring cuts, local means and maxima.

    ``records`` has ``h_shift``, ``brics``, ``depth`` and ``ring_cut``.
    """
    n, h = F.count(F.lit(1)), F.abs("h_shift")
    aggs = [
        F.lit(1.0).alias("has_source"), F.log1p(n).alias("log_n"), (F.least(n, F.lit(clip)) / clip).alias("n_clip"),
        (F.min(h) / 4.0).alias("h_min"), (F.avg(h) / 4.0).alias("h_mean"), F.max((F.col("brics") > 0.5).cast("int")).alias("brics_any"),
        (F.least(F.sum("brics"), F.lit(clip)) / clip).alias("brics_sum"), (F.min("depth") / 4.0).alias("depth_min"),
        F.max((F.col("ring_cut") > 0.5).cast("int")).alias("ring_any"), F.avg("ring_cut").alias("ring_ratio")]
    for c in local:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    return records.groupBy(*keys).agg(*aggs)


def preparation_diagnostics(
    stages: DataFrame, before_cap: DataFrame, after_cap: DataFrame, true_bins: DataFrame
) -> DataFrame:
    """Per spectrum: candidates by stage and source depth, support coverage before and after the cap, matched intensity.

    ``stages(spectrum_id, cand_id, has_peak, below_precursor, kept,
    source_flag, break_depth)``; the other two are binned supports.
    """
    n = lambda c: F.sum(c.cast("long"))
    kept, src, depth = F.col("kept"), F.col("source_flag") > 0, F.col("break_depth")
    counts = stages.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("raw_n"), n(F.col("has_peak")).alias("mass_mask_n"),
        n(F.col("has_peak") & F.col("below_precursor")).alias("precursor_mask_n"), n(kept).alias("final_n"),
        n(kept & src).alias("source_n"), n(kept & src & (depth == 1)).alias("single_n"),
        n(kept & src & (depth == 2)).alias("double_n"), n(kept & src & (depth >= 3)).alias("deep_n"))
    flag = lambda df, name: df.select(*ID, "bin").distinct().withColumn(name, F.lit(1))
    rows = true_bins.join(flag(before_cap, "__b"), [*ID, "bin"], "left").join(flag(after_cap, "__a"), [*ID, "bin"], "left")
    x = F.col("intensity")
    matched = F.sum(F.when(F.col("__a").isNotNull(), x).otherwise(0.0)) / F.sum(x)
    cover = rows.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("target_bins"), (F.count("__b") / F.count(F.lit(1))).alias("coverage_before_cap"),
        (F.count("__a") / F.count(F.lit(1))).alias("coverage_after_cap"), matched.alias("matched_intensity"),
        (1.0 - matched).alias("out_of_support"))
    return counts.join(cover, ID, "left")
