"""Scores, distributions and labels of candidates against the true spectrum.

All of them start from one row per (candidate, bin) with the true values
gathered by join; sums per candidate combine on the map side and per-spectrum
totals are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.functions import spectrum as S
from peakwise.operators import metrics as M
from peakwise.operators.matching import gather_at_candidates
from peakwise.operators.transforms import ID, TINY, shares, top_peaks
from peakwise.session import cut_lineage, write_once
from peakwise.skew import row_positions, with_group_stats

KEYS = ["spectrum_id", "cand_id"]
POOL_ROWS = 10_000  # a spectrum of more candidates is not labelled by windows


def overlap_scores(cand_bins: DataFrame, true_bins: DataFrame, parts: int, tol_bins: int = 0, top: int = 20) -> DataFrame:
    """Per candidate the overlap of its unit-sum peaks with the unit-sum true spectrum.

    overlap_exact / overlap_near: share times true share in the same bin / the
    largest within ``tol_bins``; support_near, top_near: share on true bins /
    on the ``top`` strongest; false_exact: share on bins without a true peak.
    Rows are dealt into ``parts`` partitions at each step; bins should come
    dealt alike (``bin_spectra`` with ``parts``).
    """
    true_bins = true_bins.select(*ID, "bin", "intensity").repartition(parts, *ID)
    rank = F.row_number().over(W.partitionBy(*ID).orderBy(F.col("intensity").desc(), "bin"))  # bounded by the axis
    true = shares(true_bins).withColumn("top", (rank <= top).cast("double"))
    # One row per bin near a true peak: its own value, the largest around it, the top flag around it.
    moved = true.select(*ID, "bin", "intensity", "top", F.explode(F.sequence(F.lit(-tol_bins), F.lit(tol_bins))).alias("o"))
    moved = moved.withColumn("bin", F.col("bin") + F.col("o")).repartition(parts, *ID, "bin")
    near = moved.groupBy(*ID, "bin").agg(
        F.max(F.when(F.col("o") == 0, F.col("intensity"))).alias("true_exact"), F.max("intensity").alias("true_near"),
        F.max("top").alias("near_top"))
    rows = cand_bins.select(*KEYS, "bin", "intensity").join(near, [*ID, "bin"], "left").fillna(0.0, ["true_exact", "true_near", "near_top"])
    rows = shares(rows.repartition(parts, *KEYS), KEYS)  # a candidate's peaks meet once, for its total and its sums
    s = F.col("intensity")
    on = lambda c: F.when(F.col(c) > 0, s).otherwise(0.0)
    total = F.sum(s)
    return rows.groupBy(*KEYS).agg(
        F.sum(s * F.col("true_exact")).alias("overlap_exact"), F.sum(s * F.col("true_near")).alias("overlap_near"),
        F.sum(on("true_exact")).alias("support_exact"), F.sum(on("true_near")).alias("support_near"),
        F.sum(s * F.col("near_top")).alias("top_near"), (total - F.sum(on("true_exact"))).alias("false_exact"))


def softmax(rows: DataFrame, score: Column, temperature: float, out: str, keep: Column | None = None) -> DataFrame:
    """Softmax per spectrum over the kept rows; others get 0."""
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    rows = rows.withColumn("__s", F.when(kept, score / F.lit(max(temperature, 1e-6))))
    tops = rows.groupBy(*ID).agg(F.max("__s").alias("__top"))
    sums = rows.select(*ID, "__s").join(tops, ID).groupBy(*ID).agg(
        F.max("__top").alias("__top"), F.sum(F.exp(F.col("__s") - F.col("__top"))).alias("__z"))
    rows = rows.join(sums, ID)
    prob = F.coalesce(F.exp(F.col("__s") - F.col("__top")) / F.col("__z"), F.lit(0.0))
    return rows.withColumn(out, prob).drop("__s", "__top", "__z")


def overlap_teacher(scores: DataFrame, top_k: int = 64, temperature: float = 0.25) -> DataFrame:
    """Teacher distribution over the ``top_k`` candidates with a positive overlap score.

    Needs ``overlap_scores`` without bin tolerance.
    """
    score = F.round(
        6.0 * F.col("overlap_exact") + 0.5 * F.col("support_exact") + 2.0 * F.col("top_near") - 2.0 * F.col("false_exact"), 9)
    rows = scores.select(*KEYS, score.alias("score"))
    chosen = top_peaks(rows, top_k, ID, "score", "cand_id").filter("score > 0")
    # The softmax runs over the chosen ones alone: windows over at most top_k rows, in the partitioning they already have.
    inside = W.partitionBy(*ID)
    x = F.col("score") / F.lit(max(temperature, 1e-6))
    chosen = chosen.withColumn("__e", F.exp(x - F.max(x).over(inside)))
    chosen = chosen.select(*KEYS, (F.col("__e") / F.sum("__e").over(inside)).alias("prob"))
    return rows.join(chosen, KEYS, "left").fillna(0.0, ["prob"])


def utility(scores: DataFrame, false_weight: float = 1.2, temperature: float = 0.7) -> DataFrame:
    """True-hit mass minus weighted false mass: min-max scaled and as a softmax."""
    rows = cut_lineage(scores.select(*KEYS, (F.col("overlap_exact") - false_weight * F.col("false_exact")).alias("raw")))
    rows = softmax(rows, F.col("raw"), temperature, "utility_prob")
    rows = with_group_stats(rows, ID, __lo=F.min("raw"), __hi=F.max("raw"))
    scaled = (F.col("raw") - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-8)
    return rows.select(*KEYS, scaled.alias("utility"), "utility_prob")


def quality_labels(scores: DataFrame, parts: int, top_k: int = 64, min_pos: int = 8, pool_k: int = 96, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Quality in [0, 1] and the clean, fallback-completed and pool labels of every candidate.

    Spectra are dealt into ``parts`` partitions and labelled there; those of more than ``pool_rows`` candidates are ranked
    in pieces and joined instead, so no window sees more.
    """
    oe, on, sn, tn, fe = (F.col(c) for c in ("overlap_exact", "overlap_near", "support_near", "top_near", "false_exact"))
    support = F.least(F.greatest(1.0 - fe, F.lit(0.0)), F.lit(1.0))
    raw = 1.5 * oe + 0.4 * on + 0.35 * sn + 0.75 * tn - 1.2 * fe
    score = F.round(F.greatest(raw, F.lit(0.0)) * support * support, 12)
    keep = (score > 0) & (support >= 0.20) & (sn >= 0.25) & (fe <= 0.80)
    fb = F.round(0.5 * support + 0.35 * sn + 0.15 * tn, 9)
    fb_keep = (fb > 0) & (support >= 0.05) & (fe <= 0.95)
    pool = F.round(3.0 * on + 1.5 * oe + 2.0 * tn + 0.25 * sn - 0.35 * fe, 9)
    pool_keep = ((on >= 5e-4) | (oe >= 1e-4) | (tn >= 5e-4)) & (fe <= 0.97)
    rows = scores.select(
        *KEYS, F.when(keep, score).otherwise(0.0).alias("__q"), F.when(fb_keep, fb).alias("__fb"), F.when(pool_keep, pool).alias("__pool"))
    rows = write_once(rows, "quality-rows")  # one row per candidate, used below again and again
    large = rows.groupBy(*ID).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > pool_rows).select(*ID)
    large = write_once(large, "large-pools")
    if large.isEmpty():
        return _labels_inside(rows, parts, top_k, min_pos, pool_k)
    return _labels_inside(rows.join(large, ID, "left_anti"), parts, top_k, min_pos, pool_k).unionByName(
        _labels_across(rows.join(large, ID, "left_semi"), top_k, min_pos, pool_k))


def _quality(top: Column) -> Column:
    return F.when(top > 1e-8, F.round(F.col("__q") / top, 9)).otherwise(0.0)


def _completed(min_pos: int) -> Column:
    return F.when(F.col("__n") < min_pos, F.greatest("__clean", "__fbin")).otherwise(F.col("__clean"))


def _label_columns(rows: DataFrame, min_pos: int) -> DataFrame:
    return rows.select(
        *KEYS, "quality", F.col("__clean").alias("clean_label"), "label", "pool_label",
        (F.col("__n") < min_pos).cast("int").alias("fallback_used"))


def _labels_inside(rows: DataFrame, parts: int, top_k: int, min_pos: int, pool_k: int) -> DataFrame:
    """The labels by windows over whole spectra, whose candidates are bounded in number."""
    inside = W.partitionBy(*ID)

    def first(value: Column, n: int) -> Column:
        return (value.isNotNull() & (F.row_number().over(inside.orderBy(value.desc(), "cand_id")) <= n)).cast("int")

    quality = F.col("quality")
    rows = rows.repartition(parts, *ID).withColumn("quality", _quality(F.max("__q").over(inside)))
    rows = rows.withColumns({
        "__clean": first(F.when(F.col("__q") > 0, quality), top_k), "__fbin": first(F.col("__fb"), min_pos),
        "pool_label": first(F.col("__pool"), pool_k)})
    rows = rows.withColumn("__n", F.sum("__clean").over(inside)).withColumn("__label", _completed(min_pos))
    return _label_columns(rows.withColumn("label", first(F.when(F.col("__label") == 1, quality), top_k)), min_pos)


def _labels_across(rows: DataFrame, top_k: int, min_pos: int, pool_k: int) -> DataFrame:
    """The labels of few spectra with any number of candidates: totals and the first ones are joined back."""
    rows = with_group_stats(rows, ID, __top=F.max("__q"))
    rows = rows.withColumn("quality", _quality(F.col("__top")))

    def first(col: str, n: int, cond: Column, flag: str) -> DataFrame:
        return top_peaks(rows.filter(cond), n, ID, col, "cand_id").select(*KEYS, F.lit(1).alias(flag))

    rows = (
        rows.join(first("quality", top_k, F.col("__q") > 0, "__clean"), KEYS, "left")
        .join(first("__fb", min_pos, F.col("__fb").isNotNull(), "__fbin"), KEYS, "left")
        .join(first("__pool", pool_k, F.col("__pool").isNotNull(), "pool_label"), KEYS, "left")
        .fillna(0, ["__clean", "__fbin", "pool_label"]))
    rows = with_group_stats(rows, ID, __n=F.sum("__clean"))
    rows = rows.withColumn("__label", _completed(min_pos))
    kept = top_peaks(rows.filter("__label = 1"), top_k, ID, "quality", "cand_id").select(*KEYS, F.lit(1).alias("label"))
    return _label_columns(rows.join(kept, KEYS, "left").fillna(0, ["label"]), min_pos)


def target_distribution(rows: DataFrame, value: str, top_k: int = 0, out: str = "target") -> DataFrame:
    """Non-negative values divided by their sum, uniform where the sum is tiny; optionally the top k only."""
    v = F.greatest(F.coalesce(F.nanvl(F.col(value), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("__v", v)
    if top_k > 0:
        kept = top_peaks(rows, top_k, ID, "__v", "cand_id").select(*KEYS, F.lit(1).alias("kept"))
        rows = rows.join(kept, KEYS, "left").fillna(0, ["kept"])
        rows = rows.withColumn("__v", F.when(F.col("kept") == 1, F.col("__v")).otherwise(0.0))
    rows = with_group_stats(rows, ID, __s=F.sum("__v"), __n=F.count(F.lit(1)))
    return rows.withColumn(out, F.when(F.col("__s") > TINY, F.col("__v") / F.col("__s")).otherwise(1.0 / F.col("__n"))).drop(
        "__v", "__s", "__n")


def peak_shares(cand_bins: DataFrame, true_bins: DataFrame) -> DataFrame:
    """Per candidate the true values at its peaks divided by their sum (candidates without a hit are left out)."""
    rows = gather_at_candidates(cand_bins.select(*KEYS, "bin", "intensity"), true_bins)
    rows = with_group_stats(rows, KEYS, __s=F.sum("true_exact")).filter(F.col("__s") > 0)
    return rows.select(*KEYS, "bin", (F.col("true_exact") / F.greatest("__s", F.lit(1e-8))).alias("peak_target"))


def rerank_target(pool: DataFrame, quality: str = "quality", positives: int = 24) -> DataFrame:
    """Pool-normalised quality and the flag of its ``positives`` largest."""
    rows = pool.withColumn("__q", F.greatest(F.col(quality), F.lit(0.0)))
    rows = with_group_stats(rows, ID, __s=F.sum("__q"))
    rows = rows.withColumn("target", F.col("__q") / F.greatest("__s", F.lit(1e-8)))
    best = top_peaks(rows, positives, ID, "target", "cand_id").select(*KEYS, F.lit(1).alias("positive"))
    return rows.join(best, KEYS, "left").fillna(0, ["positive"]).select(*KEYS, "target", "positive")


def selection_metrics(
    ranked: DataFrame, teacher: DataFrame, cand_bins: DataFrame, true_bins: DataFrame, ks: Sequence[int]
) -> DataFrame:
    """Per k the mean over spectra of selection quality.

    ``ranked(spectrum_id, cand_id, rank, quality)`` is ranked by the selector;
    ``teacher`` lists the wanted candidates.  Recall and precision against the
    teacher, purity of the selected peaks, recall of true peaks and intensity
    by the selected pool, mean quality and the share above 0.3.
    """
    top = max(ks)
    k_list = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    wanted = teacher.select(*KEYS).distinct().withColumn("__w", F.lit(1))
    chosen = ranked.filter(F.col("rank") <= top).join(wanted, KEYS, "left")
    by_cand = chosen.select("*", k_list).filter(F.col("rank") <= F.col("k")).groupBy(*ID, "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("__w", F.lit(0))).alias("hits"), F.avg("quality").alias("q"),
        F.avg((F.col("quality") > 0.3).cast("double")).alias("q3"))
    n_wanted = wanted.groupBy(*ID).agg(F.count(F.lit(1)).alias("wanted"))
    peaks = gather_at_candidates(
        cand_bins.select(*KEYS, "bin", "intensity").join(chosen.select(*KEYS, "rank"), KEYS), true_bins)
    x = F.col("intensity")
    hit = F.when(F.col("true_exact") > 0, x).otherwise(0.0)
    purity = peaks.select("*", k_list).filter(F.col("rank") <= F.col("k")).groupBy(*ID, "k").agg(
        (F.sum(hit) / F.sum(x)).alias("purity"))
    # A true bin is covered at k when the best rank among candidates with that bin is at most k.
    first = peaks.filter("true_exact > 0").groupBy(*ID, "bin").agg(F.min("rank").alias("first"), F.max("true_exact").alias("t"))
    total = true_bins.groupBy(*ID).agg(F.count(F.lit(1)).alias("true_n"), F.sum("intensity").alias("true_i"))
    covered = first.select("*", k_list).filter(F.col("first") <= F.col("k")).groupBy(*ID, "k").agg(
        F.count(F.lit(1)).alias("cn"), F.sum("t").alias("ci"))
    rows = (
        by_cand.join(n_wanted, ID, "left").join(purity, [*ID, "k"], "left").join(total, ID, "left")
        .join(covered, [*ID, "k"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy("k").agg(
        F.avg(F.col("hits") / F.greatest(zero("wanted"), F.lit(1))).alias("teacher_recall"),
        F.avg(F.col("hits") / F.col("n")).alias("teacher_precision"), F.avg("purity").alias("true_hit_mass"),
        F.avg(1.0 - F.col("purity")).alias("false_mass"), F.avg(zero("cn") / F.col("true_n")).alias("pool_peak_recall"),
        F.avg(zero("ci") / F.col("true_i")).alias("pool_intensity_recall"), F.avg("q").alias("quality_mean"),
        F.avg("q3").alias("quality_precision"))


def teacher_audit(teachers: dict[str, DataFrame], cand_bins: DataFrame, true_bins: DataFrame, k: int) -> DataFrame:
    """Purity of each teacher's top k and its mean number of positive candidates, side by side.

    Each teacher is ``(spectrum_id, cand_id, prob)``.
    """
    parts = [df.select(F.lit(name).alias("teacher"), *KEYS, "prob") for name, df in teachers.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    group = ["teacher", *ID]
    n = rows.groupBy(*group).agg(F.sum((F.col("prob") > 0).cast("long")).alias("selected_n"))
    best = top_peaks(rows, k, group, "prob", "cand_id").select("teacher", *KEYS)
    peaks = gather_at_candidates(cand_bins.select(*KEYS, "bin", "intensity").join(best, KEYS), true_bins)
    x = F.col("intensity")
    purity = peaks.groupBy(*group).agg((F.sum(F.when(F.col("true_exact") > 0, x).otherwise(0.0)) / F.sum(x)).alias("p"))
    return n.join(purity, group, "left").groupBy("teacher").agg(
        F.avg("p").alias("true_hit_mass"), F.avg(1.0 - F.col("p")).alias("false_mass"), F.avg("selected_n").alias("selected_n"))


# ---- probes of candidate pools ----


def _true_ranks(rows: DataFrame, value: str, **totals: Column) -> DataFrame:
    """``rows`` of binned spectra, dealt by spectrum, plus ``tr``, the rank by ``value``, and totals; bounded by the bins of the axis."""
    whole = W.partitionBy(*ID)
    order = whole.orderBy(F.col(value).desc(), "bin")
    return rows.withColumns({"tr": F.row_number().over(order), **{n: c.over(whole) for n, c in totals.items()}})


def probe_candidates(cand_bins: DataFrame, true_bins: DataFrame, parts: int, top: int = 20, pool_rows: int = POOL_ROWS) -> DataFrame:
    """Cosine, JS similarity, coverage, top recall, precision, recall and IoU of every candidate, with its rank by cosine.

    Only bins shared with the true spectrum are joined: what a candidate and
    the spectrum have alone enters through their totals.  Rows are dealt into
    ``parts`` partitions at each step; bins should come dealt alike
    (``bin_spectra`` with ``parts``).  Spectra of more than ``pool_rows``
    candidates are ranked in pieces.
    """
    x, t = F.col("intensity"), F.col("t")
    true = true_bins.select(*ID, "bin", x.alias("t")).repartition(parts, *ID)
    true = write_once(_true_ranks(true, "t", tn=F.count(F.lit(1)), ts=F.sum(t), tt=F.sum(t * t)), "true-ranks")
    shared = true.select(*ID, "bin", "t", "tr", "ts").repartition(parts, *ID, "bin")
    # A candidate's peaks meet once, for its total and its sums.
    both = cand_bins.select(*KEYS, "bin", "intensity").join(shared, [*ID, "bin"], "left").repartition(parts, *KEYS)
    both = both.withColumn("cs", F.sum(x).over(W.partitionBy(*KEYS)))
    a, b = x / F.col("cs"), t / F.col("ts")
    m = (a + b) * 0.5
    sums = both.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("cn"), F.sqrt(F.sum(x * x)).alias("cnorm"),
        F.count(t).alias("bn"), F.sum(x * t).alias("dot"), F.sum(t).alias("bt"), F.sum(F.when(t.isNotNull(), a)).alias("ba"), F.sum(b).alias("bb"),
        F.sum(a * F.log(a / m) + b * F.log(b / m)).alias("kl"), F.sum((F.col("tr") <= top).cast("long")).alias("hits"))
    sums = write_once(sums.fillna(0, ["hits"]).fillna(0.0, ["dot", "bt", "ba", "bb", "kl"]), "candidate-sums")
    totals = true.filter("tr = 1").select(*ID, "tn", "ts", F.sqrt("tt").alias("tnorm")).repartition(parts, *ID)

    def scored(rows: DataFrame) -> DataFrame:
        rows = rows.repartition(parts, *ID).join(totals, ID, "left")
        n_both, n_c, n_t = F.col("bn"), F.col("cn"), F.coalesce("tn", F.lit(0))
        js = 0.5 * ((1 - F.col("ba")) * M.LN2 + (1 - F.col("bb")) * M.LN2 + F.col("kl"))
        sim = F.least(F.greatest(1.0 - F.greatest(js, F.lit(0.0)) / M.LN2, F.lit(0.0)), F.lit(1.0))
        return rows.select(
            *KEYS, F.round(M.cosine_expr(F.col("dot"), F.col("cnorm"), F.coalesce("tnorm", F.lit(0.0))), 9).alias("cosine"),
            F.when(n_t > 0, sim).otherwise(0.0).alias("js"), (F.col("bt") / F.col("ts")).alias("coverage"),
            (F.col("hits") / F.least(F.col("tn"), F.lit(top))).alias("top_recall"), (n_both / n_c).alias("precision"),
            (n_both / F.col("tn")).alias("recall"), (n_both / (n_c + n_t - n_both)).alias("iou"))

    def inside(rows: DataFrame) -> DataFrame:
        return scored(rows).withColumn("rank", F.rank().over(W.partitionBy(*ID).orderBy(F.col("cosine").desc(), "cand_id")).cast("int"))

    large = sums.groupBy(*ID).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > pool_rows).select(*ID)
    large = write_once(large, "large-pools")
    if large.isEmpty():
        return inside(sums)
    return inside(sums.join(large, ID, "left_anti")).unionByName(row_positions(scored(sums.join(large, ID, "left_semi")), ID, "cosine", "cand_id", "rank"))


def union_at_k(
    cand_bins: DataFrame, ranks: DataFrame, true_bins: DataFrame, parts: int, ks: Sequence[int] = (5, 10, 100, 1000), top: int = 20
) -> DataFrame:
    """Coverage, top recall, precision and IoU of the union of the first k candidates, per spectrum and k.

    The smallest rank per bin answers every k at once; candidates behind the largest k are in no union.  Rows are dealt
    into ``parts`` partitions at each step, as in ``probe_candidates``.
    """
    best = ranks.filter(F.col("rank") <= max(ks)).select(*KEYS, "rank").repartition(parts, *KEYS)
    first = cand_bins.select(*KEYS, "bin").repartition(parts, *KEYS).join(best, KEYS).select(*ID, "bin", "rank")
    first = first.repartition(parts, *ID, "bin").groupBy(*ID, "bin").agg(F.min("rank").alias("first"))
    rows = first.join(true_bins.select(*ID, "bin", F.col("intensity").alias("t")), [*ID, "bin"], "full_outer")
    rows = _true_ranks(rows.repartition(parts, *ID), "t")  # bins without a true peak come last
    real = F.col("t").isNotNull()
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))

    def metrics(k: int) -> Column:
        inside = F.coalesce(F.col("first") <= k, F.lit(False))
        return F.struct(
            F.lit(int(k)).alias("k"), (F.sum(F.when(inside, F.col("t"))) / F.sum("t")).alias("coverage"),
            (count(inside & real & (F.col("tr") <= top)) / F.nullif(count(real & (F.col("tr") <= top)), F.lit(0))).alias("top_recall"),
            (count(inside & real) / F.nullif(count(inside), F.lit(0))).alias("precision"),
            (count(inside & real) / F.nullif(count(inside | real), F.lit(0))).alias("iou"))

    # A spectrum's bins are together here, so its sums for all k need no further shuffle.
    sums = rows.groupBy(*ID).agg(F.array(*[metrics(k) for k in ks]).alias("__m"))
    return sums.select(*ID, F.explode("__m").alias("__m")).select(*ID, "__m.*").fillna(0.0, ["coverage"])


# Overlapping source groups of a pool (source 1 structural, 2 common loss, 3 both).
SOURCE_GROUPS = {
    "formula_only": lambda s: s == 0, "structural_formula": lambda s: s.isin(1, 3),
    "common_loss_formula": lambda s: s.isin(2, 3), "any_source_formula": lambda s: s > 0,
}


def source_group_probe(cand_bins: DataFrame, flags: DataFrame, true_bins: DataFrame, top: int = 20) -> DataFrame:
    """Union metrics of every source group of a spectrum's pool."""
    s = F.col("source_flag")
    tags = F.array_compact(F.array(*[F.when(test(s), F.lit(n)) for n, test in SOURCE_GROUPS.items()]))
    tagged = flags.select(*KEYS, F.explode(tags).alias("source_group"))
    group = ["source_group", *ID]
    support = cand_bins.join(tagged, KEYS).select(*group, "bin").distinct()
    size = tagged.groupBy(*group).agg(F.count(F.lit(1)).alias("n_candidates"))
    order = W.partitionBy(*ID).orderBy(F.col("intensity").desc(), "bin")
    true = true_bins.select(*ID, "bin", F.col("intensity").alias("t"), (F.row_number().over(order) <= top).cast("long").alias("is_top"))
    totals = true.groupBy(*ID).agg(F.count(F.lit(1)).alias("tn"), F.sum("t").alias("ts"), F.sum("is_top").alias("top_n"))
    hit = support.join(true, [*ID, "bin"], "left").groupBy(*group).agg(
        F.count(F.lit(1)).alias("support_n"), F.count("t").alias("both"), F.sum("t").alias("ht"), F.sum("is_top").alias("htop"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return size.join(hit, group, "left").join(totals, ID, "left").select(
        *group, "n_candidates", zero("support_n").alias("support_n"),
        (F.col("both") / F.col("support_n")).alias("precision"), (zero("both") / F.col("tn")).alias("recall"),
        (F.coalesce("ht", F.lit(0.0)) / F.col("ts")).alias("coverage"), (zero("htop") / F.col("top_n")).alias("top_recall"))


def oracle_mixture(cand_bins: DataFrame, true_bins: DataFrame, ks: Sequence[int]) -> DataFrame:
    """How well the best k candidates can mix into the true spectrum, per spectrum and k.

    Candidates are ranked by true dot product plus 0.1 overlap minus 0.02 false
    share; positive scores are the weights, all equal where none is positive.
    """
    share = shares(cand_bins.select(*KEYS, "bin", "intensity"), KEYS)
    true = shares(true_bins.select(*ID, "bin", "intensity"))
    at = gather_at_candidates(share, true)
    x, t = F.col("intensity"), F.col("true_exact")
    hit = F.sum(F.when(t > 0, x).otherwise(0.0))
    scores = at.groupBy(*KEYS).agg(F.round(F.sum(x * t) + 0.1 * hit - 0.02 * (1.0 - hit), 9).alias("score"))
    best = top_peaks(scores, max(ks), ID, "score", "cand_id")
    best = best.select("*", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")).filter(F.col("rank") <= F.col("k"))
    group = [*ID, "k"]
    best = best.withColumn("w", F.greatest("score", F.lit(0.0)))
    best = with_group_stats(best, group, __s=F.sum("w"), __n=F.count(F.lit(1)))
    best = best.select(*group, "cand_id", F.when(F.col("__s") > TINY, F.col("w") / F.col("__s")).otherwise(1.0 / F.col("__n")).alias("w"))
    mix = best.join(share, KEYS).groupBy(*group, "bin").agg(F.sum(F.col("w") * x).alias("p"))
    rows = mix.join(true.select(*ID, "bin", x.alias("t")), [*ID, "bin"], "left")
    norm = true.groupBy(*ID).agg(F.sqrt(F.sum(x * x)).alias("__tn"))
    p, tt = F.col("p"), F.coalesce("t", F.lit(0.0))
    out = rows.groupBy(*group).agg(
        F.sum(p * tt).alias("dot"), F.sqrt(F.sum(p * p)).alias("pn"), F.sum(p).alias("ps"), F.sum(tt).alias("coverage"),
        F.sum(F.when(tt <= 0, p).otherwise(0.0)).alias("fp"))
    return out.join(norm, ID, "left").select(
        *group, F.when(F.col("pn") * F.col("__tn") > TINY, F.col("dot") / (F.col("pn") * F.col("__tn"))).otherwise(0.0).alias("oracle_cosine"),
        "coverage", (F.col("fp") / F.col("ps")).alias("false_mass"))


def feature_correlation(features: DataFrame, names: Sequence[str], score: str, min_n: int = 5) -> DataFrame:
    """Best and mean absolute rank correlation of candidate features with a score, per spectrum."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    sized = with_group_stats(features, ID, __n=F.count(F.lit(1))).filter(F.col("__n") >= min_n)
    long = sized.select(*ID, F.col(score).alias("score"), F.explode(cells).alias("c")).select(*ID, "score", "c.*")
    rho = M.spearman(long, [*ID, "feature"], "value", "score", "rho").withColumn("a", F.round(F.abs("rho"), 9)).filter("a IS NOT NULL")
    best = F.max(F.struct("a", "feature"))
    return rho.groupBy(*ID).agg(best.alias("b"), F.avg("a").alias("mean_abs_rho")).select(
        *ID, F.col("b.a").alias("best_abs_rho"), F.col("b.feature").alias("best_feature"), "mean_abs_rho")


def fragment_nodes(nodes: DataFrame, true_bins: DataFrame, precursors: DataFrame, max_mz: float = S.MAX_MZ,
                   bin_width: float = S.BIN_WIDTH, slack: float = 1.0, top: int = 20) -> DataFrame:
    """Fragment rows with bin, true intensity and labels.

    ``nodes(spectrum_id, node_id, mz)``; nodes above the precursor plus
    ``slack`` or off the axis are dropped.
    """
    rows = nodes.join(precursors.select(*ID, "precursor_mz"), ID, "left").filter(
        (F.col("mz") > 0) & (F.col("mz") < max_mz) & F.coalesce(F.col("mz") <= F.col("precursor_mz") + slack, F.lit(True)))
    best = top_peaks(true_bins, top, ID, "intensity", "bin").select(*ID, "bin", F.lit(1).alias("is_top"))
    true = shares(true_bins.select(*ID, "bin", "intensity")).withColumnRenamed("intensity", "true_intensity")
    return rows.withColumn("bin", S.bin_index(F.col("mz"), bin_width)).join(true, [*ID, "bin"], "left").join(
        best, [*ID, "bin"], "left").fillna(0.0, ["true_intensity"]).fillna(0, ["is_top"]).select(
        *ID, "node_id", "mz", "bin", "true_intensity", (F.col("true_intensity") > 0).cast("int").alias("label"), "is_top")


def fragment_node_stats(nodes: DataFrame, true_bins: DataFrame, top: int = 20) -> DataFrame:
    """Node-level and unique-bin coverage of the true spectrum by its fragment nodes."""
    per_node = nodes.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("node_n"), F.sum("label").alias("hit_node_n"), F.sum("is_top").alias("top_node_n"))
    per_bin = nodes.groupBy(*ID, "bin").agg(
        F.max("true_intensity").alias("t"), F.max("label").alias("l"), F.max("is_top").alias("top")).groupBy(*ID).agg(
        F.count(F.lit(1)).alias("bin_n"), F.sum("l").alias("hit_bin_n"), F.sum("top").alias("top_bin_n"), F.sum("t").alias("intensity_coverage"))
    totals = true_bins.groupBy(*ID).agg(F.count(F.lit(1)).alias("true_n"))
    return per_node.join(per_bin, ID).join(totals, ID, "left").select(
        *ID, "node_n", "hit_node_n", "top_node_n", "bin_n", "hit_bin_n", "top_bin_n",
        (F.col("hit_bin_n") / F.col("true_n")).alias("support_coverage"), "intensity_coverage",
        (F.col("hit_node_n") / F.col("node_n")).alias("node_hit_ratio"), (F.col("hit_bin_n") / F.col("bin_n")).alias("bin_hit_ratio"),
        (F.col("top_bin_n") / F.least(F.col("true_n"), F.lit(top))).alias("top_recall"))
