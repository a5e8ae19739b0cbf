"""Queries for pairwise metrics and the flagship evaluation."""

from pyspark.sql import functions as F

from peakwise.functions import spectrum as S
from peakwise.operators import metrics as M
from peakwise.operators import transforms as T
from peakwise.plans.registry import query
from peakwise.plans.spectra import CAND_BINS_SQL, out
from peakwise.session import parts_for
from peakwise.skew import r6


def bins_sql(name: str, source: str, width: str = "0.01", last: int = 100500) -> str:
    return f"""{name} AS (
SELECT spectrum_id, CAST(floor(mz / {width} + 1e-8) AS bigint) AS bin, sum(intensity) AS intensity
FROM {source} WHERE intensity > 0 AND floor(mz / {width} + 1e-8) BETWEEN 0 AND {last} GROUP BY ALL)"""


def pairs_sql(a: str, b: str) -> str:
    return f"""pairs AS (
SELECT coalesce(a.spectrum_id, b.spectrum_id) AS spectrum_id, coalesce(a.bin, b.bin) AS bin,
       coalesce(a.intensity, 0) AS t, coalesce(b.intensity, 0) AS p
FROM {a} a FULL JOIN {b} b ON a.spectrum_id = b.spectrum_id AND a.bin = b.bin)"""


PAIRS_SQL = f"{bins_sql('tb', 'peaks')}, {bins_sql('pb', 'pred_peaks')}, {pairs_sql('tb', 'pb')}"
WIDE_SQL = f"""{bins_sql('tb', 'peaks', '1.0', 1005)}, {bins_sql('pb', 'pred_peaks', '1.0', 1005)},
{pairs_sql('tb', 'pb')}"""
SHARES_SQL = """shares AS (
SELECT *, CASE WHEN sum(t) OVER w > 1e-12 THEN t / sum(t) OVER w ELSE 0 END AS pt,
       CASE WHEN sum(p) OVER w > 1e-12 THEN p / sum(p) OVER w ELSE 0 END AS pp
FROM pairs WINDOW w AS (PARTITION BY spectrum_id))"""
COS_SQL = """CASE WHEN sqrt(sum(t * t)) > 1e-12 AND sqrt(sum(p * p)) > 1e-12
    THEN sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p)) + 1e-12) ELSE 0 END"""
SQRT_COS_SQL = """CASE WHEN sqrt(sum(t)) > 1e-12 AND sqrt(sum(p)) > 1e-12
    THEN sum(sqrt(t * p)) / (sqrt(sum(t)) * sqrt(sum(p)) + 1e-12) ELSE 0 END"""
JS_SQL = """CASE WHEN sum(t) <= 1e-12 AND sum(p) <= 1e-12 THEN 1 WHEN sum(t) <= 1e-12 OR sum(p) <= 1e-12 THEN 0
    ELSE least(greatest(1 - greatest(sum(0.5 * CASE WHEN pt > 0 THEN pt * ln(pt / ((pt + pp) * 0.5)) ELSE 0 END
       + 0.5 * CASE WHEN pp > 0 THEN pp * ln(pp / ((pt + pp) * 0.5)) ELSE 0 END), 0) / ln(2), 0), 1) END"""
EVAL_SQL = f"""evaluated AS (
SELECT spectrum_id, {COS_SQL} AS cosine, {SQRT_COS_SQL} AS sqrt_cosine, {JS_SQL} AS js,
       CASE WHEN sum(t) > 1e-12 THEN sum(CASE WHEN p > 0 THEN t ELSE 0 END) / sum(t) END AS coverage,
       count(*) FILTER (t > 0 AND rn <= 20 AND p > 0) / nullif(count(*) FILTER (t > 0 AND rn <= 20), 0) AS topk_recall,
       count(*) FILTER (p > 0) AS pred_n, count(*) FILTER (t > 0) AS true_n,
       count(*) FILTER (t > 0 AND p > 0) AS overlap_n, count(*) FILTER (p > 0 AND t <= 0) AS false_pred_n,
       CASE WHEN sum(p) > 1e-12 THEN sum(CASE WHEN t > 0 THEN p ELSE 0 END) / sum(p) END AS pred_on_true
FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY t DESC, bin) AS rn FROM shares)
GROUP BY spectrum_id)"""


def true_bins(d, **kw):
    return T.bin_spectra(d.peaks, **kw)


def pred_bins(d, **kw):
    return T.bin_spectra(d.pred_peaks, **kw)


def pairs(d, **kw):
    return M.pair_peaks(d.peaks, d.pred_peaks, parts_for(d.table("lineitem")), **kw)


@query("flagship_quality_by_instrument", f"""
WITH t0 AS (SELECT p.* FROM peaks p LEFT JOIN spectra s ON p.spectrum_id = s.spectrum_id
            WHERE NOT coalesce(floor(mz / 0.01 + 1e-8) = floor(precursor_mz / 0.01 + 1e-8), false)),
p0 AS (SELECT p.* FROM pred_peaks p LEFT JOIN spectra s ON p.spectrum_id = s.spectrum_id
       WHERE NOT coalesce(floor(mz / 0.01 + 1e-8) = floor(precursor_mz / 0.01 + 1e-8), false)),
{bins_sql('tb', 't0')}, {bins_sql('pb', 'p0')}, {pairs_sql('tb', 'pb')}, {SHARES_SQL}, {EVAL_SQL}
SELECT coalesce(instrument_raw, '<missing>') AS instrument, count(*) AS n, round(avg(cosine), 6) AS cosine,
       round(avg(sqrt_cosine), 6) AS sqrt_cosine, round(avg(js), 6) AS js, round(avg(coverage), 6) AS coverage,
       round(avg(topk_recall), 6) AS topk_recall
FROM evaluated e JOIN spectra s ON e.spectrum_id = s.spectrum_id GROUP BY 1""", "peaks pred_peaks spectra")
def flagship(d):
    """Predictions against measurements, precursor removed, averaged by instrument."""
    meta = d.spectra.select("spectrum_id", "precursor_mz")
    t = T.bin_spectra(T.drop_precursor_bin(d.peaks, meta))
    p = T.bin_spectra(T.drop_precursor_bin(d.pred_peaks, meta))
    scores = M.evaluate(M.pair_bins(t, p))
    named = d.spectra.select("spectrum_id", F.coalesce("instrument_raw", F.lit("<missing>")).alias("instrument"))
    cols = ["cosine", "sqrt_cosine", "js", "coverage", "topk_recall"]
    return scores.join(named, "spectrum_id").groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n"), *[r6(F.avg(c)).alias(c) for c in cols])


@query("j03_evaluate_predictions", f"""
WITH {PAIRS_SQL}, {SHARES_SQL}, {EVAL_SQL}
SELECT * REPLACE (round(cosine, 6) AS cosine, round(sqrt_cosine, 6) AS sqrt_cosine, round(js, 6) AS js,
  round(coverage, 6) AS coverage, round(topk_recall, 6) AS topk_recall, round(pred_on_true, 6) AS pred_on_true)
FROM evaluated""", "peaks pred_peaks")
def _(d):
    return out(M.evaluate(pairs(d)), "cosine", "sqrt_cosine", "js", "coverage", "topk_recall", "pred_on_true")


@query("j04_shared_bins", f"""
WITH {PAIRS_SQL} SELECT spectrum_id, bin, round(t, 6) AS t, round(p, 6) AS p FROM pairs WHERE t > 0 AND p > 0""",
       "peaks pred_peaks")
def _(d):
    return out(M.pair_bins_inner(true_bins(d), pred_bins(d)), "t", "p")


@query("j05_union_bins", f"WITH {PAIRS_SQL} SELECT spectrum_id, bin, round(t, 6) AS t, round(p, 6) AS p FROM pairs",
       "peaks pred_peaks")
def _(d):
    return out(pairs(d), "t", "p")


@query("m01_cosine", f"""
WITH {PAIRS_SQL} SELECT spectrum_id, round({COS_SQL}, 6) AS cosine, round({SQRT_COS_SQL}, 6) AS sqrt_cosine
FROM pairs GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.cosine(pairs(d)), "cosine", "sqrt_cosine")


@query("m02_cosine_max_merge_without_precursor", f"""
WITH tb AS (SELECT p.spectrum_id, CAST(floor(mz / 0.5) AS bigint) AS bin,
  max(CASE WHEN floor(mz / 0.5) = floor(precursor_mz / 0.5) THEN 0 ELSE intensity END) AS intensity
  FROM peaks p LEFT JOIN spectra s ON p.spectrum_id = s.spectrum_id GROUP BY ALL),
pb AS (SELECT p.spectrum_id, CAST(floor(mz / 0.5) AS bigint) AS bin,
  max(CASE WHEN floor(mz / 0.5) = floor(precursor_mz / 0.5) THEN 0 ELSE intensity END) AS intensity
  FROM pred_peaks p LEFT JOIN spectra s ON p.spectrum_id = s.spectrum_id GROUP BY ALL), {pairs_sql('tb', 'pb')}
SELECT spectrum_id, round({COS_SQL}, 6) AS cosine, round({SQRT_COS_SQL}, 6) AS sqrt_cosine FROM pairs GROUP BY 1""",
       "peaks pred_peaks spectra")
def _(d):
    rows = M.pair_peaks_max(d.peaks, d.pred_peaks, d.spectra, parts_for(d.table("lineitem")), 0.5)
    return out(M.cosine(rows), "cosine", "sqrt_cosine")


@query("m03_js_similarity", f"WITH {PAIRS_SQL}, {SHARES_SQL} SELECT spectrum_id, round({JS_SQL}, 6) AS js FROM shares "
       "GROUP BY 1", "peaks pred_peaks")
def _(d):
    return out(M.js_similarity(pairs(d)), "js")


INT_SQL = f"""tops AS (SELECT spectrum_id, ceil(max(mz)) AS n FROM
  (SELECT spectrum_id, mz FROM peaks UNION ALL SELECT spectrum_id, mz FROM pred_peaks) GROUP BY 1),
tb AS (SELECT p.spectrum_id, CAST(least(floor(mz + 0.5), n - 2) AS bigint) AS bin, sum(intensity) AS intensity
  FROM peaks p JOIN tops USING (spectrum_id) WHERE mz >= -0.5 AND mz <= n - 1.5 GROUP BY ALL),
pb AS (SELECT p.spectrum_id, CAST(least(floor(mz + 0.5), n - 2) AS bigint) AS bin, sum(intensity) AS intensity
  FROM pred_peaks p JOIN tops USING (spectrum_id) WHERE mz >= -0.5 AND mz <= n - 1.5 GROUP BY ALL), {pairs_sql('tb', 'pb')}"""


def int_pairs(d):
    both = d.peaks.select("spectrum_id", "mz").unionByName(d.pred_peaks.select("spectrum_id", "mz"))
    tops = both.groupBy("spectrum_id").agg(F.max("mz").alias("top"))
    return M.pair_bins(M.integer_bins(d.peaks, tops), M.integer_bins(d.pred_peaks, tops))


def stein_sql(a, b):
    return f"""CASE WHEN sqrt(sum(pow(pow(bin, {a}) * pow(t, {b}), 2))) * sqrt(sum(pow(pow(bin, {a}) * pow(p, {b}), 2))) > 1e-12
  THEN sum(pow(bin, {a}) * pow(t, {b}) * pow(bin, {a}) * pow(p, {b}))
     / (sqrt(sum(pow(pow(bin, {a}) * pow(t, {b}), 2))) * sqrt(sum(pow(pow(bin, {a}) * pow(p, {b}), 2)))) END"""


@query("m04_stein_dot", f"""
WITH {INT_SQL} SELECT spectrum_id, round({stein_sql(3.0, 0.6)}, 6) AS stein, round({stein_sql(0.5, 0.5)}, 6) AS dot
FROM pairs GROUP BY 1""", "peaks pred_peaks")
def _(d):
    rows = int_pairs(d)
    stein = M.weighted_dot(rows, 3.0, 0.6).withColumnRenamed("weighted_dot", "stein")
    dot = M.weighted_dot(rows, 0.5, 0.5).withColumnRenamed("weighted_dot", "dot")
    return out(stein.join(dot, "spectrum_id"), "stein", "dot")


@query("m05_l1_distance", f"""
WITH {WIDE_SQL}, {SHARES_SQL} SELECT spectrum_id, round(sum(abs(pt - pp)), 9) AS l1 FROM shares GROUP BY 1""",
       "peaks pred_peaks")
def _(d):
    return M.distances(pairs(d, bin_width=1.0), 1006).select("spectrum_id", r6("l1", 9).alias("l1"))


@query("m06_false_mass", f"""
WITH {PAIRS_SQL}, {SHARES_SQL}
SELECT spectrum_id, round(sum(CASE WHEN pt < 1e-3 THEN pp ELSE 0 END), 6) AS invalid_mass,
       round(sum(CASE WHEN pt <= 5e-3 THEN pp ELSE 0 END), 6) AS weak_mass,
       round(sum(CASE WHEN t <= 1e-12 THEN pp ELSE 0 END), 6) AS false_support_mass FROM shares GROUP BY 1""",
       "peaks pred_peaks")
def _(d):
    return out(M.false_mass(pairs(d)), "invalid_mass", "weak_mass", "false_support_mass")


@query("m07_distances", f"""
WITH {PAIRS_SQL}, {SHARES_SQL}, c AS (
SELECT spectrum_id, sum(CASE WHEN pt > 0 THEN pt * (ln(pt) - ln(greatest(pp, 1e-12))) ELSE 0 END) AS kl,
  1 - sum(pt * pp) / greatest(sqrt(sum(pt * pt)) * sqrt(sum(pp * pp)), 1e-12) AS cd,
  1 - (sum(sqrt(greatest(pt, 1e-12) * greatest(pp, 1e-12))) + (100501 - count(*)) * 1e-12)
    / greatest(sqrt(sum(greatest(pt, 1e-12)) + (100501 - count(*)) * 1e-12)
             * sqrt(sum(greatest(pp, 1e-12)) + (100501 - count(*)) * 1e-12), 1e-12) AS sd
FROM shares GROUP BY 1)
SELECT spectrum_id, round(kl, 6) + 0.0 AS kl, round(cd, 6) + 0.0 AS cosine_distance,
       round(sd, 6) + 0.0 AS sqrt_cosine_distance, round(0.8 * cd + 0.2 * sd, 6) + 0.0 AS mixed_distance FROM c""",
       "peaks pred_peaks")
def _(d):
    dist = M.distances(pairs(d), 100501).drop("l1")
    return out(dist, "kl", "cosine_distance", "sqrt_cosine_distance", "mixed_distance")


for _name, _col in (("m08_matched_coverage", "coverage"), ("m09_top20_recall", "topk_recall")):
    query(_name, f"WITH {PAIRS_SQL}, {SHARES_SQL}, {EVAL_SQL} SELECT spectrum_id, round({_col}, 6) AS {_col} "
          "FROM evaluated", "peaks pred_peaks")(
        lambda d, c=_col: out(M.evaluate(pairs(d)).select("spectrum_id", c), c))


@query("m10_support_counts", f"""
WITH {PAIRS_SQL}, {SHARES_SQL}, {EVAL_SQL} SELECT spectrum_id, pred_n, true_n, overlap_n, false_pred_n,
  round(pred_on_true, 6) AS pred_on_true FROM evaluated""", "peaks pred_peaks")
def _(d):
    cols = ["spectrum_id", "pred_n", "true_n", "overlap_n", "false_pred_n", "pred_on_true"]
    return out(M.evaluate(pairs(d)).select(*cols), "pred_on_true")


@query("m11_support_iou", f"""
WITH {PAIRS_SQL}
SELECT spectrum_id, round(count(*) FILTER (t > 0 AND p > 0) / nullif(count(*) FILTER (p > 0), 0), 6) AS precision,
       round(count(*) FILTER (t > 0 AND p > 0) / nullif(count(*) FILTER (t > 0), 0), 6) AS recall,
       round(count(*) FILTER (t > 0 AND p > 0) / count(*), 6) AS iou FROM pairs GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.support_scores(pairs(d)), "precision", "recall", "iou")


@query("m12_topk_overlap", f"""
WITH {WIDE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY t DESC, bin) AS rt,
   row_number() OVER (PARTITION BY spectrum_id ORDER BY p DESC, bin) AS rp FROM pairs)
SELECT spectrum_id, count(*) FILTER (rt <= 3 AND rp <= 3 AND t > 0 AND p > 0) AS shared_n,
       round(count(*) FILTER (rt <= 3 AND rp <= 3 AND t > 0 AND p > 0) / 3.0, 6) AS topk_precision
FROM r GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.top_overlap(pairs(d, bin_width=1.0), 3), "topk_precision")


@query("m13_barcode", f"""
WITH {WIDE_SQL}, {SHARES_SQL}
SELECT spectrum_id, round(sum(CASE WHEN pt > 1e-3 THEN p ELSE 0 END) / (sum(p) + 1e-10), 6) AS barcode_precision,
       round(1 - sum(CASE WHEN pt > 1e-3 THEN p ELSE 0 END) / (sum(p) + 1e-10), 6) AS false_positive_rate
FROM shares GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.barcode(pairs(d, bin_width=1.0)), "barcode_precision", "false_positive_rate")


CONC_SQL = f"""{bins_sql('b', 'peaks', '1.0', 1005)},
r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) AS rn,
      intensity / sum(intensity) OVER (PARTITION BY spectrum_id) AS q FROM b)"""


@query("m14_topk_fraction", f"""
WITH {CONC_SQL} SELECT spectrum_id, round(sum(CASE WHEN rn <= 5 THEN q ELSE 0 END), 6) AS topk_fraction
FROM r GROUP BY 1""", "peaks")
def _(d):
    return out(M.concentration(true_bins(d, bin_width=1.0)).select("spectrum_id", "topk_fraction"), "topk_fraction")


@query("m15_entropy", f"""
WITH {CONC_SQL} SELECT spectrum_id, round(-sum(q * ln(q)), 6) + 0.0 AS entropy,
  CASE WHEN count(*) > 1 THEN round(-sum(q * ln(q)) / ln(count(*)), 6) + 0.0 END AS scaled_entropy FROM r GROUP BY 1""",
       "peaks")
def _(d):
    return out(M.concentration(true_bins(d, bin_width=1.0)).drop("topk_fraction"), "entropy", "scaled_entropy")


@query("m16_integer_mass_recall", """
WITH m AS (SELECT spectrum_id, mz, sum(intensity) AS i FROM peaks GROUP BY ALL),
s AS (SELECT *, floor(mz) AS mass FROM m QUALIFY i / sum(i) OVER (PARTITION BY spectrum_id) >= 0.001),
f AS (SELECT spectrum_id, floor(mz) AS mass FROM pred_peaks UNION SELECT spectrum_id, ceil(mz) FROM pred_peaks)
SELECT s.spectrum_id, round(count(f.mass) / count(*), 6) AS recall,
       round(sum(CASE WHEN f.mass IS NOT NULL THEN i ELSE 0 END) / sum(i), 6) AS weighted_recall
FROM s LEFT JOIN f ON s.spectrum_id = f.spectrum_id AND s.mass = f.mass GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.integer_mass_recall(d.peaks, d.pred_peaks), "recall", "weighted_recall")


@query("m18_shift_diagnosis", f"""
WITH {bins_sql('b', 'peaks')}, {CAND_BINS_SQL}, {bins_sql('pb', 'pred_peaks')},
sup AS (SELECT DISTINCT spectrum_id, bin FROM pb), moved AS (
SELECT spectrum_id, bin + shift AS bin, shift, intensity FROM b, (VALUES (0), (1), (-1)) v(shift))
SELECT m.spectrum_id, shift, round(count(s.bin) / count(*), 6) AS recall,
       round(sum(CASE WHEN s.bin IS NOT NULL THEN intensity ELSE 0 END) / greatest(sum(intensity), 1e-12), 6) AS coverage
FROM moved m LEFT JOIN sup s ON m.spectrum_id = s.spectrum_id AND m.bin = s.bin GROUP BY 1, 2""",
       "peaks cand_peaks pred_peaks")
def _(d):
    return out(M.shift_diagnosis(true_bins(d), pred_bins(d), 1), "recall", "coverage")


@query("m21_ndcg", f"""
WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY CASE WHEN p <= 0 THEN 1 ELSE 0 END,
   p DESC, CASE WHEN p <= 0 THEN t ELSE 0 END, bin) AS g,
   row_number() OVER (PARTITION BY spectrum_id ORDER BY t DESC, bin) AS i FROM pairs)
SELECT spectrum_id, round(CASE WHEN sum(t / log2(i + 1.0)) > 1e-12 THEN sum(t / log2(g + 1.0)) / sum(t / log2(i + 1.0))
       ELSE 0 END, 6) AS ndcg FROM r GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.ndcg(pairs(d)), "ndcg")


@query("m22_optimistic_cosine", f"""
WITH {PAIRS_SQL}, o AS (SELECT spectrum_id, t, CASE WHEN p > 0 THEN t ELSE 0 END AS p FROM pairs)
SELECT spectrum_id, round({COS_SQL}, 6) AS optimistic_cosine FROM o GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.optimistic_cosine(pairs(d)), "optimistic_cosine")


@query("m23_out_of_support", f"""
WITH {PAIRS_SQL} SELECT spectrum_id, CASE WHEN sum(t) > 1e-12 THEN
  round(least(greatest(1 - sum(CASE WHEN p > 0 THEN t ELSE 0 END) / sum(t), 0), 1), 6) END AS oos_ratio
FROM pairs GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(M.out_of_support(pairs(d)), "oos_ratio")


@query("m24_argmax_agreement", f"""
WITH {PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY t DESC, bin) AS rt,
   row_number() OVER (PARTITION BY spectrum_id ORDER BY p DESC, bin) AS rp FROM pairs)
SELECT spectrum_id, CAST(max(CASE WHEN rt = 1 THEN bin END) = max(CASE WHEN rp = 1 THEN bin END) AS int) AS same_top
FROM r GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return M.argmax_agreement(pairs(d))


@query("m25_correlations", """
WITH r AS (SELECT source_flag, intensity, mz,
  rank() OVER (PARTITION BY source_flag ORDER BY intensity) + (count(*) OVER (PARTITION BY source_flag, intensity) - 1) / 2.0 AS ri,
  rank() OVER (PARTITION BY source_flag ORDER BY mz) + (count(*) OVER (PARTITION BY source_flag, mz) - 1) / 2.0 AS rm
  FROM cand_peaks)
SELECT source_flag, round(corr(intensity, mz), 6) AS pearson, round(corr(ri, rm), 6) AS spearman FROM r GROUP BY 1""",
       "cand_peaks")
def _(d):
    p = M.pearson(d.cand_peaks, ["source_flag"], "intensity", "mz")
    s = M.spearman(d.cand_peaks, ["source_flag"], "intensity", "mz")
    return out(p.join(s, "source_flag"), "pearson", "spearman")


@query("m26_ensemble_log", """
WITH t AS (SELECT spectrum_id, max(ln(intensity)) AS top FROM peaks GROUP BY 1),
s AS (SELECT p.spectrum_id, max(top) AS top, count(*) AS n, sum(exp(ln(intensity) - top)) / count(*) AS m,
      sum(exp(ln(intensity) - top) * exp(ln(intensity) - top)) / count(*) AS q
      FROM peaks p JOIN t ON p.spectrum_id = t.spectrum_id GROUP BY 1)
SELECT spectrum_id, n, round(top + ln(m), 6) AS log_mean, CASE WHEN n > 1 AND q - m * m > 1e-12
  THEN round(top + 0.5 * (ln(q - m * m) + ln(n) - ln(n - 1.0)), 6) END AS log_std FROM s""", "peaks")
def _(d):
    rows = d.peaks.withColumn("v", F.log("intensity"))
    return out(M.ensemble_log(rows, ["spectrum_id"], "v"), "log_mean", "log_std")


@query("m27_vector_cosine", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, pos, avg(x) AS y FROM e GROUP BY ALL)
SELECT vec_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-12), 6) AS cosine
FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY vec_id""")
def _(d):
    vectors = d.table("embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("y"))
    centre = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "y"))).alias("c"))
    centre = centre.select("label", F.transform("c", lambda s: s["y"]).alias("centre"))
    return vectors.join(centre, "label").select(
        "vec_id", r6(M.vector_cosine(F.col("embedding"), F.col("centre"))).alias("cosine"))


@query("m28_dice", f"""
WITH {WIDE_SQL} SELECT spectrum_id, round(2.0 * sum(least(t, p)) / sum(t + p), 6) AS dice FROM pairs GROUP BY 1""",
       "peaks pred_peaks")
def _(d):
    return out(M.dice(pairs(d, bin_width=1.0)), "dice")
