"""Queries for the spectrum transforms."""

from pyspark.sql import functions as F

from peakwise.functions import spectrum as S
from peakwise.operators import transforms as T
from peakwise.plans.registry import query
from peakwise.skew import r6, with_group_stats


def out(df, *cols):
    """Round the named double columns of ``df``."""
    return df.withColumns({c: r6(c) for c in cols})


# Candidate probabilities used wherever a query needs a distribution over candidates.
def candidate_probs(d):
    rows = with_group_stats(d.candidates, ["spectrum_id"], __t=F.sum("score"))
    return rows.select("spectrum_id", "cand_id", (F.col("score") / F.col("__t")).alias("prob"))


PROBS_SQL = """probs AS (
SELECT spectrum_id, cand_id, score / sum(score) OVER (PARTITION BY spectrum_id) AS prob FROM candidates)"""

BINNED_SQL = """binned AS (
SELECT spectrum_id, CAST(floor(mz / 0.01 + 1e-8) AS bigint) AS bin, sum(intensity) AS intensity
FROM peaks WHERE intensity > 0 AND floor(mz / 0.01 + 1e-8) BETWEEN 0 AND 100500 GROUP BY ALL)"""

CAND_BINS_SQL = """cand_bins AS (
SELECT spectrum_id, cand_id, CAST(floor(mz / 0.01 + 1e-8) AS bigint) AS bin, sum(intensity) AS intensity
FROM cand_peaks WHERE intensity > 0 AND mz < 1005 GROUP BY ALL)"""


@query("p01_bin_floor", f"WITH {BINNED_SQL} SELECT spectrum_id, bin, round(intensity, 6) AS intensity FROM binned",
       "peaks")
def _(d):
    return out(T.bin_spectra(d.peaks), "intensity")


@query("p01_bin_round", """
SELECT spectrum_id, CAST(round_even(mz / 0.5, 0) AS bigint) AS bin, round(sum(intensity), 6) AS intensity
FROM peaks WHERE intensity > 0 AND round_even(mz / 0.5, 0) BETWEEN 0 AND 2010 GROUP BY ALL""", "peaks")
def _(d):
    return out(T.bin_spectra(d.peaks, bin_width=0.5, mode="round"), "intensity")


@query("p02_bin_centred_l1", """
WITH b AS (SELECT spectrum_id, CAST(floor((mz - 1.0 + 0.5) / 1.0) AS bigint) AS bin, sum(intensity) AS i
           FROM peaks WHERE floor((mz - 1.0 + 0.5) / 1.0) BETWEEN 0 AND 1023 GROUP BY ALL)
SELECT spectrum_id, bin, round(i / greatest(sum(i) OVER (PARTITION BY spectrum_id), 1e-6), 6) AS intensity FROM b""",
       "peaks")
def _(d):
    return out(T.bin_spectra_centred(d.peaks, 1.0, 1.0, 1024), "intensity")


@query("p03_bin_edges_max_without_precursor", """
SELECT p.spectrum_id, round((floor(mz / 0.5) + 1) * 0.5 - 0.25, 6) AS mz,
       round(max(CASE WHEN floor(mz / 0.5) = floor(precursor_mz / 0.5) THEN 0 ELSE intensity END), 6) AS intensity
FROM peaks p LEFT JOIN spectra s ON p.spectrum_id = s.spectrum_id GROUP BY p.spectrum_id, floor(mz / 0.5)""",
       "peaks spectra")
def _(d):
    return out(T.bin_spectra_edges(d.peaks, 0.5, "max", d.spectra, as_mz=True), "mz", "intensity")


@query("p03_bin_edges_logsumexp", """
WITH r AS (SELECT spectrum_id, CAST(floor(mz / 5.0) AS bigint) AS bin, ln(intensity) AS v FROM peaks),
     m AS (SELECT spectrum_id, bin, max(v) AS top FROM r GROUP BY ALL)
SELECT r.spectrum_id, r.bin, round(max(top) + ln(sum(exp(v - top)) + 1e-9), 6) AS intensity
FROM r JOIN m ON r.spectrum_id = m.spectrum_id AND r.bin = m.bin GROUP BY r.spectrum_id, r.bin""", "peaks")
def _(d):
    logs = d.peaks.withColumn("intensity", F.log("intensity"))
    return out(T.bin_spectra_edges(logs, 5.0, "lse"), "intensity")


@query("p04_histogram_edges", """
SELECT spectrum_id, CASE WHEN mz >= 0 AND mz < 200 THEN 0 WHEN mz >= 200 AND mz < 400 THEN 1
       WHEN mz >= 400 AND mz < 700 THEN 2 WHEN mz >= 700 AND mz <= 1000 THEN 3 END AS bucket,
       round(sum(intensity), 6) AS weight
FROM peaks WHERE mz >= 0 AND mz <= 1000 GROUP BY ALL""", "peaks")
def _(d):
    return out(T.histogram(d.peaks, [0, 200, 400, 700, 1000]), "weight")


@query("p05_merge_integer_mass", """
SELECT spectrum_id, CAST(round_even(mz, 0) AS bigint) AS mass, round(sum(intensity), 6) AS intensity
FROM peaks GROUP BY ALL""", "peaks")
def _(d):
    return out(T.merge_integer_mass(d.peaks), "intensity")


@query("p06_merge_rounded_mz", """
SELECT spectrum_id, round(round_even(mz * 100.0, 0) / 100.0, 6) AS mz, round(max(intensity), 6) AS intensity
FROM peaks GROUP BY ALL""", "peaks")
def _(d):
    return out(T.merge_rounded_mz(d.peaks, 2, "max"), "mz", "intensity")


@query("p07_merge_molecule_spectra", """
WITH m AS (SELECT mol_id, mz, sum(intensity) AS i FROM peaks p JOIN spectra s ON p.spectrum_id = s.spectrum_id
           GROUP BY mol_id, mz)
SELECT mol_id, round(mz, 6) AS mz, round(i / sum(i) OVER (PARTITION BY mol_id), 9) AS intensity FROM m""",
       "peaks spectra")
def _(d):
    merged = T.merge_group_spectra(d.peaks, d.spectra, "mol_id", renormalise=True)
    return merged.select("mol_id", r6("mz").alias("mz"), r6("intensity", 9).alias("intensity"))


@query("p07_merged_metadata", """
SELECT mol_id, count(*) AS n_spectra, arg_min(adduct_raw, spectrum_id) AS adduct_raw,
       round(arg_min(precursor_mz, spectrum_id), 6) AS precursor_mz,
       array_to_string(list_sort(list_distinct(list(ce_raw))), '|') AS ce_raw
FROM spectra GROUP BY mol_id""", "spectra")
def _(d):
    meta = T.merge_group_meta(d.spectra, "mol_id", ["adduct_raw", "precursor_mz"], ["ce_raw"])
    return out(meta, "precursor_mz").withColumn("ce_raw", F.array_join("ce_raw", "|"))


@query("p08_drop_precursor_bin", """
SELECT p.spectrum_id, round(mz, 6) AS mz, intensity FROM peaks p LEFT JOIN spectra s ON p.spectrum_id = s.spectrum_id
WHERE NOT coalesce(floor(mz / 1.0 + 1e-8) = floor(precursor_mz / 1.0 + 1e-8) AND precursor_mz > 0, false)""",
       "peaks spectra")
def _(d):
    return out(T.drop_precursor_bin(d.peaks, d.spectra, 1.0), "mz")


@query("p09_drop_precursor_isotopes", """
SELECT p.spectrum_id, round(mz, 6) AS mz, intensity FROM peaks p LEFT JOIN spectra s ON p.spectrum_id = s.spectrum_id
WHERE NOT coalesce((abs(mz - precursor_mz) <= 2.5 OR abs(mz - (precursor_mz + 1.0033548378)) <= 2.5
   OR abs(mz - (precursor_mz + 2 * 1.0033548378)) <= 2.5) AND precursor_mz > 0, false)""", "peaks spectra")
def _(d):
    return out(T.drop_precursor_window(d.peaks, d.spectra, 2.5, 2, S.ISOTOPE_STEP), "mz")


@query("p10_normalise_kinds", """
WITH t AS (SELECT spectrum_id, sum(intensity) AS s1, sqrt(sum(intensity * intensity)) AS s2, max(intensity) AS hi,
                  min(intensity) AS lo FROM peaks GROUP BY 1)
SELECT p.spectrum_id, round(mz, 6) AS mz, round(intensity / s1, 6) AS l1, round(intensity / s2, 6) AS l2,
       round(intensity * 1000 / hi, 6) AS max1000, round(intensity * 100 / hi, 6) AS max100,
       CASE WHEN hi - lo > 1e-12 THEN round((intensity - lo) / (hi - lo), 6) ELSE 0 END AS minmax
FROM peaks p JOIN t ON p.spectrum_id = t.spectrum_id""", "peaks")
def _(d):
    kinds = ["l1", "l2", "max1000", "max100", "minmax"]
    rows = T.normalise_many(d.peaks, {k: k for k in kinds})
    return out(rows.drop("intensity"), "mz", *kinds)


@query("p11_intensity_transforms", """
SELECT spectrum_id, round(mz, 6) AS mz, round(log10(intensity + 1), 6) AS log10_i,
       round(log10(intensity / 3 + 1), 6) AS log10t3_i, round(ln(intensity + 1), 6) AS loge_i,
       round(sqrt(intensity), 6) AS sqrt_i FROM peaks""", "peaks")
def _(d):
    return d.peaks.select("spectrum_id", r6("mz").alias("mz"), *[
        r6(S.transform_intensity(F.col("intensity"), k)).alias(f"{k}_i")
        for k in ("log10", "log10t3", "loge", "sqrt")])


@query("p11_intensity_inverse", """
WITH t AS (SELECT spectrum_id, max(ln(intensity + 1)) AS top FROM peaks GROUP BY 1)
SELECT p.spectrum_id, round(mz, 6) AS mz,
       round(greatest(exp(ln(intensity + 1) / (top + 1e-9) * ln(1001.0)) - 1, 0), 6) AS intensity
FROM peaks p JOIN t ON p.spectrum_id = t.spectrum_id""", "peaks")
def _(d):
    return out(T.restore_intensities(T.transform_intensities(d.peaks, "loge"), "loge"), "mz", "intensity")


@query("p12_top_peaks", f"""
WITH {BINNED_SQL}
SELECT spectrum_id, bin, round(intensity, 6) AS intensity,
       row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) AS rank
FROM binned QUALIFY rank <= 3""", "peaks")
def _(d):
    return out(T.top_peaks(T.bin_spectra(d.peaks), 3), "intensity")


@query("p13_precursor_target", f"""
WITH {BINNED_SQL}, j AS (
SELECT s.spectrum_id, CAST(floor(precursor_mz / 0.01 + 1e-8) AS bigint) AS precursor_bin, bin, intensity
FROM spectra s LEFT JOIN binned b ON s.spectrum_id = b.spectrum_id WHERE precursor_mz > 0)
SELECT spectrum_id, precursor_bin,
       round(coalesce(sum(CASE WHEN bin = precursor_bin THEN intensity END), 0), 6) AS precursor_intensity,
       coalesce(max(CASE WHEN bin = precursor_bin THEN 1 ELSE 0 END), 0) AS present,
       round(CASE WHEN coalesce(sum(intensity), 0) > 1e-12
                  THEN coalesce(sum(CASE WHEN bin = precursor_bin THEN intensity END), 0) / sum(intensity)
                  ELSE 0 END, 6) AS share
FROM j GROUP BY spectrum_id, precursor_bin""", "peaks spectra")
def _(d):
    return out(T.precursor_target(d.peaks, d.spectra), "precursor_intensity", "share")


@query("p14_candidate_bins", f"""
WITH {CAND_BINS_SQL}
SELECT spectrum_id, cand_id, bin, round(intensity, 6) AS intensity,
       row_number() OVER (PARTITION BY spectrum_id, cand_id ORDER BY intensity DESC, bin) AS rank
FROM cand_bins QUALIFY rank <= 32""", "cand_peaks")
def _(d):
    return out(T.bin_candidates(d.cand_peaks, 32), "intensity")


@query("p14_candidate_bins_l1", f"""
WITH {CAND_BINS_SQL}
SELECT spectrum_id, cand_id, bin,
       round(intensity / sum(intensity) OVER (PARTITION BY spectrum_id, cand_id), 6) AS intensity,
       row_number() OVER (PARTITION BY spectrum_id, cand_id ORDER BY bin) AS rank
FROM cand_bins QUALIFY rank <= 32""", "cand_peaks")
def _(d):
    return out(T.bin_candidates(d.cand_peaks, 32, l1=True), "intensity")


@query("p15_project_candidates_shifted", f"""
WITH {PROBS_SQL}, {CAND_BINS_SQL}, moves(o, w) AS (VALUES (-1, 0.25), (0, 0.5), (1, 0.25))
SELECT b.spectrum_id, bin + o AS bin, round(sum(prob * intensity * w), 6) AS intensity
FROM cand_bins b JOIN probs p ON b.spectrum_id = p.spectrum_id AND b.cand_id = p.cand_id, moves
WHERE bin + o BETWEEN 0 AND 100500 GROUP BY b.spectrum_id, bin + o""", "candidates")
def _(d):
    bins = T.bin_candidates(d.cand_peaks, None)
    return out(T.project_candidates(bins, candidate_probs(d), {-1: 0.25, 0: 0.5, 1: 0.25}), "intensity")


@query("p16_project_exact", f"""
WITH {PROBS_SQL}, kept AS (
SELECT * FROM probs QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY prob DESC, cand_id) <= 3)
SELECT c.spectrum_id, c.cand_id, round(mz, 6) AS mz, round(intensity * prob, 6) AS intensity
FROM cand_peaks c JOIN kept k ON c.spectrum_id = k.spectrum_id AND c.cand_id = k.cand_id
WHERE prob > 0.1 AND intensity * prob > 0""", "candidates")
def _(d):
    return out(T.project_exact(d.cand_peaks, candidate_probs(d), 3, 0.1), "mz", "intensity")


@query("p17_sparsify_probs", f"""
WITH {PROBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY prob DESC, cand_id) AS rn
                        FROM probs),
k AS (SELECT *, CASE WHEN rn <= 3 AND prob >= 0.4 THEN prob ELSE 0 END AS kept FROM r),
t AS (SELECT *, sum(kept) OVER (PARTITION BY spectrum_id) AS s, sum(prob) OVER (PARTITION BY spectrum_id) AS a FROM k)
SELECT spectrum_id, cand_id, round(CASE WHEN s > 1e-8 THEN kept / s ELSE prob / greatest(a, 1e-8) END, 6) AS prob
FROM t""", "candidates")
def _(d):
    return out(T.sparsify_probs(candidate_probs(d), 3, 0.4), "prob")


@query("p18_bin_to_mz", f"WITH {BINNED_SQL} SELECT spectrum_id, bin, round((bin + 0.5) * 0.01, 6) AS mz FROM binned",
       "peaks")
def _(d):
    binned = T.bin_spectra(d.peaks)
    return binned.select("spectrum_id", "bin", r6(S.bin_to_mz(F.col("bin"))).alias("mz"))


@query("p19_union_support", f"""
WITH {CAND_BINS_SQL} SELECT spectrum_id, bin, round(max(intensity), 6) AS intensity FROM cand_bins
GROUP BY spectrum_id, bin""", "cand_peaks")
def _(d):
    return out(T.union_support(T.bin_candidates(d.cand_peaks, None)), "intensity")


@query("p20_dedup_peaks", """
WITH r AS (SELECT spectrum_id, CAST(floor(mz / 50.0) AS bigint) AS zone, intensity, prior, ln(intensity) AS v
           FROM cand_peaks),
     m AS (SELECT spectrum_id, zone, max(v) AS top FROM r GROUP BY ALL)
SELECT r.spectrum_id, r.zone, round(max(top) + ln(sum(exp(v - top)) + 1e-9), 6) AS lse, round(sum(intensity), 6) AS total,
       round(min(prior), 6) AS low, round(avg(prior), 6) AS mean, round(max(prior), 6) AS high
FROM r JOIN m ON r.spectrum_id = m.spectrum_id AND r.zone = m.zone GROUP BY r.spectrum_id, r.zone""", "cand_peaks")
def _(d):
    rows = d.cand_peaks.select("spectrum_id", F.floor(F.col("mz") / 50.0).alias("zone"), "intensity", "prior",
                               F.log("intensity").alias("v"))
    res = T.dedup(rows, ["spectrum_id", "zone"], {
        "lse": ("lse", "v"), "total": ("sum", "intensity"), "low": ("min", "prior"),
        "mean": ("mean", "prior"), "high": ("max", "prior")})
    return out(res, "lse", "total", "low", "mean", "high")


def _precursor_bins(d):
    return d.spectra.select("spectrum_id", F.floor(F.col("precursor_mz") + F.lit(1e-8)).alias("precursor_bin"))


UNIT_SQL = """b AS (
SELECT p.spectrum_id, CAST(floor(mz / 1.0 + 1e-8) AS bigint) AS bin, sum(intensity) AS intensity,
       CAST(floor(max(precursor_mz) + 1e-8) AS bigint) AS pb
FROM peaks p JOIN spectra s ON p.spectrum_id = s.spectrum_id
WHERE floor(mz / 1.0 + 1e-8) BETWEEN 0 AND 1005 GROUP BY ALL)"""


@query("p21_mask_above_precursor", f"""
WITH {UNIT_SQL} SELECT spectrum_id, bin, round(intensity, 6) AS intensity FROM b WHERE bin <= pb + 2""", "peaks spectra")
def _(d):
    return out(T.mask_above_precursor(T.bin_spectra(d.peaks, bin_width=1.0), _precursor_bins(d), 2), "intensity")


@query("p21_reverse_axis", f"""
WITH {UNIT_SQL}
SELECT spectrum_id, ((least(1006, pb + 3) - 1 - bin) % 1006 + 1006) % 1006 AS bin, round(intensity, 6) AS intensity
FROM b""", "peaks spectra")
def _(d):
    return out(T.reverse_around_precursor(T.bin_spectra(d.peaks, bin_width=1.0), _precursor_bins(d), 2, 1006),
               "intensity")


@query("p22_peak_arrays", """
WITH m AS (SELECT spectrum_id, round_even(mz, 0) AS mz, sum(intensity) AS i FROM peaks GROUP BY ALL)
SELECT spectrum_id, array_to_string(list(CAST(mz AS bigint) ORDER BY mz), ',') AS mzs,
       array_to_string(list(CAST(round(i) AS bigint) ORDER BY mz), ',') AS intensities
FROM m GROUP BY spectrum_id""", "peaks")
def _(d):
    arr = T.peak_arrays(T.merge_integer_mass(d.peaks), "mass")
    text = lambda x: F.round(x).cast("long").cast("string")
    return arr.select("spectrum_id", F.array_join(F.transform("mzs", text), ",").alias("mzs"),
                      F.array_join(F.transform("intensities", text), ",").alias("intensities"))


@query("p22_vector_to_peaks", """
WITH m AS (SELECT spectrum_id, CAST(round_even(mz, 0) AS bigint) AS bin, sum(intensity) AS i FROM peaks GROUP BY ALL),
s AS (SELECT *, i / sum(i) OVER (PARTITION BY spectrum_id) AS p FROM m),
k AS (SELECT * FROM s WHERE p >= 0.1)
SELECT spectrum_id, CAST(bin + 1 AS double) AS mz, round(p / sum(p) OVER (PARTITION BY spectrum_id), 9) AS intensity
FROM k""", "peaks")
def _(d):
    vec = T.merge_integer_mass(d.peaks).withColumnRenamed("mass", "bin")
    return T.vector_to_peaks(vec, 0.1).withColumn("intensity", r6("intensity", 9))
