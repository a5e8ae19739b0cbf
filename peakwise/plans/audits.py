"""Queries for audits, reports, candidate probes and target distributions."""

from pyspark.sql import functions as F

from peakwise.functions import normalize as N
from peakwise.operators import audit as A
from peakwise.operators import sampling as S
from peakwise.operators import selection as K
from peakwise.operators import targets as G
from peakwise.operators import transforms as T
from peakwise.plans.policies import F_VIEWS, POLICY_SQL, U48, U64, group_of, policy_rows, split_sql
from peakwise.plans.quality import bins_sql, pairs_sql, pred_bins, true_bins
from peakwise.plans.registry import query
from peakwise.plans.spectra import CAND_BINS_SQL, candidate_probs, out, PROBS_SQL
from peakwise.session import parts_for
from peakwise.skew import r6

CB = CAND_BINS_SQL
TB = bins_sql("tb", "pred_peaks")
PROBE_VIEWS = "pred_peaks candidates"


def cand_bins(d):
    return T.bin_candidates(d.cand_peaks, None)


@query("a01_value_counts", """
SELECT coalesce(instrument_raw, '__MISSING__') AS value, count(*) AS n FROM spectra GROUP BY 1 ORDER BY n DESC, value LIMIT 4""", "spectra")
def _(d):
    return A.value_counts(d.spectra, "instrument_raw", top=4)


_FACETS = {"mh": "adduct = '[M+H]+'", "orbitrap": "instrument = 'Orbitrap'", "hcd": "frag_method = 'HCD'",
           "mz_ok": "precursor_mz <= 900", "ce_ok": "ce_nce IS NOT NULL"}
_FACET_COLS = ", ".join(f"CAST(coalesce({v}, false) AS int) AS {k}" for k, v in _FACETS.items())


def facets():
    c = F.col
    return {"mh": c("adduct") == "[M+H]+", "orbitrap": c("instrument") == "Orbitrap", "hcd": c("frag_method") == "HCD",
            "mz_ok": c("precursor_mz") <= 900, "ce_ok": c("ce_nce").isNotNull()}


@query("a02_combination_counts", f"WITH {POLICY_SQL}, f AS (SELECT {_FACET_COLS} FROM prows) SELECT *, count(*) AS n FROM f GROUP BY ALL", F_VIEWS)
def _(d):
    return A.facet_counts(policy_rows(d), facets())


@query("a02_combination_cube", f"""WITH {POLICY_SQL}, f AS (SELECT {_FACET_COLS} FROM prows)
SELECT mh, orbitrap, hcd, mz_ok, ce_ok, count(*) AS n FROM f GROUP BY CUBE (mh, orbitrap, hcd, mz_ok, ce_ok)""", F_VIEWS)
def _(d):
    return A.facet_counts(policy_rows(d), facets(), partial=True)


def _summary_sql(col, table):
    return f"""SELECT '{col}' AS "column", count({col}) AS n, round(avg({col}), 6) AS mean, round(quantile_cont({col}, 0.5), 6) AS p50,
  round(quantile_cont({col}, 0.9), 6) AS p90, round(quantile_cont({col}, 0.99), 6) AS p99 FROM {table}"""


@query("a03_numeric_summary", f"WITH {POLICY_SQL} " + " UNION ALL ".join(
    _summary_sql(c, "prows") for c in ("precursor_mz", "ce_nce", "total_intensity")), F_VIEWS)
def _(d):
    return out(A.numeric_summary(policy_rows(d), ["precursor_mz", "ce_nce", "total_intensity"]), "mean", "p50", "p90", "p99")


_MISS = ("instrument", "frag_method", "ce_nce", "mol_inchikey")


@query("a04_missing_ratios", f"WITH {POLICY_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS missing FROM prows" for c in _MISS), F_VIEWS)
def _(d):
    return A.missing_ratios(policy_rows(d), _MISS).withColumn("missing", r6("missing", 9))


@query("a05_split_summary", f"""WITH {POLICY_SQL}
SELECT coalesce(split, 'total') AS split, count(*) AS rows, count(DISTINCT inchikey) AS groups,
  count(*) FILTER (ce_nce IS NOT NULL AND charge = 0) AS kept, round(count(*) FILTER (ce_nce IS NOT NULL AND charge = 0) / count(*), 9) AS keep_ratio
FROM prows GROUP BY ROLLUP (split)""", F_VIEWS)
def _(d):
    kept = F.col("ce_nce").isNotNull() & (F.col("charge") == 0)
    return A.split_summary(policy_rows(d), "split", "inchikey", kept).withColumn("keep_ratio", r6("keep_ratio", 9))


LEAK_SQL = f"""WITH a AS (SELECT DISTINCT inchikey, {split_sql(U64)} AS s FROM spectra UNION SELECT DISTINCT inchikey, {split_sql(U48)} FROM spectra),
p AS (SELECT x.s AS left_split, y.s AS right_split, x.inchikey FROM a x JOIN a y ON x.inchikey = y.inchikey AND x.s < y.s)
SELECT left_split, right_split, count(*) AS n, array_to_string(list_slice(list_sort(list(inchikey)), 1, 20), ',') AS examples FROM p GROUP BY 1, 2"""


@query("a06_split_leakage", LEAK_SQL, "spectra")
def _(d):
    """Molecules that the two split hashes put into different splits."""
    rows = group_of(d.spectra)
    one = rows.select("inchikey", S.split_name(S.uniform_hash(F.col("group_key"), 42)).alias("split"))
    two = rows.select("inchikey", S.split_name(S.uniform_hash_mod(F.col("group_key"), 42)).alias("split"))
    return A.leakage(one.unionByName(two), "split", "inchikey").withColumn("examples", F.array_join("examples", ","))


def _first_peaks(d, peaks):
    first = peaks.groupBy("spectrum_id").agg(F.min(F.struct("mz", "intensity")).alias("f")).select(
        "spectrum_id", F.col("f.mz").alias("first_mz"), F.col("f.intensity").alias("first_intensity"))
    return first.join(d.spectra.select("spectrum_id", F.col("inchikey").alias("smiles")), "spectrum_id")


@query("a07_alignment_audit", """
WITH a AS (SELECT spectrum_id, min(mz) AS mz, arg_min(intensity, (mz, intensity)) AS i FROM peaks GROUP BY 1),
b AS (SELECT spectrum_id, min(mz) AS mz, arg_min(intensity, (mz, intensity)) AS i FROM pred_peaks GROUP BY 1),
l AS (SELECT a.*, inchikey AS s FROM a JOIN spectra USING (spectrum_id)),
r AS (SELECT b.*, CASE WHEN spectrum_id % 11 = 0 THEN 'x' ELSE inchikey END AS s FROM b JOIN spectra USING (spectrum_id))
SELECT CASE WHEN r.spectrum_id IS NULL THEN 'missing right' WHEN l.spectrum_id IS NULL THEN 'missing left' WHEN l.s <> r.s THEN 'smiles'
  WHEN abs(l.mz - r.mz) > 1e-4 OR abs(l.i - r.i) > 1e-6 THEN 'first_peak' ELSE 'ok' END AS reason, count(*) AS n
FROM l FULL JOIN r ON l.spectrum_id = r.spectrum_id GROUP BY 1""", "peaks pred_peaks spectra")
def _(d):
    right = _first_peaks(d, d.pred_peaks).withColumn("smiles", F.when(F.col("spectrum_id") % 11 == 0, "x").otherwise(F.col("smiles")))
    return A.alignment_audit(_first_peaks(d, d.peaks), right, "spectrum_id", "smiles")


def _res_sql(scope, peaks, where):
    return f"""SELECT '{scope}' AS scope, '{peaks}' AS peaks, count(*) AS n, round(quantile_cont(frac, 0.5), 6) AS frac_p50,
  round(quantile_cont(frac, 0.9), 6) AS frac_p90, round(quantile_cont(frac, 0.99), 6) AS frac_p99,
  round(avg(CASE WHEN frac < 1e-6 THEN 1.0 ELSE 0 END), 9) AS integer_1e6, round(avg(CASE WHEN frac < 1e-4 THEN 1.0 ELSE 0 END), 9) AS integer_1e4,
  round(avg(CASE WHEN frac < 1e-3 THEN 1.0 ELSE 0 END), 9) AS integer_1e3, round(avg(CASE WHEN frac < 1e-2 THEN 1.0 ELSE 0 END), 9) AS integer_1e2,
  count(*) FILTER (frac >= 1e-4) AS non_integer_n FROM r WHERE {where}"""


@query("a08_resolution_report", """
WITH r AS (SELECT abs(mz - round_even(mz, 0)) AS frac, instrument_raw = 'Thermo Orbitrap' AND adduct_raw = 'M+H' AS sub,
  row_number() OVER (PARTITION BY p.spectrum_id ORDER BY intensity DESC, mz) AS rn FROM peaks p JOIN spectra s ON p.spectrum_id = s.spectrum_id) """
       + " UNION ALL ".join([_res_sql("overall", "all", "true"), _res_sql("overall", "top", "rn <= 3"),
                             _res_sql("subset", "all", "sub"), _res_sql("subset", "top", "sub AND rn <= 3")]), "peaks spectra")
def _(d):
    rows = d.peaks.join(d.spectra.select("spectrum_id", "instrument_raw", "adduct_raw"), "spectrum_id")
    sub = (F.col("instrument_raw") == "Thermo Orbitrap") & (F.col("adduct_raw") == "M+H")
    rep = out(A.resolution_report(rows, sub, 3), "frac_p50", "frac_p90", "frac_p99")
    return rep.withColumns({c: r6(c, 9) for c in ("integer_1e6", "integer_1e4", "integer_1e3", "integer_1e2")})


@query("a10_low_coverage", f"""WITH {bins_sql('tb', 'peaks')}, {bins_sql('pb', 'pred_peaks')},
r AS (SELECT t.*, p.bin IS NULL AS missed, precursor_mz, row_number() OVER (PARTITION BY t.spectrum_id ORDER BY t.intensity DESC, t.bin) AS rn
  FROM tb t LEFT JOIN pb p ON p.spectrum_id = t.spectrum_id AND p.bin = t.bin JOIN spectra s ON s.spectrum_id = t.spectrum_id)
SELECT spectrum_id, round(sum(CASE WHEN missed THEN 0 ELSE intensity END) / sum(intensity), 6) AS coverage,
  round(sum(CASE WHEN missed THEN intensity ELSE 0 END) / sum(intensity), 6) AS missing_ratio,
  round(sum(CASE WHEN missed AND (abs(bin * 0.01 - precursor_mz) <= 5 OR abs(bin * 0.01 - (precursor_mz + 1)) <= 5 OR abs(bin * 0.01 - (precursor_mz + 2)) <= 5)
    THEN intensity ELSE 0 END) / sum(intensity), 6) AS missing_precursor_like, count(*) AS true_n,
  string_agg(concat(format('{{:.4f}}', bin * 0.01), CASE WHEN missed THEN ':MISS' ELSE ':hit' END), ';' ORDER BY rn) FILTER (rn <= 5) AS top_peaks
FROM r GROUP BY 1""", "peaks pred_peaks spectra")
def _(d):
    rows = A.low_coverage(true_bins(d), pred_bins(d), d.spectra, tol_da=5.0)
    return out(rows, "coverage", "missing_ratio", "missing_precursor_like")


PROBE_SQL = f"""{CB}, {TB}, ct AS (SELECT spectrum_id, cand_id, count(*) AS cn, sum(intensity) AS cs, sqrt(sum(intensity * intensity)) AS nrm FROM cand_bins GROUP BY 1, 2),
tt AS (SELECT spectrum_id, count(*) AS tn, sum(intensity) AS ts, sqrt(sum(intensity * intensity)) AS tnrm FROM tb GROUP BY 1),
tr AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) AS tr FROM tb),
js AS (SELECT ct.spectrum_id, ct.cand_id, bin, CAST(0 AS double) AS a, CAST(intensity / ts AS double) AS b FROM ct JOIN tr ON tr.spectrum_id = ct.spectrum_id JOIN tt ON tt.spectrum_id = ct.spectrum_id
  UNION ALL SELECT c.spectrum_id, c.cand_id, bin, CAST(intensity / cs AS double), CAST(0 AS double) FROM cand_bins c JOIN ct ON ct.spectrum_id = c.spectrum_id AND ct.cand_id = c.cand_id),
jb AS (SELECT spectrum_id, cand_id, bin, sum(a) AS a, sum(b) AS b FROM js GROUP BY 1, 2, 3),
jd AS (SELECT spectrum_id, cand_id, sum(0.5 * CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END + 0.5 * CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END) AS js FROM jb GROUP BY 1, 2),
sh AS (SELECT c.spectrum_id, c.cand_id, count(*) AS bn, sum(c.intensity * t.intensity) AS dot, sum(t.intensity) AS bt, count(*) FILTER (tr <= 20) AS hits
  FROM cand_bins c JOIN tr t ON t.spectrum_id = c.spectrum_id AND t.bin = c.bin GROUP BY 1, 2),
pr AS (SELECT ct.spectrum_id, ct.cand_id, CASE WHEN tn IS NULL THEN 0 ELSE round(coalesce(dot, 0) / (nrm * tnrm + 1e-12), 9) END AS cosine,
  CASE WHEN tn IS NULL THEN 0 ELSE least(greatest(1 - greatest(js, 0) / ln(2), 0), 1) END AS js, CASE WHEN tn IS NOT NULL THEN coalesce(bt, 0) / ts END AS coverage,
  coalesce(hits, 0) / least(tn, 20) AS top_recall, coalesce(bn, 0) / cn AS precision, coalesce(bn, 0) / tn AS recall,
  coalesce(bn, 0) / (cn + coalesce(tn, 0) - coalesce(bn, 0)) AS iou FROM ct LEFT JOIN tt ON tt.spectrum_id = ct.spectrum_id
  LEFT JOIN sh ON sh.spectrum_id = ct.spectrum_id AND sh.cand_id = ct.cand_id LEFT JOIN jd ON jd.spectrum_id = ct.spectrum_id AND jd.cand_id = ct.cand_id),
pk AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY cosine DESC, cand_id) AS rank FROM pr)"""
PROBE_COLS = ("cosine", "js", "coverage", "top_recall", "precision", "recall", "iou")


def probe(d):
    parts = dealt(d)
    return G.probe_candidates(T.bin_candidates(d.cand_peaks, None, parts=parts), pred_bins(d, parts=parts), parts)


@query("a11_candidate_probe", f"WITH {PROBE_SQL} SELECT spectrum_id, cand_id, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in PROBE_COLS)}, rank FROM pk",
       PROBE_VIEWS)
def _(d):
    return probe(d).withColumns({c: r6(c, 9) for c in PROBE_COLS})


@query("a11_union_at_k", f"""WITH {PROBE_SQL}, fr AS (SELECT c.spectrum_id, bin, min(rank) AS first FROM cand_bins c JOIN pk ON pk.spectrum_id = c.spectrum_id AND pk.cand_id = c.cand_id GROUP BY 1, 2),
j AS (SELECT coalesce(fr.spectrum_id, tr.spectrum_id) AS spectrum_id, coalesce(first <= k, false) AS ins, tr.intensity AS t, tr, k
  FROM fr FULL JOIN tr ON fr.spectrum_id = tr.spectrum_id AND fr.bin = tr.bin, (VALUES (1), (2), (5)) v(k))
SELECT spectrum_id, k, round(coalesce(sum(CASE WHEN ins THEN t END) / sum(t), 0), 6) AS coverage,
  round(count(*) FILTER (ins AND t IS NOT NULL AND tr <= 20) / nullif(count(*) FILTER (t IS NOT NULL AND tr <= 20), 0), 6) AS top_recall,
  round(count(*) FILTER (ins AND t IS NOT NULL) / nullif(count(*) FILTER (ins), 0), 6) AS precision,
  round(count(*) FILTER (ins AND t IS NOT NULL) / nullif(count(*) FILTER (ins OR t IS NOT NULL), 0), 6) AS iou FROM j GROUP BY 1, 2""", PROBE_VIEWS)
def _(d):
    parts = dealt(d)
    rows = G.union_at_k(T.bin_candidates(d.cand_peaks, None, parts=parts), probe(d), pred_bins(d, parts=parts), parts, (1, 2, 5))
    return out(rows, "coverage", "top_recall", "precision", "iou")


@query("a12_source_groups", f"""WITH {CB}, {TB}, tr AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) <= 20 THEN 1 ELSE 0 END AS top FROM tb),
g AS (SELECT spectrum_id, cand_id, 'formula_only' AS source_group FROM candidates WHERE source_flag = 0
  UNION ALL SELECT spectrum_id, cand_id, 'structural_formula' FROM candidates WHERE source_flag IN (1, 3)
  UNION ALL SELECT spectrum_id, cand_id, 'common_loss_formula' FROM candidates WHERE source_flag IN (2, 3)
  UNION ALL SELECT spectrum_id, cand_id, 'any_source_formula' FROM candidates WHERE source_flag > 0),
z AS (SELECT source_group, spectrum_id, count(*) AS n_candidates FROM g GROUP BY 1, 2),
s AS (SELECT DISTINCT source_group, c.spectrum_id, bin FROM g JOIN cand_bins c ON c.spectrum_id = g.spectrum_id AND c.cand_id = g.cand_id),
h AS (SELECT source_group, s.spectrum_id, count(*) AS sn, count(t.bin) AS bth, sum(t.intensity) AS ht, sum(top) AS htop FROM s LEFT JOIN tr t ON t.spectrum_id = s.spectrum_id AND t.bin = s.bin GROUP BY 1, 2),
tt AS (SELECT spectrum_id, count(*) AS tn, sum(intensity) AS ts, sum(top) AS tp FROM tr GROUP BY 1)
SELECT z.source_group, z.spectrum_id, n_candidates, coalesce(sn, 0) AS support_n, round(bth / sn, 6) AS precision, round(coalesce(bth, 0) / tn, 6) AS recall,
  round(coalesce(ht, 0) / ts, 6) AS coverage, round(coalesce(htop, 0) / tp, 6) AS top_recall
FROM z LEFT JOIN h ON h.source_group = z.source_group AND h.spectrum_id = z.spectrum_id LEFT JOIN tt ON tt.spectrum_id = z.spectrum_id""", PROBE_VIEWS)
def _(d):
    return out(G.source_group_probe(cand_bins(d), d.candidates, pred_bins(d)), "precision", "recall", "coverage", "top_recall")


@query("a13_energy_buckets", f"""WITH {POLICY_SQL} SELECT CASE WHEN ce_nce IS NULL THEN 'missing' WHEN ce_nce < 20 THEN 'low' WHEN ce_nce < 45 THEN 'mid' ELSE 'high' END AS bucket,
  count(*) AS n, round(avg(precursor_mz), 6) AS precursor_mz, round(avg(total_intensity), 6) AS total_intensity FROM prows GROUP BY 1""", F_VIEWS)
def _(d):
    return out(A.bucket_means(policy_rows(d), "ce_nce", ["precursor_mz", "total_intensity"]), "precursor_mz", "total_intensity")


def _rank(col, part):
    return f"rank() OVER (PARTITION BY {part} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0"


@query("a14_feature_correlation", f"""WITH z AS (SELECT *, count(*) OVER (PARTITION BY spectrum_id) AS n FROM candidates),
u AS (SELECT spectrum_id, score AS s, 'prior' AS f, prior AS v FROM z WHERE n >= 5 UNION ALL SELECT spectrum_id, score, 'group_id', group_id FROM z WHERE n >= 5
  UNION ALL SELECT spectrum_id, score, 'break_depth', break_depth FROM z WHERE n >= 5),
r AS (SELECT spectrum_id, f, {_rank('v', 'spectrum_id, f')} AS rv, {_rank('s', 'spectrum_id, f')} AS rs FROM u),
c AS (SELECT spectrum_id, f, CASE WHEN stddev_pop(rv) > 1e-12 AND stddev_pop(rs) > 1e-12 THEN round(abs(corr(rv, rs)), 9) END AS a FROM r GROUP BY 1, 2)
SELECT spectrum_id, round(max(a), 9) AS best_abs_rho, arg_max(f, (a, f)) AS best_feature, round(avg(a) + 1e-12, 6) AS mean_abs_rho FROM c WHERE a IS NOT NULL GROUP BY 1""", "candidates")
def _(d):
    return G.feature_correlation(d.candidates, ["prior", "group_id", "break_depth"], "score").withColumns({"best_abs_rho": r6("best_abs_rho", 9), "mean_abs_rho": r6(F.col("mean_abs_rho") + 1e-12)})


OV_SQL = f"""{CB}, {TB}, cs AS (SELECT *, intensity / sum(intensity) OVER (PARTITION BY spectrum_id, cand_id) AS x FROM cand_bins),
ts AS (SELECT *, intensity / sum(intensity) OVER (PARTITION BY spectrum_id) AS t, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) AS tr FROM tb),
nr AS (SELECT spectrum_id, bin + o AS bin, max(t) AS t, max(CASE WHEN tr <= 20 THEN 1 ELSE 0 END) AS top FROM ts, (VALUES (-1), (0), (1)) v(o) GROUP BY 1, 2),
ov AS (SELECT c.spectrum_id, c.cand_id, sum(x * coalesce(e.t, 0)) AS overlap_exact, sum(x * coalesce(n.t, 0)) AS overlap_near,
  sum(CASE WHEN e.t IS NOT NULL THEN x ELSE 0 END) AS support_exact, sum(CASE WHEN n.t IS NOT NULL THEN x ELSE 0 END) AS support_near,
  sum(x * coalesce(n.top, 0)) AS top_near, sum(x) - sum(CASE WHEN e.t IS NOT NULL THEN x ELSE 0 END) AS false_exact,
  sum(x * CASE WHEN e.tr <= 20 THEN 1 ELSE 0 END) AS top_exact FROM cs c LEFT JOIN ts e ON e.spectrum_id = c.spectrum_id AND e.bin = c.bin
  LEFT JOIN nr n ON n.spectrum_id = c.spectrum_id AND n.bin = c.bin GROUP BY 1, 2)"""


@query("a15_oracle_mixture", f"""WITH {OV_SQL}, sc AS (SELECT spectrum_id, cand_id, round(overlap_exact + 0.1 * support_exact - 0.02 * (1 - support_exact), 9) AS score FROM ov),
b AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, cand_id) AS rn FROM sc),
k AS (SELECT b.*, k, greatest(score, 0) AS w0 FROM b JOIN (VALUES (1), (3)) v(k) ON rn <= k),
w AS (SELECT *, CASE WHEN sum(w0) OVER p > 1e-12 THEN w0 / sum(w0) OVER p ELSE 1.0 / count(*) OVER p END AS w FROM k WINDOW p AS (PARTITION BY spectrum_id, k)),
mx AS (SELECT w.spectrum_id, k, bin, sum(w * x) AS p FROM w JOIN cs ON cs.spectrum_id = w.spectrum_id AND cs.cand_id = w.cand_id GROUP BY 1, 2, 3),
tn AS (SELECT spectrum_id, sqrt(sum(t * t)) AS tn FROM ts GROUP BY 1)
SELECT m.spectrum_id, k, round(CASE WHEN sqrt(sum(p * p)) * max(tn) > 1e-12 THEN sum(p * coalesce(t, 0)) / (sqrt(sum(p * p)) * max(tn)) ELSE 0 END, 6) AS oracle_cosine,
  round(sum(coalesce(t, 0)), 6) AS coverage, round(sum(CASE WHEN t IS NULL THEN p ELSE 0 END) / sum(p), 6) AS false_mass
FROM mx m LEFT JOIN ts t ON t.spectrum_id = m.spectrum_id AND t.bin = m.bin LEFT JOIN tn ON tn.spectrum_id = m.spectrum_id GROUP BY 1, 2""", PROBE_VIEWS)
def _(d):
    return out(G.oracle_mixture(cand_bins(d), pred_bins(d), (1, 3)), "oracle_cosine", "coverage", "false_mass")


@query("a16_structure_report", f"""WITH {PROBS_SQL}, {CB}, n AS (SELECT spectrum_id, cand_id, count(*) AS p FROM cand_bins GROUP BY 1, 2)
SELECT c.spectrum_id, count(*) AS valid_n, count(*) FILTER (source_flag > 0) AS active_n, count(*) FILTER (prob > 1e-12) AS teacher_n,
  round(sum(CASE WHEN prob > 0 THEN -prob * ln(prob + 1e-12) ELSE 0 END), 6) + 0.0 AS teacher_entropy, round(avg(CASE WHEN break_depth = 1 THEN 1.0 ELSE 0 END), 6) AS positive_ratio,
  round(avg(coalesce(p, 0)), 6) AS peak_mean, count(DISTINCT group_id) AS group_n, round(1 - count(DISTINCT group_id) / count(*), 6) AS dup_ratio
FROM candidates c JOIN probs p ON p.spectrum_id = c.spectrum_id AND p.cand_id = c.cand_id LEFT JOIN n ON n.spectrum_id = c.spectrum_id AND n.cand_id = c.cand_id GROUP BY 1""",
       "candidates")
def _(d):
    cands = d.candidates.join(candidate_probs(d).withColumnRenamed("prob", "teacher"), ["spectrum_id", "cand_id"]).withColumns({
        "active": (F.col("source_flag") > 0).cast("int"), "label": (F.col("break_depth") == 1).cast("int")})
    return out(A.structure_report(cands, cand_bins(d)), "teacher_entropy", "positive_ratio", "peak_mean", "dup_ratio")


STAGE_SQL = """s AS (SELECT spectrum_id, cand_id, count(*) AS raw_n, count(*) FILTER (intensity > 0 AND mz < 1005) AS binned_n,
  count(DISTINCT CASE WHEN intensity > 0 AND mz < 1005 THEN floor(mz / 1.0 + 1e-8) END) AS unique_n FROM cand_peaks GROUP BY 1, 2)"""


@query("a17_peak_stages", f"WITH {STAGE_SQL} SELECT * FROM s", "cand_peaks")
def _(d):
    return A.peak_stage_counts(d.cand_peaks, 1.0)


@query("a17_peak_gate", f"""WITH {STAGE_SQL}, q AS (SELECT count(*) AS candidates, avg(binned_n) AS peak_mean, quantile_cont(binned_n, 0.25) AS peak_p25, avg(unique_n) AS bin_mean,
  avg(CASE WHEN binned_n <= 1 THEN 1.0 ELSE 0 END) AS single_ratio, avg(CASE WHEN binned_n >= 2 THEN 1.0 ELSE 0 END) AS multi_ratio, avg(1 - unique_n / greatest(binned_n, 1)) AS repeat_ratio FROM s),
e AS (SELECT *, concat_ws('; ', CASE WHEN peak_mean <= 2.5 THEN 'peak_mean not above 2.5' END, CASE WHEN peak_p25 <= 2.0 THEN 'peak_p25 not above 2.0' END,
  CASE WHEN bin_mean <= 2.5 THEN 'bin_mean not above 2.5' END, CASE WHEN single_ratio >= 0.5 THEN 'single_ratio not below 0.5' END,
  CASE WHEN multi_ratio <= 0.85 THEN 'multi_ratio not above 0.85' END, CASE WHEN repeat_ratio >= 0.35 THEN 'repeat_ratio not below 0.35' END) AS errors FROM q)
SELECT candidates, round(peak_mean, 6) AS peak_mean, round(peak_p25, 6) AS peak_p25, round(bin_mean, 6) AS bin_mean, round(single_ratio, 6) AS single_ratio,
  round(multi_ratio, 6) AS multi_ratio, round(repeat_ratio, 6) AS repeat_ratio, errors, errors = '' AS passed FROM e""", "cand_peaks")
def _(d):
    rep = A.peak_audit(A.peak_stage_counts(d.cand_peaks, 1.0))
    return out(rep, "peak_mean", "peak_p25", "bin_mean", "single_ratio", "multi_ratio", "repeat_ratio")


@query("a18_consistency_audit", f"""WITH {bins_sql('tb', 'peaks')}, {bins_sql('pb', 'pred_peaks')}, {pairs_sql('tb', 'pb')}
SELECT spectrum_id, round(CASE WHEN sqrt(sum(t * t)) > 1e-12 AND sqrt(sum(p * p)) > 1e-12 THEN sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p)) + 1e-12) ELSE 0 END, 6) AS cosine,
  count(*) FILTER ((t > 0) <> (p > 0)) = 0 AS support_same FROM pairs GROUP BY 1""", "peaks pred_peaks")
def _(d):
    return out(A.consistency_audit(true_bins(d), pred_bins(d)), "cosine")


@query("a19_masked_peaks", """
SELECT c.spectrum_id, count(*) AS masked_with_peaks FROM candidates c WHERE prior <= 0.02 AND EXISTS (
  SELECT 1 FROM cand_peaks p WHERE p.spectrum_id = c.spectrum_id AND p.cand_id = c.cand_id AND break_depth = 1) GROUP BY 1""", "candidates")
def _(d):
    cands = d.candidates.withColumn("mask", (F.col("prior") > 0.02).cast("int"))
    return A.masked_peaks(cands, d.cand_peaks.filter("break_depth = 1"))


@query("a20_metric_means", "SELECT event_type AS key, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(d):
    history = d.table("events").select(F.col("event_type").alias("key"), "value")
    return out(A.metric_means(history), "mean")


@query("a21_group_reduce", """WITH m AS (SELECT spectrum_id, max(intensity / 10) AS top FROM cand_peaks GROUP BY 1)
SELECT c.spectrum_id, round(sum(intensity / 10), 6) AS sum, round(max(intensity / 10), 6) AS max, round(avg(intensity / 10), 6) AS mean,
  round(coalesce(var_samp(intensity / 10), 0), 6) AS var, arg_max(cand_id, (intensity, cand_id)) AS argmax, round(max(top) + ln(sum(exp(intensity / 10 - top)) + 1e-9), 6) AS lse
FROM cand_peaks c JOIN m ON m.spectrum_id = c.spectrum_id GROUP BY 1""", "cand_peaks")
def _(d):
    rows = d.cand_peaks.withColumn("v", F.col("intensity") / 10)
    return out(A.group_reduce(rows, ["spectrum_id"], "v", "cand_id"), "sum", "max", "mean", "var", "lse")


@query("a21_group_distribution", """WITH c AS (SELECT *, score / 10 AS v FROM candidates), m AS (SELECT *, CASE WHEN group_id > 0 THEN v END AS k FROM c)
SELECT spectrum_id, cand_id, round(coalesce(exp(k - max(k) OVER w) / sum(exp(k)) OVER w * exp(max(k) OVER w), 0), 6) AS softmax,
  round(v / sum(v) OVER w, 9) AS l1, round(v / sqrt(sum(v * v) OVER w), 6) AS l2 FROM m WINDOW w AS (PARTITION BY spectrum_id)""", "candidates")
def _(d):
    rows = d.candidates.withColumn("v", F.col("score") / 10)
    return out(A.group_distribution(rows, ["spectrum_id"], "v", "group_id").select("spectrum_id", "cand_id", "softmax", "l1", "l2"), "softmax", "l2").withColumn("l1", r6("l1", 9))


@query("a21_group_arg_topk", """
SELECT spectrum_id, cand_id, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, cand_id) AS rank FROM candidates QUALIFY rank <= 3""", "candidates")
def _(d):
    return A.group_arg_topk(d.candidates, ["spectrum_id"], "score", "cand_id", 3)


@query("a22_source_aggregate", """WITH r AS (SELECT l_partkey AS formula, l_linenumber - 4 AS h, CAST(l_returnflag = 'A' AS int) AS b, l_linenumber % 4 AS d,
  CAST(l_linestatus = 'F' AS int) AS ring, l_tax AS tax, l_discount AS discount FROM lineitem)
SELECT formula, 1.0 AS has_source, round(ln(1 + count(*)), 6) AS log_n, least(count(*), 16) / 16 AS n_clip, min(abs(h)) / 4 AS h_min, round(avg(abs(h)) / 4, 6) AS h_mean, max(b) AS brics_any,
  least(sum(b), 16) / 16 AS brics_sum, min(d) / 4 AS depth_min, max(ring) AS ring_any, round(avg(ring), 6) AS ring_ratio, round(avg(tax), 6) AS tax_mean, round(max(tax), 6) AS tax_max,
  round(avg(discount), 6) AS discount_mean, round(max(discount), 6) AS discount_max FROM r GROUP BY 1""")
def _(d):
    li = d.table("lineitem")
    rec = li.select(F.col("l_partkey").alias("formula"), (F.col("l_linenumber") - 4).alias("h_shift"), (F.col("l_returnflag") == "A").cast("int").alias("brics"),
                    (F.col("l_linenumber") % 4).alias("depth"), (F.col("l_linestatus") == "F").cast("int").alias("ring_cut"),
                    F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return out(A.source_aggregate(rec, ["formula"], ["tax", "discount"]), "log_n", "h_mean", "ring_ratio", "tax_mean", "tax_max", "discount_mean", "discount_max")


def dealt(d):
    return 2 * parts_for(d.table("lineitem"))  # a peak is up to three rows on the way


def overlaps(d, tol_bins=0):
    parts = dealt(d)
    return G.overlap_scores(T.bin_candidates(d.cand_peaks, None, parts=parts), pred_bins(d, parts=parts), parts, tol_bins)


OV_COLS = ("overlap_exact", "overlap_near", "support_exact", "support_near", "top_near", "false_exact")


@query("a23_overlap_scores", f"WITH {OV_SQL} SELECT spectrum_id, cand_id, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in OV_COLS)} FROM ov", PROBE_VIEWS)
def _(d):
    return overlaps(d, 1).withColumns({c: r6(c, 9) for c in OV_COLS})


@query("a23_quality_labels", f"""WITH {OV_SQL}, s0 AS (SELECT *, least(greatest(1 - false_exact, 0), 1) AS sup FROM ov),
s1 AS (SELECT *, round(greatest(1.5 * overlap_exact + 0.4 * overlap_near + 0.35 * support_near + 0.75 * top_near - 1.2 * false_exact, 0) * sup * sup, 12) AS qs,
  round(0.5 * sup + 0.35 * support_near + 0.15 * top_near, 9) AS fb, round(3 * overlap_near + 1.5 * overlap_exact + 2 * top_near + 0.25 * support_near - 0.35 * false_exact, 9) AS po FROM s0),
s2 AS (SELECT *, CASE WHEN qs > 0 AND sup >= 0.2 AND support_near >= 0.25 AND false_exact <= 0.8 THEN qs ELSE 0 END AS q,
  fb > 0 AND sup >= 0.05 AND false_exact <= 0.95 AS fbk, (overlap_near >= 5e-4 OR overlap_exact >= 1e-4 OR top_near >= 5e-4) AND false_exact <= 0.97 AS pok FROM s1),
s3 AS (SELECT *, CASE WHEN max(q) OVER w > 1e-8 THEN round(q / max(q) OVER w, 9) ELSE 0 END AS quality FROM s2 WINDOW w AS (PARTITION BY spectrum_id)),
s4 AS (SELECT *, CASE WHEN q > 0 AND row_number() OVER (PARTITION BY spectrum_id ORDER BY CASE WHEN q > 0 THEN 1 ELSE 0 END DESC, quality DESC, cand_id) <= 3 THEN 1 ELSE 0 END AS clean,
  CASE WHEN fbk AND row_number() OVER (PARTITION BY spectrum_id ORDER BY CASE WHEN fbk THEN 1 ELSE 0 END DESC, fb DESC, cand_id) <= 2 THEN 1 ELSE 0 END AS fbl,
  CASE WHEN pok AND row_number() OVER (PARTITION BY spectrum_id ORDER BY CASE WHEN pok THEN 1 ELSE 0 END DESC, po DESC, cand_id) <= 4 THEN 1 ELSE 0 END AS pl FROM s3),
s5 AS (SELECT *, sum(clean) OVER (PARTITION BY spectrum_id) AS n FROM s4),
s6 AS (SELECT *, CASE WHEN n < 2 THEN greatest(clean, fbl) ELSE clean END AS lb FROM s5)
SELECT spectrum_id, cand_id, round(quality, 6) AS quality, clean AS clean_label, CASE WHEN lb = 1 AND row_number() OVER (PARTITION BY spectrum_id ORDER BY lb DESC, quality DESC, cand_id) <= 3
  THEN 1 ELSE 0 END AS label, pl AS pool_label, CAST(n < 2 AS int) AS fallback_used FROM s6""", PROBE_VIEWS)
def _(d):
    return out(G.quality_labels(overlaps(d, 1), dealt(d), 3, 2, 4), "quality")


TEACHER_SQL = f"""{OV_SQL}, sc AS (SELECT spectrum_id, cand_id, round(6 * overlap_exact + 0.5 * support_exact + 2 * top_exact - 2 * false_exact, 9) AS score FROM ov),
sr AS (SELECT *, CASE WHEN score > 0 AND row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, cand_id) <= 3 THEN score / 0.25 END AS s FROM sc),
te AS (SELECT spectrum_id, cand_id, score, coalesce(exp(s - max(s) OVER w) / sum(exp(s)) OVER w * exp(max(s) OVER w), 0) AS prob FROM sr WINDOW w AS (PARTITION BY spectrum_id))"""


def teacher(d):
    return G.overlap_teacher(overlaps(d), 3)


@query("a24_overlap_teacher", f"WITH {TEACHER_SQL} SELECT spectrum_id, cand_id, round(score, 6) + 0.0 AS score, round(prob, 6) AS prob FROM te", PROBE_VIEWS)
def _(d):
    return out(teacher(d), "score", "prob")


@query("a24_utility", f"""WITH {OV_SQL}, u AS (SELECT spectrum_id, cand_id, overlap_exact - 1.2 * false_exact AS raw FROM ov)
SELECT spectrum_id, cand_id, round((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w + 1e-8), 6) + 0.0 AS utility,
  round(exp(raw / 0.7) / sum(exp(raw / 0.7)) OVER w, 6) AS utility_prob FROM u WINDOW w AS (PARTITION BY spectrum_id)""", PROBE_VIEWS)
def _(d):
    return out(G.utility(overlaps(d)), "utility", "utility_prob")


@query("a25_target_distribution", """WITH v AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY spectrum_id ORDER BY greatest(prior - 0.05, 0) DESC, cand_id) <= 2 THEN 1 ELSE 0 END AS kept,
  greatest(prior - 0.05, 0) AS v FROM candidates)
SELECT spectrum_id, cand_id, kept, round(CASE WHEN sum(v * kept) OVER w > 1e-12 THEN v * kept / sum(v * kept) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS target
FROM v WINDOW w AS (PARTITION BY spectrum_id)""", "candidates")
def _(d):
    rows = d.candidates.withColumn("v", F.col("prior") - 0.05)
    return out(G.target_distribution(rows, "v", 2).select("spectrum_id", "cand_id", "kept", "target"), "target")


SEL_SQL = f"""{TEACHER_SQL}, rk AS (SELECT spectrum_id, cand_id, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, cand_id) AS rank, prior * 5 AS quality FROM candidates),
wt AS (SELECT spectrum_id, cand_id FROM te WHERE prob > 0), v(k) AS (VALUES (1), (2), (4)),
c1 AS (SELECT r.spectrum_id, k, count(*) AS n, count(w.cand_id) AS hits, avg(quality) AS q, avg(CASE WHEN quality > 0.3 THEN 1.0 ELSE 0 END) AS q3
  FROM rk r JOIN v ON rank <= k LEFT JOIN wt w ON w.spectrum_id = r.spectrum_id AND w.cand_id = r.cand_id GROUP BY 1, 2),
nw AS (SELECT spectrum_id, count(*) AS wanted FROM wt GROUP BY 1),
pk2 AS (SELECT r.spectrum_id, r.rank, c.bin, c.intensity, t.intensity AS t FROM rk r JOIN cand_bins c ON c.spectrum_id = r.spectrum_id AND c.cand_id = r.cand_id
  LEFT JOIN tb t ON t.spectrum_id = c.spectrum_id AND t.bin = c.bin),
pu AS (SELECT spectrum_id, k, sum(CASE WHEN t IS NOT NULL THEN intensity ELSE 0 END) / sum(intensity) AS purity FROM pk2 JOIN v ON rank <= k GROUP BY 1, 2),
cv AS (SELECT spectrum_id, k, count(DISTINCT bin) AS cn FROM pk2 JOIN v ON rank <= k WHERE t IS NOT NULL GROUP BY 1, 2),
ci AS (SELECT spectrum_id, k, sum(t) AS ci FROM (SELECT DISTINCT spectrum_id, k, bin, t FROM pk2 JOIN v ON rank <= k WHERE t IS NOT NULL) GROUP BY 1, 2),
tt AS (SELECT spectrum_id, count(*) AS tn, sum(intensity) AS ti FROM tb GROUP BY 1)"""


@query("a26_selection_metrics", f"""WITH {SEL_SQL}
SELECT c1.k, round(avg(hits / greatest(coalesce(wanted, 0), 1)), 6) AS teacher_recall, round(avg(hits / n), 6) AS teacher_precision, round(avg(purity), 6) AS true_hit_mass,
  round(avg(1 - purity), 6) AS false_mass, round(avg(coalesce(cn, 0) / tn), 6) AS pool_peak_recall, round(avg(coalesce(ci, 0) / ti), 6) AS pool_intensity_recall,
  round(avg(q), 6) AS quality_mean, round(avg(q3), 6) AS quality_precision
FROM c1 LEFT JOIN nw ON nw.spectrum_id = c1.spectrum_id LEFT JOIN pu ON pu.spectrum_id = c1.spectrum_id AND pu.k = c1.k
LEFT JOIN cv ON cv.spectrum_id = c1.spectrum_id AND cv.k = c1.k LEFT JOIN ci ON ci.spectrum_id = c1.spectrum_id AND ci.k = c1.k
LEFT JOIN tt ON tt.spectrum_id = c1.spectrum_id GROUP BY 1""", PROBE_VIEWS)
def _(d):
    ranked = K.plain_topk(d.candidates, 4).withColumn("quality", F.col("prior") * 5)
    res = G.selection_metrics(ranked, teacher(d).filter("prob > 0"), cand_bins(d), pred_bins(d), (1, 2, 4))
    return out(res, *[c for c in res.columns if c != "k"])


@query("a27_peak_shares", f"""WITH {CB}, {TB}, j AS (SELECT c.spectrum_id, c.cand_id, c.bin, coalesce(t.intensity, 0) AS t, sum(coalesce(t.intensity, 0)) OVER (PARTITION BY c.spectrum_id, c.cand_id) AS s
  FROM cand_bins c LEFT JOIN tb t ON t.spectrum_id = c.spectrum_id AND t.bin = c.bin)
SELECT spectrum_id, cand_id, bin, round(t / greatest(s, 1e-8), 6) AS peak_target FROM j WHERE s > 0""", PROBE_VIEWS)
def _(d):
    return out(G.peak_shares(cand_bins(d), pred_bins(d)), "peak_target")


@query("a27_rerank_target", """WITH t AS (SELECT *, prior / greatest(sum(prior) OVER (PARTITION BY spectrum_id), 1e-8) AS target FROM candidates)
SELECT spectrum_id, cand_id, round(target, 6) AS target, CAST(row_number() OVER (PARTITION BY spectrum_id ORDER BY prior DESC, cand_id) <= 2 AS int) AS positive FROM t""", "candidates")
def _(d):
    return out(G.rerank_target(d.candidates, "prior", 2), "target")


@query("a28_teacher_audit", f"""WITH {TEACHER_SQL}, {PROBS_SQL}, al AS (SELECT 'overlap' AS teacher, spectrum_id, cand_id, prob FROM te UNION ALL SELECT 'score', spectrum_id, cand_id, prob FROM probs),
n AS (SELECT teacher, spectrum_id, count(*) FILTER (prob > 0) AS sn FROM al GROUP BY 1, 2),
b AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY teacher, spectrum_id ORDER BY prob DESC, cand_id) <= 2),
p AS (SELECT teacher, b.spectrum_id, sum(CASE WHEN t.bin IS NOT NULL THEN c.intensity ELSE 0 END) / sum(c.intensity) AS p FROM b JOIN cand_bins c ON c.spectrum_id = b.spectrum_id AND c.cand_id = b.cand_id
  LEFT JOIN tb t ON t.spectrum_id = c.spectrum_id AND t.bin = c.bin GROUP BY 1, 2)
SELECT n.teacher, round(avg(p), 6) AS true_hit_mass, round(avg(1 - p), 6) AS false_mass, round(avg(sn), 6) AS selected_n FROM n LEFT JOIN p ON p.teacher = n.teacher AND p.spectrum_id = n.spectrum_id GROUP BY 1""",
       PROBE_VIEWS)
def _(d):
    tea = teacher(d).withColumn("prob", F.round("prob", 12))
    res = G.teacher_audit({"overlap": tea, "score": candidate_probs(d)}, cand_bins(d), pred_bins(d), 2)
    return out(res, "true_hit_mass", "false_mass", "selected_n")


@query("a29_preparation_diagnostics", f"""WITH {CB}, {TB}, cp AS (SELECT spectrum_id, cand_id, min(mz) AS lo FROM cand_peaks WHERE intensity > 10 GROUP BY 1, 2),
st AS (SELECT c.*, lo IS NOT NULL AS hp, coalesce(lo <= precursor_mz + 1, false) AS bp FROM candidates c LEFT JOIN cp ON cp.spectrum_id = c.spectrum_id AND cp.cand_id = c.cand_id
  JOIN spectra s ON s.spectrum_id = c.spectrum_id),
n AS (SELECT spectrum_id, count(*) AS raw_n, count(*) FILTER (hp) AS mass_mask_n, count(*) FILTER (hp AND bp) AS precursor_mask_n, count(*) FILTER (prior > 0.03) AS final_n,
  count(*) FILTER (prior > 0.03 AND source_flag > 0) AS source_n, count(*) FILTER (prior > 0.03 AND source_flag > 0 AND break_depth = 1) AS single_n,
  count(*) FILTER (prior > 0.03 AND source_flag > 0 AND break_depth = 2) AS double_n, count(*) FILTER (prior > 0.03 AND source_flag > 0 AND break_depth >= 3) AS deep_n FROM st GROUP BY 1),
af AS (SELECT DISTINCT b.spectrum_id, bin FROM cand_bins b JOIN candidates c ON c.spectrum_id = b.spectrum_id AND c.cand_id = b.cand_id WHERE prior > 0.03),
bf AS (SELECT DISTINCT spectrum_id, bin FROM cand_bins),
cv AS (SELECT t.spectrum_id, count(*) AS target_bins, count(b.bin) / count(*) AS cb, count(a.bin) / count(*) AS ca, sum(CASE WHEN a.bin IS NOT NULL THEN intensity ELSE 0 END) / sum(intensity) AS m
  FROM tb t LEFT JOIN bf b ON b.spectrum_id = t.spectrum_id AND b.bin = t.bin LEFT JOIN af a ON a.spectrum_id = t.spectrum_id AND a.bin = t.bin GROUP BY 1)
SELECT n.*, target_bins, round(cb, 6) AS coverage_before_cap, round(ca, 6) AS coverage_after_cap, round(m, 6) AS matched_intensity, round(1 - m, 6) AS out_of_support
FROM n LEFT JOIN cv ON cv.spectrum_id = n.spectrum_id""", "pred_peaks candidates spectra")
def _(d):
    keys = ["spectrum_id", "cand_id"]
    lows = d.cand_peaks.filter("intensity > 10").groupBy(*keys).agg(F.min("mz").alias("lo"))
    stages = d.candidates.join(lows, keys, "left").join(d.spectra.select("spectrum_id", "precursor_mz"), "spectrum_id").withColumns({
        "has_peak": F.col("lo").isNotNull(), "below_precursor": F.coalesce(F.col("lo") <= F.col("precursor_mz") + 1, F.lit(False)),
        "kept": F.col("prior") > 0.03})
    bins = cand_bins(d)
    after = bins.join(stages.filter("kept").select(*keys), keys, "left_semi")
    res = A.preparation_diagnostics(stages, bins, after, pred_bins(d))
    return out(res, "coverage_before_cap", "coverage_after_cap", "matched_intensity", "out_of_support")


NODE_SQL = f"""{TB}, ts AS (SELECT *, intensity / sum(intensity) OVER (PARTITION BY spectrum_id) AS t, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) AS tr FROM tb),
nd AS (SELECT c.spectrum_id, cand_id AS node_id, mz, CAST(floor(mz / 0.01 + 1e-8) AS bigint) AS bin FROM cand_peaks c JOIN spectra s ON s.spectrum_id = c.spectrum_id
  WHERE mz > 0 AND mz < 1005 AND mz <= precursor_mz + 1),
nl AS (SELECT nd.*, coalesce(t, 0) AS true_intensity, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS label, CASE WHEN tr <= 20 THEN 1 ELSE 0 END AS is_top FROM nd
  LEFT JOIN ts ON ts.spectrum_id = nd.spectrum_id AND ts.bin = nd.bin)"""


def nodes(d):
    rows = d.cand_peaks.select("spectrum_id", F.col("cand_id").alias("node_id"), "mz")
    return G.fragment_nodes(rows, pred_bins(d), d.spectra)


@query("a30_fragment_nodes", f"WITH {NODE_SQL} SELECT * REPLACE (round(mz, 6) AS mz, round(true_intensity, 6) AS true_intensity) FROM nl", "pred_peaks cand_peaks spectra")
def _(d):
    return out(nodes(d), "mz", "true_intensity")


@query("a30_fragment_node_stats", f"""WITH {NODE_SQL}, a AS (SELECT spectrum_id, count(*) AS node_n, sum(label) AS hit_node_n, sum(is_top) AS top_node_n FROM nl GROUP BY 1),
b0 AS (SELECT spectrum_id, bin, max(true_intensity) AS t, max(label) AS l, max(is_top) AS p FROM nl GROUP BY 1, 2),
b AS (SELECT spectrum_id, count(*) AS bin_n, sum(l) AS hit_bin_n, sum(p) AS top_bin_n, sum(t) AS ic FROM b0 GROUP BY 1), n AS (SELECT spectrum_id, count(*) AS tn FROM tb GROUP BY 1)
SELECT a.*, bin_n, hit_bin_n, top_bin_n, round(hit_bin_n / tn, 6) AS support_coverage, round(ic, 6) AS intensity_coverage, round(hit_node_n / node_n, 6) AS node_hit_ratio,
  round(hit_bin_n / bin_n, 6) AS bin_hit_ratio, round(top_bin_n / least(tn, 20), 6) AS top_recall FROM a JOIN b USING (spectrum_id) LEFT JOIN n USING (spectrum_id)""",
       "pred_peaks cand_peaks spectra")
def _(d):
    res = G.fragment_node_stats(nodes(d), pred_bins(d))
    return out(res, "support_coverage", "intensity_coverage", "node_hit_ratio", "bin_hit_ratio", "top_recall")
