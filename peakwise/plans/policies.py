"""Queries for filters, reject policies, splits, samples and set operations."""

from pyspark.sql import functions as F

from peakwise.functions import formula as FX
from peakwise.functions import normalize as N
from peakwise.operators import policy as P
from peakwise.operators import sampling as S
from peakwise.operators import transforms as T
from peakwise.plans.normalise import ADDUCT_SQL, INSTRUMENT_SQL, NCE_SQL
from peakwise.plans.quality import bins_sql, pred_bins, true_bins
from peakwise.plans.registry import query
from peakwise.plans.spectra import out
from peakwise.skew import r6

METHOD_SQL = """CASE WHEN lower(ce_raw) LIKE '%hcd%' THEN 'HCD' WHEN lower(ce_raw) LIKE '%cid%' THEN 'CID'
  WHEN lower(ce_raw) LIKE '%etd%' THEN 'ETD' END"""


def hash_sql(text: str) -> str:
    return f"(CAST(('0x' || left(sha1({text}), 16)) AS UBIGINT)::double / 18446744073709551616.0)"


def split_sql(u: str) -> str:
    return f"CASE WHEN {u} < 0.8 THEN 'train' WHEN {u} < 0.9 THEN 'val' ELSE 'test' END"


POLICY_SQL = f"""prows AS (
SELECT s.spectrum_id, s.identifier, s.inchikey, precursor_mz, {ADDUCT_SQL} AS adduct, {INSTRUMENT_SQL} AS instrument,
  {METHOD_SQL} AS frag_method, {NCE_SQL} AS ce_nce, t.total AS total_intensity, m.mol_id IS NOT NULL AS found,
  m.formula, m.n_heavy, m.charge, m.n_radicals, m.n_components, s.mol_id AS cas,
  m.mol_id + CASE WHEN m.mol_id % 31 = 0 THEN 1 ELSE 0 END AS mol_cas,
  CASE WHEN m.mol_id % 37 = 0 THEN 'OTHER' ELSE m.inchikey END AS mol_inchikey,
  {split_sql(hash_sql("concat('42|inchikey:', s.inchikey)"))} AS split
FROM spectra s LEFT JOIN (SELECT spectrum_id, sum(greatest(intensity, 0)) AS total FROM peaks GROUP BY 1) t
  ON s.spectrum_id = t.spectrum_id
LEFT JOIN (SELECT * FROM molecules WHERE mol_id % 29 <> 0) m ON s.mol_id = m.mol_id)"""


def policy_rows(d, facts=False):
    """Spectra with normalised conditions, total intensity and their molecule's attributes."""
    s = d.spectra
    totals = d.peaks.groupBy("spectrum_id").agg(
        F.sum(F.greatest("intensity", F.lit(0.0))).alias("total_intensity"))
    k = F.col("mol_id")
    mol = d.molecules.filter(k % 29 != 0).select(
        "mol_id", "formula", "n_heavy", "charge", "n_radicals", "n_components",
        (k + F.when(k % 31 == 0, 1).otherwise(0)).alias("mol_cas"),
        F.when(k % 37 == 0, "OTHER").otherwise(F.col("inchikey")).alias("mol_inchikey"),
        F.lit(True).alias("mol_found"))
    rows = s.select(
        "spectrum_id", "identifier", "inchikey", "mol_id", "precursor_mz", k.alias("cas"),
        N.adduct(F.col("adduct_raw")).alias("adduct"), N.instrument(F.col("instrument_raw")).alias("instrument"),
        N.fragmentation_method(F.col("ce_raw")).alias("frag_method"), N.nce_value(F.col("ce_raw")).alias("ce_nce"))
    group = N.group_key(F.col("inchikey"), F.lit(None).cast("string"), k)
    mol = P.with_formula_facts(mol, ["C", "H", "N", "O"]) if facts else mol
    return rows.join(totals, "spectrum_id", "left").join(mol, "mol_id", "left").withColumn(
        "split", S.split_name(S.uniform_hash(group, 42)))


F_VIEWS = "spectra peaks molecules"
ELEMENTS_SQL = "NOT contains(formula, 'Si')"


def reasons_sql(case: str) -> str:
    return f"WITH {POLICY_SQL} SELECT coalesce({case}, 'kept') AS reason, count(*) AS n FROM prows GROUP BY 1"


@query("f01_ingest_policy", reasons_sql("""CASE WHEN split <> 'train' THEN 'split_skip' WHEN ce_nce IS NULL THEN 'ce_missing'
  WHEN adduct NOT IN ('[M+H]+', '[M+NH4]+') THEN 'adduct_not_allowed'
  WHEN instrument IS NULL OR instrument NOT IN ('Orbitrap', 'QTOF', 'ITFT') THEN 'instrument_not_allowed'
  WHEN precursor_mz > 950 THEN 'precursor_mz_invalid' WHEN total_intensity IS NULL THEN 'empty_spectrum'
  WHEN NOT found THEN 'join_missing_mol' WHEN cas <> mol_cas THEN 'hard_cas_mismatch'
  WHEN inchikey <> mol_inchikey THEN 'hard_inchikey_mismatch' END"""), F_VIEWS)
def _(d):
    rules = P.ingest_rules("train", True, ["[M+H]+", "[M+NH4]+"], ["Orbitrap", "QTOF", "ITFT"], [], 950.0)
    return P.reject_counts(P.apply_policy(policy_rows(d), rules))


@query("f02_strict_policy", reasons_sql(f"""CASE WHEN adduct <> '[M+H]+' THEN 'adduct_not_allowed'
  WHEN precursor_mz <= 0 OR precursor_mz > 950 THEN 'precursor_mz_invalid' WHEN ce_nce IS NULL THEN 'ce_missing'
  WHEN formula IS NULL OR NOT {ELEMENTS_SQL} THEN 'allowed_elements_not_ok' WHEN n_heavy > 60 THEN 'heavy_atom_overflow'
  WHEN charge IS NULL OR charge <> 0 THEN 'charged_molecule' WHEN n_radicals IS NULL OR n_radicals <> 0 THEN 'radical_molecule'
  WHEN n_components IS NULL OR n_components <> 1 THEN 'multi_component' WHEN mol_inchikey IS NULL THEN 'canonical_failed'
  WHEN total_intensity IS NULL THEN 'empty_or_zero_spectrum' END"""), F_VIEWS)
def _(d):
    return P.reject_counts(P.apply_policy(policy_rows(d), P.strict_rules("[M+H]+", 950.0, 60, ["C", "H", "N", "O"])))


@query("f03_row_policy", f"""
WITH {POLICY_SQL}, c AS (SELECT *, CASE WHEN inchikey LIKE '%9' THEN 'identifier_not_selected'
  WHEN charge IS NULL OR charge <> 0 THEN 'charged_molecule' WHEN n_radicals <> 0 THEN 'radical_molecule'
  WHEN n_components <> 1 THEN 'multi_component' WHEN mol_inchikey IS NULL THEN 'canonical_failed'
  WHEN total_intensity IS NULL THEN 'empty_or_zero_spectrum' WHEN ce_nce IS NULL THEN 'ce_missing'
  WHEN lower(adduct) NOT IN ('[m+h]+', '[m+na]+') THEN 'adduct_not_allowed'
  WHEN instrument IS NULL OR lower(instrument) NOT IN ('orbitrap', 'qtof') THEN 'instrument_not_allowed'
  WHEN precursor_mz > 950 THEN 'precursor_mz_invalid' WHEN NOT {ELEMENTS_SQL} THEN 'allowed_elements_not_ok'
  WHEN n_heavy > 60 THEN 'heavy_atom_overflow'
  WHEN (n_heavy + 1) * (2 * n_heavy + 1) > 6000 THEN 'formula_n_raw_overflow' END AS reason FROM prows)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n,
       count(*) FILTER (reason IS NULL AND (n_heavy + 1) * (2 * n_heavy + 1) > 3000) AS soft_overflow FROM c GROUP BY 1""",
       F_VIEWS)
def _(d):
    rules = P.row_rules(~F.col("inchikey").endswith("9"), ["[M+H]+", "[M+Na]+"], ["Orbitrap", "QTOF"], 950.0, 60,
                        ["C", "H", "N", "O"], 6000, facts=True)
    rows = P.apply_policy(policy_rows(d, facts=True), rules)
    soft = F.col("reject_reason").isNull() & (F.col("search_space") > 3000)
    return rows.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(soft, F.lit(False)).cast("long")).alias("soft_overflow"))


_MASKS = {"instrument": "instrument IN ('Orbitrap', 'QTOF')", "energy": "ce_nce IS NOT NULL",
          "precursor_known": "precursor_mz IS NOT NULL", "precursor_max": "precursor_mz <= 950",
          "precursor_min": "precursor_mz >= 50", "single_mol": "n_components = 1", "neutral": "charge = 0",
          "elements": ELEMENTS_SQL, "atom_count": "n_heavy <= 60", "non_radical": "n_radicals = 0"}
_ALL = " AND ".join(f"coalesce({m}, false)" for m in _MASKS.values())


@query("f04_mask_pass_rates", f"WITH {POLICY_SQL} " + " UNION ALL ".join(
    f"SELECT '{n}' AS mask, round(avg(CASE WHEN {m} THEN 1.0 ELSE 0.0 END), 9) AS pass_rate FROM prows"
    for n, m in {**_MASKS, "everything": _ALL}.items()), F_VIEWS)
def _(d):
    c = F.col
    masks = {
        "instrument": c("instrument").isin("Orbitrap", "QTOF"), "energy": c("ce_nce").isNotNull(),
        "precursor_known": c("precursor_mz").isNotNull(), "precursor_max": c("precursor_mz") <= 950,
        "precursor_min": c("precursor_mz") >= 50, "single_mol": c("n_components") == 1, "neutral": c("charge") == 0,
        "elements": FX.elements_subset(c("formula"), ["C", "H", "N", "O"]), "atom_count": c("n_heavy") <= 60,
        "non_radical": c("n_radicals") == 0}
    _, report = P.pass_rates(policy_rows(d), masks)
    return report.withColumn("pass_rate", r6("pass_rate", 9))


@query("f04_referenced_molecules", f"""
WITH {POLICY_SQL} SELECT DISTINCT cas AS mol_id FROM prows WHERE {_ALL}""", F_VIEWS)
def _(d):
    c = F.col
    kept, _ = P.pass_rates(policy_rows(d), {
        "all": c("instrument").isin("Orbitrap", "QTOF") & c("ce_nce").isNotNull() & (c("precursor_mz") <= 950)
        & (c("precursor_mz") >= 50) & (c("n_components") == 1) & (c("charge") == 0) & (c("n_radicals") == 0)
        & (c("n_heavy") <= 60) & FX.elements_subset(c("formula"), ["C", "H", "N", "O"])})
    return P.keep_listed(d.molecules, kept, "mol_id").select("mol_id")


@query("f05_element_subset", "SELECT formula_id, NOT contains(formula, 'Cl') AS ok FROM formulas", "formulas")
def _(d):
    return d.formulas.select("formula_id", FX.elements_subset(F.col("formula"), ["C", "H", "N", "O"]).alias("ok"))


@query("f06_molecule_class", """
SELECT mol_id, NOT contains(formula, 'Si') AND n_heavy >= 10 AND n_heavy < 50 AS chno, n_rings > 0 AS ring,
       n_rings = 0 AS no_ring, false AS halogen, true AS no_halogen FROM molecules""", "molecules")
def _(d):
    els = F.map_keys(FX.counts(F.col("formula")))
    args = (els, F.col("n_rings"), F.lit(0), F.col("n_heavy"))
    cls = lambda rule, lo=0.0, hi=0.0: P.molecule_class(rule, *args, lo, hi).alias(rule)
    return d.molecules.select("mol_id", cls("chno", 10.0, 50.0), cls("ring"), cls("no_ring"), cls("halogen"),
                              cls("no_halogen"))


@query("f07_peak_window", """
SELECT spectrum_id, round(mz, 6) AS mz, intensity FROM peaks WHERE intensity > 5 AND mz < 900""", "peaks")
def _(d):
    return out(T.filter_peaks(d.peaks, 5.0, 900.0), "mz")


@query("f08_nonempty_spectra", """
SELECT spectrum_id FROM peaks WHERE intensity > 3 GROUP BY 1 HAVING sum(greatest(intensity - 10, 0)) > 0""", "peaks")
def _(d):
    shifted = d.peaks.filter("intensity > 3").withColumn("intensity", F.col("intensity") - 10)
    return P.nonempty_spectra(shifted)


@query("f09_identifier_whitelist", """
SELECT spectrum_id FROM spectra WHERE identifier IN
  (SELECT concat('spec:', CAST(user_id AS varchar)) FROM events WHERE event_type = 'purchase')""", "spectra")
def _(d):
    ids = d.table("events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("spec:"), F.col("user_id").cast("string")).alias("identifier"))
    return P.keep_listed(d.spectra, ids, "identifier").select("spectrum_id")


FPARTS_SQL = """fp AS (SELECT p_partkey AS k, p_size AS c, 2 * p_size + 2 AS h, p_partkey % 4 AS n, p_partkey % 6 AS o,
  CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS cl FROM part),
fm AS (SELECT *, c * 12.0 + h * 1.00782503223 + n * 14.00307400443 + o * 15.99491461957 + cl * 34.968852682 AS mass FROM fp)"""


def parent_pairs(d):
    """Each formula next to the formula three ids further on, as candidate and parent."""
    f = d.formulas
    parent = f.select((F.col("formula_id") - 3).alias("formula_id"), F.col("formula").alias("parent_formula"))
    return f.join(parent, "formula_id")


@query("f10_candidate_hard_filter", f"""
WITH {FPARTS_SQL} SELECT a.k AS formula_id FROM fm a JOIN fm b ON b.k = a.k + 3
WHERE a.c <= b.c AND a.n <= b.n AND a.o <= b.o AND a.cl <= b.cl AND a.mass <= b.mass + 4.1""")
def _(d):
    return P.candidate_hard_filter(parent_pairs(d)).select("formula_id")


SAFE_SQL = """s AS (SELECT spectrum_id, cand_id, min(mz) AS lowest, sum(intensity) AS total FROM cand_peaks
  WHERE intensity > 10 GROUP BY 1, 2),
r AS (SELECT c.spectrum_id, c.cand_id, s.total IS NOT NULL AS has_peak,
        coalesce(lowest <= precursor_mz + 0.5, false) AS below, c.group_id <> 0 AS dbe, coalesce(total, 0) AS total
      FROM candidates c LEFT JOIN s ON c.spectrum_id = s.spectrum_id AND c.cand_id = s.cand_id
      JOIN spectra p ON c.spectrum_id = p.spectrum_id),
k AS (SELECT *, has_peak AND below AND dbe AS keep, max(CASE WHEN has_peak AND below AND dbe THEN 1 ELSE 0 END)
        OVER (PARTITION BY spectrum_id) AS any_keep,
        row_number() OVER (PARTITION BY spectrum_id ORDER BY total DESC, cand_id) AS rn FROM r)"""


def _safe(d):
    strong = d.cand_peaks.withColumn("intensity", F.when(F.col("intensity") > 10, F.col("intensity")).otherwise(0.0))
    return P.candidate_safe_filter(strong, d.candidates, d.spectra, 0.5, F.col("group_id") != 0)


@query("f11_candidate_safe_filter", f"""
WITH {SAFE_SQL} SELECT spectrum_id, cand_id FROM k WHERE keep OR (any_keep = 0 AND rn = 1)""", "candidates spectra")
def _(d):
    return _safe(d)[0].select("spectrum_id", "cand_id")


@query("f11_removal_counts", f"""
WITH {SAFE_SQL} SELECT spectrum_id, count(*) AS n_before, count(*) FILTER (NOT has_peak) AS removed_empty_peak,
  count(*) FILTER (NOT below) AS removed_precursor_cap, count(*) FILTER (NOT dbe) AS removed_dbe,
  CAST(max(any_keep) = 0 AS int) AS fallback_keep_one, greatest(count(*) FILTER (keep), 1) AS n_after
FROM k GROUP BY 1""", "candidates spectra")
def _(d):
    return _safe(d)[1]


@query("f12_phase_filter", """
SELECT p_partkey FROM part WHERE p_size <= 40 AND p_retailprice <= 1500 AND p_partkey % 10 NOT IN (3, 7)""")
def _(d):
    phase = S.modulo_phase(F.col("p_partkey"), 10, None, [3, 7])
    return P.phase_filter(d.table("part"), {"p_size": 40, "p_retailprice": 1500}, phase, "train").select("p_partkey")


@query("f13_condition_filter", f"""
WITH {POLICY_SQL} SELECT spectrum_id FROM prows WHERE lower(adduct) IN ('[m+h]+', '[m+na]+')
  AND lower(instrument) IN ('qtof', 'itft') AND precursor_mz <= 700""", F_VIEWS)
def _(d):
    rows = policy_rows(d)
    return P.condition_filter(rows, ["[m+h]+ ", "[M+NA]+"], ["qtof", "ITFT"], 700.0).select("spectrum_id")


@query("f14_sparsify_prediction", """
WITH s AS (SELECT *, intensity / sum(intensity) OVER (PARTITION BY spectrum_id) AS p FROM pred_peaks)
SELECT spectrum_id, round(mz, 6) AS mz, round(p, 6) AS intensity FROM s WHERE p > 0.05""", "pred_peaks")
def _(d):
    return out(T.sparsify_prediction(d.pred_peaks, 0.05), "mz", "intensity")


# ---- splits, samples, set operations ----

U64 = hash_sql("concat('42|inchikey:', inchikey)")
U48 = """(CAST(('0x' || left(sha1(concat('inchikey:', inchikey, '|42')), 12)) AS BIGINT) % 1000000) / 1000000.0"""


def group_of(df):
    return df.withColumn("group_key", N.group_key(F.col("inchikey"), F.lit(None).cast("string"), F.col("mol_id")))


@query("s01_stable_split", f"SELECT spectrum_id, round({U64}, 9) AS u, {split_sql(U64)} AS split FROM spectra", "spectra")
def _(d):
    u = S.uniform_hash(F.col("group_key"), 42)
    return group_of(d.spectra).select("spectrum_id", r6(u, 9).alias("u"), S.split_name(u).alias("split"))


@query("s02_stable_split_mod", f"SELECT spectrum_id, round({U48}, 9) AS u, {split_sql(U48)} AS split FROM spectra",
       "spectra")
def _(d):
    u = S.uniform_hash_mod(F.col("group_key"), 42)
    return group_of(d.spectra).select("spectrum_id", r6(u, 9).alias("u"), S.split_name(u).alias("split"))


@query("s03_modulo_phase", """
SELECT mol_id, CASE WHEN mol_id % 10 IN (0, 1, 2, 3, 4, 5) THEN 'train' WHEN mol_id % 10 IN (6, 7) THEN 'test'
  ELSE 'null' END AS phase FROM molecules""", "molecules")
def _(d):
    return d.molecules.select("mol_id", S.modulo_phase(F.col("mol_id"), 10, range(6), [6, 7]).alias("phase"))


@query("s04_group_key", """
SELECT spectrum_id, CASE WHEN spectrum_id % 3 = 0 THEN concat('inchikey:', inchikey)
  WHEN spectrum_id % 3 = 1 THEN concat('smiles:C', mol_id) ELSE concat('source_id:', mol_id) END AS group_key
FROM spectra""", "spectra")
def _(d):
    k = F.col("spectrum_id") % 3
    return d.spectra.select("spectrum_id", N.group_key(
        F.when(k == 0, F.lower("inchikey")), F.when(k == 1, F.concat(F.lit(" C"), F.col("mol_id").cast("string"))),
        F.col("mol_id")).alias("group_key"))


@query("s05_split_rows", f"SELECT spectrum_id FROM spectra WHERE {split_sql(U64)} = 'val'", "spectra")
def _(d):
    split = S.split_name(S.uniform_hash(F.col("group_key"), 42))
    return group_of(d.spectra).filter(split == "val").select("spectrum_id")


@query("s06_uniform_sample", """
SELECT spectrum_id FROM spectra ORDER BY sha1(concat('7|', spectrum_id)), spectrum_id LIMIT 100""", "spectra")
def _(d):
    return S.sample_n(d.spectra.select("spectrum_id"), "spectrum_id", 100, 7)


def bucket_sql(x, edges):
    whens = " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"CASE WHEN {x} IS NULL THEN -1 {whens} ELSE {len(edges) - 2} END"


PRECURSOR_EDGES = [0.0, 200.0, 400.0, 700.0, 1000.0, 1500.0001]
CE_EDGES = [0.0, 10.0, 20.0, 35.0, 50.0, 70.0, 1e9]
STRATA_SQL = f"""n AS (SELECT s.spectrum_id, s.precursor_mz, {NCE_SQL} AS ce, ln(1 + coalesce(c.n, 0)) AS size
  FROM spectra s LEFT JOIN (SELECT spectrum_id, count(*) AS n FROM peaks GROUP BY 1) c ON s.spectrum_id = c.spectrum_id),
q AS (SELECT quantile_cont(size, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM n),
e AS (SELECT e[1] AS e0, CASE WHEN e[2] <= e[1] THEN e[1] + 1e-9 ELSE e[2] END AS e1, e[3] AS r2, e[4] AS r3, e[5] AS r4 FROM q),
e2 AS (SELECT e0, e1, CASE WHEN r2 <= e1 THEN e1 + 1e-9 ELSE r2 END AS e2, r3, r4 FROM e),
e3 AS (SELECT e0, e1, e2, CASE WHEN r3 <= e2 THEN e2 + 1e-9 ELSE r3 END AS e3, r4 FROM e2),
e4 AS (SELECT e0, e1, e2, e3, CASE WHEN r4 <= e3 THEN e3 + 1e-9 ELSE r4 END AS e4 FROM e3),
strata AS (SELECT spectrum_id, concat('p', {bucket_sql('precursor_mz', PRECURSOR_EDGES)}, '|ce', {bucket_sql('ce', CE_EDGES)},
  '|f', {bucket_sql('size', ['e0', 'e1', 'e2', 'e3', 'e4'])}) AS stratum FROM n, e4)"""


def with_strata(d):
    sizes = d.peaks.groupBy("spectrum_id").agg(F.count(F.lit(1)).alias("n"))
    rows = d.spectra.join(sizes, "spectrum_id", "left").select(
        "spectrum_id", "precursor_mz", N.nce_value(F.col("ce_raw")).alias("ce"),
        F.log1p(F.coalesce("n", F.lit(0))).alias("size"))
    rows = rows.withColumn("edges", S.quantile_edges(rows, "size", 4).select(F.struct("*")).scalar())
    label = F.concat(
        F.lit("p"), S.bucket_index(F.col("precursor_mz"), PRECURSOR_EDGES).cast("string"),
        F.lit("|ce"), S.bucket_index(F.col("ce"), CE_EDGES).cast("string"),
        F.lit("|f"), S.bucket_index(F.col("size"), [F.col(f"edges.e{i}") for i in range(5)]).cast("string"))
    return rows.select("spectrum_id", label.alias("stratum"))


@query("s07_strata", f"WITH {STRATA_SQL} SELECT spectrum_id, stratum FROM strata", "spectra peaks")
def _(d):
    return with_strata(d)


@query("s08_stratified_pick", f"""
WITH {STRATA_SQL}, z AS (SELECT stratum, count(*) AS n FROM strata GROUP BY 1),
b AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY n DESC, stratum) <= 300 THEN 1 ELSE 0 END AS base FROM z),
c AS (SELECT *, 300 - sum(base) OVER () AS rest, n - base AS cap, sum(n - base) OVER () AS caps, sum(n) OVER () AS total FROM b),
x AS (SELECT *, CASE WHEN caps > 0 THEN rest * (CAST(cap AS double) / caps) ELSE 0 END AS x FROM c),
a AS (SELECT *, least(floor(x), cap) AS fl FROM x),
o AS (SELECT *, CASE WHEN base + fl < n THEN 1 ELSE 0 END AS open, rest - sum(fl) OVER () AS spare FROM a),
al AS (SELECT stratum, CASE WHEN total <= 300 THEN n ELSE base + fl + CASE WHEN open = 1 AND
   row_number() OVER (ORDER BY open DESC, x - fl DESC, stratum DESC) <= spare THEN 1 ELSE 0 END END AS alloc FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha1(concat('11|', spectrum_id)), spectrum_id) AS rn FROM strata)
SELECT spectrum_id, r.stratum FROM r JOIN al ON r.stratum = al.stratum WHERE rn <= alloc""", "spectra peaks")
def _(d):
    return S.stratified_pick(with_strata(d), "spectrum_id", 300, 11).select("spectrum_id", "stratum")


@query("s09_epoch_subset", """
WITH r AS (SELECT spectrum_id, row_number() OVER (ORDER BY spectrum_id) - 1 AS position, count(*) OVER () AS n FROM spectra)
SELECT spectrum_id, position FROM r WHERE (((position - 700 * 25) % n) + n) % n < 700""", "spectra")
def _(d):
    return S.epoch_subset(d.spectra.select("spectrum_id"), "spectrum_id", 700, 25).select("spectrum_id", "position")


@query("s10_set_operations", f"""
WITH {bins_sql('a', 'peaks')}, {bins_sql('b', 'pred_peaks')}, x AS (SELECT spectrum_id, bin FROM a), y AS (SELECT spectrum_id, bin FROM b)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM x UNION SELECT * FROM y)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)""", "peaks pred_peaks")
def _(d):
    a, b = true_bins(d).select("spectrum_id", "bin"), pred_bins(d).select("spectrum_id", "bin")
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n") for n, df in ops.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s11_worst_spectra", """
SELECT spectrum_id, round(sum(intensity), 6) AS total FROM peaks GROUP BY 1 ORDER BY sum(intensity), spectrum_id LIMIT 50""",
       "peaks")
def _(d):
    totals = d.peaks.groupBy("spectrum_id").agg(F.sum("intensity").alias("total"))
    return out(totals.orderBy("total", "spectrum_id").limit(50), "total")


_SU = hash_sql("concat('3|', spectrum_id)")


@query("s12_source_switch", f"""
WITH ids AS (SELECT spectrum_id, max(a) AS a, max(b) AS b FROM (
  SELECT DISTINCT spectrum_id, 1 AS a, 0 AS b FROM cand_peaks WHERE source_flag > 0
  UNION ALL SELECT DISTINCT spectrum_id, 0, 1 FROM cand_peaks WHERE break_depth = 2) GROUP BY 1),
c AS (SELECT *, CASE WHEN {_SU} < 0.5 THEN a = 1 ELSE b = 0 END AS first FROM ids)
SELECT p.spectrum_id, cand_id, round(mz, 6) AS mz, 'first' AS source FROM cand_peaks p JOIN c ON p.spectrum_id = c.spectrum_id
WHERE source_flag > 0 AND first
UNION ALL SELECT p.spectrum_id, cand_id, round(mz, 6), 'second' FROM cand_peaks p JOIN c ON p.spectrum_id = c.spectrum_id
WHERE break_depth = 2 AND NOT first""", "cand_peaks")
def _(d):
    cols = ["spectrum_id", "cand_id", "mz"]
    a = d.cand_peaks.filter("source_flag > 0").select(*cols)
    b = d.cand_peaks.filter("break_depth = 2").select(*cols)
    return out(S.source_switch(a, b, 0.5, 3), "mz")


@query("j01_attach_molecules", """SELECT count(m.mol_id) AS joined, count(*) - count(m.mol_id) AS missed
FROM spectra s LEFT JOIN (SELECT * FROM molecules WHERE mol_id % 29 <> 0) m ON s.mol_id = m.mol_id""", "spectra molecules")
def _(d):
    _, counts = P.attach_molecules(d.spectra.select("spectrum_id", "mol_id"), d.molecules.filter("mol_id % 29 <> 0").select("mol_id"))
    return counts


@query("j02_soft_match_flags", """SELECT s.mol_id % 41 = 0 AS renamed, CASE WHEN s.mol_id % 7 = 0 OR m.mol_id IS NULL THEN NULL ELSE s.mol_id % 41 <> 0 END AS soft_name_match,
  CASE WHEN m.mol_id IS NULL THEN NULL ELSE s.mol_id % 37 <> 0 END AS soft_inchikey_match, count(*) AS n
FROM spectra s LEFT JOIN (SELECT * FROM molecules WHERE mol_id % 29 <> 0) m ON s.mol_id = m.mol_id GROUP BY ALL""", "spectra molecules")
def _(d):
    k = F.col("mol_id")
    mol = d.molecules.filter(k % 29 != 0).select("mol_id", F.concat(F.lit("mol "), (k + F.when(k % 41 == 0, 1).otherwise(0)).cast("string")).alias("mol_name"),
                                                 F.when(k % 37 == 0, "other").otherwise(F.lower("inchikey")).alias("mol_inchikey"))
    spectra = d.spectra.select("spectrum_id", "mol_id", "inchikey", F.when(k % 7 != 0, F.concat(F.lit("Mol-"), k.cast("string"))).alias("name"))
    rows, _ = P.attach_molecules(spectra, mol)
    return P.soft_match_flags(rows, "name", "mol_name").groupBy(
        (k % 41 == 0).alias("renamed"), "soft_name_match", "soft_inchikey_match").agg(F.count(F.lit(1)).alias("n"))
