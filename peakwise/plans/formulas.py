"""Queries for the formula algebra, isotopes, lookups and candidate features."""

from pyspark.sql import functions as F

from peakwise import constants as K
from peakwise.functions import formula as FX
from peakwise.functions import normalize as N
from peakwise.functions import spectrum as S
from peakwise.operators import formulas as C
from peakwise.operators import transforms as T
from peakwise.plans.policies import FPARTS_SQL, U64, parent_pairs, split_sql
from peakwise.plans.quality import bins_sql, true_bins
from peakwise.plans.registry import query
from peakwise.plans.spectra import CAND_BINS_SQL, out
from peakwise.session import cut_lineage
from peakwise.skew import r6

MASS = K.ISOTOPE_MASS
PAIRS_SQL = f"""{FPARTS_SQL}, pr AS (SELECT a.k, a.c, a.h, a.n, a.o, a.cl, a.mass, b.c AS pc, b.h AS ph, b.n AS pn, b.o AS po,
  b.cl AS pcl, b.mass AS pmass FROM fm a JOIN fm b ON b.k = a.k + 3)"""


def piece(symbol, n, explicit=False):
    number = f"CAST({n} AS varchar)"
    shown = number if explicit else f"CASE WHEN {n} = 1 THEN '' ELSE {number} END"
    return f"CASE WHEN {n} > 0 THEN concat('{symbol}', {shown}) ELSE '' END"


def text_sql(order, names, explicit=False):
    return "concat(" + ", ".join(piece(e, names[e], explicit) for e in order) + ")"


OWN = {"C": "c", "H": "h", "N": "n", "O": "o", "Cl": "cl"}
HILL = ["C", "H", "Cl", "N", "O"]


@query("c01_formula_counts", f"WITH {FPARTS_SQL} SELECT k AS formula_id, c, h, n, o, cl FROM fp")
def _(d):
    m = F.col("m")
    got = lambda e, a: F.coalesce(m[e], F.lit(0)).alias(a)
    return d.formulas.withColumn("m", FX.counts(F.col("formula"))).select(
        "formula_id", got("C", "c"), got("H", "h"), got("N", "n"), got("O", "o"), got("Cl", "cl"))


def odd_formulas(d):
    k = F.col("formula_id")
    f = F.col("formula")
    odd = F.when(k % 5 == 0, F.concat(f, F.lit("+H"))).when(k % 5 == 1, F.concat(f, F.lit("C2"))).when(
        k % 5 == 2, F.concat(f, F.lit("(x)"))).when(k % 5 == 3, F.concat(f, F.lit("-H2O"))).otherwise(f)
    return d.formulas.select("formula_id", odd.alias("formula"))


@query("c02_strict_parse", f"""WITH {FPARTS_SQL}
SELECT k AS formula_id, CASE k % 5 WHEN 1 THEN 'repeated element' WHEN 2 THEN 'invalid token' END AS error,
  CASE WHEN k % 5 NOT IN (1, 2) THEN c END AS n_c FROM fp""")
def _(d):
    f = F.col("formula")
    return odd_formulas(d).select("formula_id", FX.strict_error(f).alias("error"), FX.strict_counts(f)["C"].alias("n_c"))


@query("c03_formula_styles", f"""WITH {FPARTS_SQL}
SELECT k AS formula_id, {text_sql(HILL, OWN)} AS hill, {text_sql(['C', 'Cl', 'H', 'N', 'O'], OWN)} AS alphabetic,
  {text_sql(['H', 'C', 'N', 'O', 'Cl'], OWN)} AS canonical, {text_sql(['C', 'Cl', 'H', 'N', 'O'], OWN, True)} AS explicit_one FROM fp""")
def _(d):
    m = FX.counts(F.col("formula"))
    return d.formulas.select("formula_id", FX.hill(m).alias("hill"), FX.alphabetic(m).alias("alphabetic"),
                             FX.canonical(m).alias("canonical"), FX.alphabetic(m, True).alias("explicit_one"))


DIFF = {"C": "pc - c", "H": "ph - h", "N": "pn - n", "O": "po - o", "Cl": "pcl - cl"}
DIFF = {e: f"({x})" for e, x in DIFF.items()}
FITS = "pc >= c AND ph >= h AND pn >= n AND po >= o AND pcl >= cl"
SUMS = {e: f"({OWN[e]} + p{OWN[e]})" for e in OWN}


@query("c04_subtract_combine", f"""WITH {PAIRS_SQL}
SELECT k AS formula_id, CASE WHEN {FITS} THEN {text_sql(HILL, DIFF)} ELSE '' END AS difference,
  {text_sql(HILL, SUMS)} AS total FROM pr""")
def _(d):
    p, f = F.col("parent_formula"), F.col("formula")
    return parent_pairs(d).select("formula_id", FX.subtract(p, f).alias("difference"),
                                  FX.hill(FX.combine(FX.counts(p), FX.counts(f))).alias("total"))


_ADD = list(K.ADDUCT_MASS_SHIFT)


@query("c05_ion_mz", f"""WITH {FPARTS_SQL}
SELECT k AS formula_id, round(mass, 6) AS exact_mass, round(mass + CASE k % {len(_ADD)} {' '.join(
    f'WHEN {i} THEN {K.ADDUCT_MASS_SHIFT[a]!r}' for i, a in enumerate(_ADD))} END + (k % 3) * {K.NEUTRON_MASS}, 6) AS mz FROM fm""")
def _(d):
    k, f = F.col("formula_id"), F.col("formula")
    adduct = F.element_at(F.array(*[F.lit(a) for a in _ADD]), (k % len(_ADD) + 1).cast("int"))
    return d.formulas.select("formula_id", r6(FX.exact_mass(f)).alias("exact_mass"),
                             r6(FX.ion_mz(f, adduct, k % 3)).alias("mz"))


ANNOTATION_SQL = """CASE k % 5 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"""


def annotations(d):
    k = F.col("formula_id")
    text = F.element_at(F.array(*[F.lit(x) for x in ("p-H2O", "p-2CH2+2i", "p+i", "C5H5N", "p-NH3-CO^2")]),
                        (k % 5 + 1).cast("int"))
    return d.formulas.select("formula_id", "formula", text.alias("text"))


@query("c06_parse_annotation", f"""WITH {FPARTS_SQL}
SELECT k AS formula_id, {ANNOTATION_SQL.format('c', 'c - 2', 'c', '5', 'c - 1')} AS n_c,
  {ANNOTATION_SQL.format('h - 2', 'h - 4', 'h', '5', 'h - 3')} AS n_h, {ANNOTATION_SQL.format('o - 1', 'o', 'o', '0', 'o - 1')} AS n_o,
  {ANNOTATION_SQL.format("'H2O'", "'2CH2'", "''", "''", "'NH3,CO'")} AS losses,
  {ANNOTATION_SQL.format(0, 2, 1, 0, 0)} AS isotope, {ANNOTATION_SQL.format(1, 1, 1, 1, 2)} AS charge FROM fp""")
def _(d):
    rows = annotations(d).withColumn("a", FX.parse_annotation(F.col("text"), F.col("formula")))
    n = lambda e: F.coalesce(F.col("a.formula")[e], F.lit(0))
    return rows.select("formula_id", n("C").alias("n_c"), n("H").alias("n_h"), n("O").alias("n_o"),
                       F.array_join("a.losses", ",").alias("losses"), "a.isotope", "a.charge")


def annotated_texts(d):
    """Peaks with quoted annotations; one in 97 spectra carries a bad one."""
    f = d.formulas.select(F.col("formula_id").alias("l_partkey"), "formula")
    rows = d.table("lineitem").join(f, "l_partkey")
    bad = (F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1)
    text = F.when(bad, F.lit("p-H2O/1ppm;y3 5/9")).otherwise(
        F.concat(F.lit("p-"), F.when(F.col("l_linenumber") % 2 == 0, "H2O").otherwise("CO2"), F.lit("/-0.3ppm 12/12;? 3/9")))
    return rows.select(F.col("l_orderkey").alias("spectrum_id"), F.col("l_linenumber").alias("peak_no"),
                       (F.col("l_extendedprice") / 100.0).alias("mz"), text.alias("annotation"))


def ion_formulas(d):
    f = d.formulas.select(F.col("formula_id").alias("fid"), F.col("formula").alias("ion_formula"))
    return d.spectra.select("spectrum_id", (F.pmod(F.col("mol_id"), F.lit(150)) + 1).alias("fid")).join(f, "fid", "left")


@query("c07_annotation_table", f"""WITH {FPARTS_SQL}, bad AS (
  SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 97 = 0 AND l_linenumber = 1),
r AS (SELECT l_orderkey AS spectrum_id, l_linenumber AS peak_no, l_extendedprice / 100.0 AS mz, f.* FROM lineitem l
  JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN fm f ON f.k = o.o_custkey % 150 + 1
  WHERE l_orderkey NOT IN (SELECT l_orderkey FROM bad)),
x AS (SELECT *, CASE WHEN peak_no % 2 = 0 THEN 0 ELSE 1 END AS lc, CASE WHEN peak_no % 2 = 0 THEN 2 ELSE 0 END AS lh,
  CASE WHEN peak_no % 2 = 0 THEN 1 ELSE 2 END AS lo FROM r)
SELECT spectrum_id, peak_no, round(mz, 6) AS mz, round(mass - lc * 12.0 - lh * {MASS['H']} - lo * {MASS['O']}, 6) AS exact_mz,
  CASE WHEN lh > 0 THEN 'H2O1' ELSE 'C1O2' END AS loss, 0 AS isotope, 1 AS charge FROM x""")
def _(d):
    table, _ = C.annotation_table(annotated_texts(d), ion_formulas(d))
    return out(table.drop("product"), "mz", "exact_mz")


@query("c07_rejected_spectra", """
SELECT DISTINCT l_orderkey AS spectrum_id, 'invalid term' AS error FROM lineitem WHERE l_orderkey % 97 = 0 AND l_linenumber = 1""")
def _(d):
    return C.annotation_table(annotated_texts(d), ion_formulas(d))[1]


@query("c08_unsaturation", f"""WITH {FPARTS_SQL}
SELECT k AS formula_id, (2 * c + 2 + n - h - cl) / 2.0 AS dbe, CAST(2 * c + 2 + n - h - cl < 0 AS int) AS negative,
  abs(2 * c + 2 + n - h - cl) % 2 AS odd, cl AS halogens FROM fp""")
def _(d):
    f, num = F.col("formula"), FX.dbe_numerator(F.col("formula"))
    return d.formulas.select("formula_id", FX.dbe(f).alias("dbe"), (num < 0).cast("int").alias("negative"),
                             F.pmod(F.abs(num), F.lit(2)).alias("odd"), FX.halogens(f).alias("halogens"))


POISSON_SQL = """lam AS (SELECT *, h * 0.00015 + c * 0.0107 + n * 0.00364 + o * 0.00038 AS l1, o * 0.00205 + cl * 0.2422 AS l2 FROM fm),
raw AS (SELECT k, mass, 0 AS j, 1.0 AS w FROM lam UNION ALL SELECT k, mass, 1, l1 FROM lam
  UNION ALL SELECT k, mass, 2, l1 ** 2 / 2 + l2 FROM lam UNION ALL SELECT k, mass, 3, l1 ** 3 / 6 + l1 * l2 FROM lam
  UNION ALL SELECT k, mass, 4, l1 ** 4 / 24 + l1 ** 2 / 2 * l2 + l2 ** 2 / 2 FROM lam
  UNION ALL SELECT k, mass, 5, l1 ** 5 / 120 + l1 ** 3 / 6 * l2 + l1 * l2 ** 2 / 2 FROM lam),
env AS (SELECT k, j, mass + j * 1.0033548378 AS mz, w / sum(w) OVER (PARTITION BY k) AS p FROM raw)"""


@query("c09_candidate_descriptors", f"""WITH {PAIRS_SQL}, {POISSON_SQL},
bn AS (SELECT k, CAST(floor(mz + 1e-8) AS bigint) AS bin, sum(p) AS x FROM env GROUP BY ALL),
sh AS (SELECT k, bin - min(bin) OVER (PARTITION BY k) AS s, x / sum(x) OVER (PARTITION BY k) AS p FROM bn),
iso AS (SELECT k, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS e, sum(CASE WHEN s = 0 THEN p ELSE 0 END) AS m0,
  sum(CASE WHEN s = 1 THEN p ELSE 0 END) AS m1, sum(CASE WHEN s = 2 THEN p ELSE 0 END) AS m2 FROM sh WHERE p > 0 GROUP BY k)
SELECT pr.k AS formula_id, c + h + n + o + cl AS atoms, CAST(c > 0 AS int) + CAST(h > 0 AS int) + CAST(n > 0 AS int) + CAST(o > 0 AS int)
  + CAST(cl > 0 AS int) AS elements, round(mass, 6) AS mass, (2 * c + 2 + n - h - cl) / 2.0 AS dbe,
  CAST(2 * c + 2 + n - h - cl < 0 AS int) AS negative_dbe, abs(2 * c + 2 + n - h - cl) % 2 AS odd_dbe,
  round(greatest(pmass - mass, 0), 6) AS loss_mass, greatest(pc - c, 0) + greatest(ph - h, 0) + greatest(pn - n, 0)
  + greatest(po - o, 0) + greatest(pcl - cl, 0) AS loss_atoms, CAST(pc > c AS int) + CAST(ph > h AS int) + CAST(pn > n AS int)
  + CAST(po > o AS int) + CAST(pcl > cl AS int) AS loss_elements, cl AS halogens, round(e, 6) AS isotope_entropy, round(m0, 6) AS m0,
  round(m1, 6) AS m1, round(m2, 6) AS m2, round(abs(pmass - mass), 6) AS precursor_gap FROM pr JOIN iso ON pr.k = iso.k""")
def _(d):
    env = C.poisson_envelope(d.formulas, "formula_id")
    bins = env.groupBy("formula_id", S.bin_index(F.col("mz"), 1.0).alias("bin")).agg(F.sum("intensity").alias("intensity"))
    rows = C.candidate_descriptors(parent_pairs(d), ["formula_id"], bins)
    return out(rows, "mass", "loss_mass", "isotope_entropy", "m0", "m1", "m2", "precursor_gap")


ELEMENTS = ["C", "H", "N", "O", "Cl"]
SPACE_SQL = "(c + 1) * (h + 1) * (n + 1) * (o + 1) * (cl + 1)"


@query("c10_subformulas", f"""WITH {FPARTS_SQL}
SELECT k AS formula_id, {SPACE_SQL} AS n, round({SPACE_SQL} * mass / 2, 3) AS mass_sum, round(mass, 6) AS heaviest
FROM fm""")
def _(d):
    # Molecules of one formula have the same sub-formulas: every text is enumerated once.
    texts = d.formulas.select("formula", F.col("formula").alias("text")).distinct()
    rows, _ = C.enumerate_subformulas(texts, "text", ELEMENTS)
    found = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("mass"), 3).alias("mass_sum"),
                                     r6(F.max("mass")).alias("heaviest"))
    return d.formulas.join(found, F.col("formula") == F.col("text")).drop("formula", "text")


@query("c11_search_space", f"WITH {FPARTS_SQL} SELECT k AS formula_id, {SPACE_SQL} AS search_space, {SPACE_SQL} > 50000 AS refused FROM fp")
def _(d):
    size = FX.search_space(F.col("formula"), ELEMENTS)
    return d.formulas.select("formula_id", size.alias("search_space"), (size > 50000).alias("refused"))


_CHANNELS = [(e, p, delta) for e, p, _, delta in K.ISOTOPE_CHANNELS if e in OWN]
_CH_VALUES = ", ".join(f"({i}, '{e}', {p}, {dm!r})" for i, (e, p, dm) in enumerate(_CHANNELS))


@query("c12_isotope_envelope", f"""WITH {FPARTS_SQL}, ch(i, e, p, d) AS (VALUES {_CH_VALUES}),
ns AS (SELECT e, 1 - sum(p) AS q FROM ch GROUP BY e), chr AS (SELECT i, ch.e, p / q AS r, d FROM ch JOIN ns ON ch.e = ns.e),
base AS (SELECT k, mass, exp(h * ln((SELECT q FROM ns WHERE e = 'H')) + c * ln((SELECT q FROM ns WHERE e = 'C')) + n * ln((SELECT q FROM ns WHERE e = 'N'))
  + o * ln((SELECT q FROM ns WHERE e = 'O')) + cl * ln((SELECT q FROM ns WHERE e = 'Cl'))) AS p0, c, h, n, o, cl FROM fm),
one AS (SELECT k, mass, p0, i, e, r, d, CASE e WHEN 'H' THEN h WHEN 'C' THEN c WHEN 'N' THEN n WHEN 'O' THEN o ELSE cl END AS x FROM base, chr),
t AS (SELECT k, mass AS mz, p0 AS w, -1 AS a, -1 AS b FROM base UNION ALL SELECT k, mass + d, p0 * x * r, i, -1 FROM one
  UNION ALL SELECT u.k, u.mass + u.d + v.d, u.p0 * CASE WHEN u.i = v.i THEN 0.5 * u.x * (u.x - 1) WHEN u.e = v.e THEN u.x * (u.x - 1.0)
    ELSE u.x * v.x END * u.r * v.r, u.i, v.i FROM one u JOIN one v ON u.k = v.k AND u.i <= v.i),
kept AS (SELECT * FROM t WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY w DESC, a, b) <= 6)
SELECT k AS formula_id, round(sum(w) OVER (PARTITION BY k) / sum(w) OVER (PARTITION BY k) * mz, 6) AS mz,
  round(w / sum(w) OVER (PARTITION BY k), 6) AS intensity FROM kept""")
def _(d):
    return out(C.isotope_envelope(d.formulas, "formula_id", 6).drop("peak_no"), "mz", "intensity")


@query("c13_poisson_envelope", f"""WITH {FPARTS_SQL}, {POISSON_SQL}
SELECT k AS formula_id, j AS peak_no, round(mz, 6) AS mz, round(p, 6) AS intensity FROM env""")
def _(d):
    return out(C.poisson_envelope(d.formulas, "formula_id"), "mz", "intensity")


_LOSS_COUNTS = {"H2O": (0, 2, 0, 1, 0), "NH3": (0, 3, 1, 0, 0), "CO": (1, 0, 0, 1, 0), "CO2": (1, 0, 0, 2, 0), "CH2O": (1, 2, 0, 1, 0),
                "HCN": (1, 1, 1, 0, 0), "C2H4": (2, 4, 0, 0, 0), "H2S": (0, 2, 0, 0, 1), "SO2": (0, 0, 0, 2, 1), "CH4": (1, 4, 0, 0, 0),
                "C2H2": (2, 2, 0, 0, 0), "C2H6": (2, 6, 0, 0, 0), "NO": (0, 0, 1, 1, 0), "NO2": (0, 0, 1, 2, 0)}
_LOSS_VALUES = ", ".join(f"('{x}', {', '.join(map(str, v))})" for x, v in _LOSS_COUNTS.items())
_PRIOR_HIT = " OR ".join(f"(pc - c = {v[0]} AND ph - h = {v[1]} AND pn - n = {v[2]} AND po - o = {v[3]} AND pcl = cl AND {v[4]} = 0)"
                         for x, v in _LOSS_COUNTS.items() if x in K.PRIOR_LOSSES)
_NEAR = ", ".join(f"abs(greatest(pmass - mass, 0) - {m})" for m in K.PRIOR_LOSS_MASSES)
PRIOR_SQL = f"""(CASE WHEN 2 * c + 2 + n - h - cl < 0 THEN -2.0 ELSE 0.8 END + 1.2 * exp(-pow(least({_NEAR}), 2) / (2 * 0.8 * 0.8))
  + CASE WHEN {_PRIOR_HIT} THEN 1.0 ELSE 0.0 END - 0.5 * least(abs(pmass - mass) / greatest(pmass + {K.PROTON_MASS}, 1e-6), 1.0))"""


def _scored(d):
    rows = parent_pairs(d).withColumn("precursor_mz", FX.exact_mass(F.col("parent_formula")) + K.PROTON_MASS)
    return C.prior_score(rows)


@query("c14_prior_score", f"WITH {PAIRS_SQL} SELECT k AS formula_id, round({PRIOR_SQL}, 6) AS prior_score FROM pr")
def _(d):
    return out(_scored(d).select("formula_id", "prior_score"), "prior_score")


@query("c15_plausibility", f"""WITH {PAIRS_SQL}
SELECT k AS formula_id, round({PRIOR_SQL} + CASE k % 4 WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 WHEN 3 THEN 2.6 ELSE 0 END
  + CASE k % 6 WHEN 1 THEN 0.8 WHEN 2 THEN 0.55 WHEN 3 THEN 0.35 WHEN 0 THEN 0.0 ELSE 0.2 END - CASE WHEN k % 3 = 0 THEN 0.4 ELSE 0 END
  + 0.05 * ln(1 + k % 5) - CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0 END, 6) AS score FROM pr""")
def _(d):
    k = F.col("formula_id")
    score = C.plausibility(F.col("prior_score"), k % 4, k % 6, (k % 3 == 0).cast("int"), k % 5)
    return _scored(d).select("formula_id", r6(score).alias("score"))


@query("c16_support_signature", f"""WITH {bins_sql('x', 'peaks')}, s AS (
  SELECT spectrum_id, cand_id, array_to_string(list_sort(list_distinct(list(CAST(floor(mz / 50 + 1e-8) AS bigint)))), ',') AS sig
  FROM cand_peaks GROUP BY 1, 2)
SELECT spectrum_id, count(*) AS n_candidates, count(DISTINCT sig) AS n_signatures FROM s GROUP BY 1""", "cand_peaks peaks")
def _(d):
    bins = T.bin_spectra(d.cand_peaks, ["spectrum_id", "cand_id"], 50.0, 2000.0)
    return C.support_signatures(bins).groupBy("spectrum_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_distinct("signature").alias("n_signatures"))


@query("c17_coverage_score", f"""WITH {bins_sql('b', 'pred_peaks')}, {CAND_BINS_SQL},
s AS (SELECT c.spectrum_id, c.cand_id, v.x, sum(coalesce(b.intensity * c.intensity, 0)) AS s FROM cand_bins c
  CROSS JOIN (VALUES (-1), (0), (1)) v(x) LEFT JOIN b ON b.spectrum_id = c.spectrum_id AND b.bin = c.bin + v.x GROUP BY 1, 2, 3)
SELECT spectrum_id, cand_id, round(greatest(max(s), 0), 6) AS coverage_score FROM s GROUP BY 1, 2""", "pred_peaks cand_peaks")
def _(d):
    return out(C.coverage_score(T.bin_candidates(d.cand_peaks, None), T.bin_spectra(d.pred_peaks), 1), "coverage_score")


@query("c18_peak_summary", f"""WITH {CAND_BINS_SQL}, a AS (SELECT spectrum_id, cand_id, count(*) AS n, sum(intensity) AS s, max(intensity) AS hi,
  avg((bin + 0.5) * 0.01) AS m, stddev_pop((bin + 0.5) * 0.01) AS sd FROM cand_bins GROUP BY 1, 2),
e AS (SELECT c.spectrum_id, c.cand_id, -sum(intensity / s * ln(intensity / s)) AS e FROM cand_bins c
  JOIN a ON a.spectrum_id = c.spectrum_id AND a.cand_id = c.cand_id GROUP BY 1, 2)
SELECT a.spectrum_id, a.cand_id, n / 32.0 AS count, round(s, 6) AS total, round(hi, 6) AS largest, round(e / ln(32), 6) + 0.0 AS entropy,
  round(m / 1500, 6) AS mz_mean, round(sd / 300, 6) AS mz_std, round(m / precursor_mz, 6) AS relative_center,
  round(greatest(precursor_mz - m, 0) / precursor_mz, 6) AS relative_gap
FROM a JOIN e ON a.spectrum_id = e.spectrum_id AND a.cand_id = e.cand_id JOIN spectra p ON p.spectrum_id = a.spectrum_id""",
       "cand_peaks spectra")
def _(d):
    rows = C.peak_summary(T.bin_candidates(d.cand_peaks, None), d.spectra)
    return out(rows, "total", "largest", "entropy", "mz_mean", "mz_std", "relative_center", "relative_gap")


_MODES = ", ".join(f"('{n}', {m!r})" for n, m in C.ION_MODES)


@query("c19_loss_events", f"""WITH {PAIRS_SQL}, md(mode, shift) AS (VALUES {_MODES})
SELECT k AS formula_id, mode, round(mass + shift, 6) AS mz, CAST(floor((mass + shift) / 0.01 + 1e-8) AS bigint) AS bin,
  round(greatest(pmass - mass, 0), 6) AS loss_mass, round(abs(pmass + {K.PROTON_MASS} - (mass + shift)), 6) AS precursor_gap
FROM pr, md WHERE mass + shift > 0 AND mass + shift < 1005""")
def _(d):
    rows = parent_pairs(d).withColumn("precursor_mz", FX.exact_mass(F.col("parent_formula")) + K.PROTON_MASS)
    return out(C.loss_events(rows, ["formula_id"]), "mz", "loss_mass", "precursor_gap")


@query("c20_peak_features", f"""WITH {CAND_BINS_SQL}
SELECT c.spectrum_id, cand_id, bin, round((bin + 0.5) * 0.01 / 1500, 9) AS mz_scaled, round((bin + 0.5) * 0.01 / precursor_mz, 6) AS mz_relative,
  round(greatest(precursor_mz - (bin + 0.5) * 0.01, 0) / precursor_mz, 6) AS gap_relative, round(intensity, 6) AS intensity,
  round(ln(1 + intensity), 6) AS log_intensity, 1 AS valid FROM cand_bins c JOIN spectra s ON s.spectrum_id = c.spectrum_id""",
       "cand_peaks spectra")
def _(d):
    rows = C.peak_features(T.bin_candidates(d.cand_peaks, None), d.spectra)
    return out(rows, "mz_relative", "gap_relative", "intensity", "log_intensity").withColumn("mz_scaled", r6("mz_scaled", 9))


SUBSETS_SQL = """members AS (SELECT l_orderkey AS spectrum_id, l_partkey % 4 + 10 * z AS subset_id,
  CASE WHEN l_linenumber = 5 THEN -1 ELSE CAST(floor(l_extendedprice / 100.0 / 0.01 + 1e-8) AS bigint) END AS bin,
  CASE WHEN l_linenumber = 4 THEN NULL WHEN l_linenumber = 6 THEN 0.0 ELSE CAST(l_quantity AS double) END AS intensity
  FROM lineitem, (VALUES (0), (1)) v(z) WHERE z = 0 OR l_quantity > 20)"""


@query("c20_subset_summaries", f"""WITH {SUBSETS_SQL},
v AS (SELECT spectrum_id, subset_id, CASE WHEN bin >= 0 AND intensity > 0 THEN intensity END AS x, CASE WHEN bin >= 0 AND intensity > 0 THEN (bin + 0.5) * 0.01 END AS mz FROM members),
a AS (SELECT spectrum_id, subset_id, count(x) AS n, coalesce(sum(x), 0) AS s, coalesce(max(x), 0) AS hi, sum(x * ln(x)) AS xl,
  coalesce(avg(mz), 0) AS mean, coalesce(stddev_pop(mz), 0) AS std FROM v GROUP BY 1, 2)
SELECT a.spectrum_id, subset_id, round(n / 32.0, 6) AS count, round(s, 6) AS total, round(hi, 6) AS largest,
  round(CASE WHEN n > 0 THEN (ln(s) - xl / s) / ln(8.0) ELSE 0 END, 6) + 0.0 AS entropy, round(mean / 1500, 6) AS mz_mean, round(std / 300, 6) AS mz_std,
  round(mean / greatest(precursor_mz, 1e-6), 6) AS relative_center, round(greatest(precursor_mz - mean, 0) / greatest(precursor_mz, 1e-6), 6) AS relative_gap
FROM a JOIN spectra USING (spectrum_id)""", "spectra")
def _(d):
    """Two overlapping families of subsets: by part, and of the strong peaks by part; some peaks are not valid."""
    li, k = d.table("lineitem"), F.col("l_linenumber")
    mz = S.bin_index(F.col("l_extendedprice") / 100.0)
    families = F.when(F.col("l_quantity") > 20, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    members = li.select(
        F.col("l_orderkey").alias("spectrum_id"), F.explode(families).alias("z"), (F.col("l_partkey") % 4).alias("part"),
        F.when(k == 5, -1).otherwise(mz).alias("bin"), F.when(k == 6, 0.0).when(k != 4, F.col("l_quantity").cast("double")).alias("intensity"))
    rows = C.subset_peak_summary(members.withColumn("subset_id", F.col("part") + 10 * F.col("z")), d.spectra, peak_slots=8)
    return out(rows, "count", "total", "largest", "entropy", "mz_mean", "mz_std", "relative_center", "relative_gap")


# ---- formula joins ----


@query("j10_formula_lookup", f"""WITH {PAIRS_SQL}, pool AS (SELECT c, h, n, o, cl, min(k) AS pool_key, count(*) AS pool_n FROM fp GROUP BY ALL)
SELECT pr.k AS formula_id, pool_key, pool_n FROM pr LEFT JOIN pool p
  ON pr.c + pc = p.c AND pr.h + ph = p.h AND pr.n + pn = p.n AND pr.o + po = p.o AND pr.cl + pcl = p.cl""")
def _(d):
    m = FX.combine(FX.counts(F.col("formula")), FX.counts(F.col("parent_formula")))
    return C.formula_lookup(parent_pairs(d), m, d.formulas, "formula_id").select("formula_id", "pool_key", "pool_n")


@query("j11_common_losses", f"""WITH {FPARTS_SQL}, pool AS (SELECT c, h, n, o, cl, min(k) AS pool_key, count(*) AS pool_n FROM fp GROUP BY ALL),
ls(l, lc, lh, ln_, lo, s) AS (VALUES {_LOSS_VALUES}), sh(x) AS (SELECT unnest(range(-3, 4))),
t AS (SELECT DISTINCT k, c - lc AS c, h - lh + x AS h, n - ln_ AS n, o - lo AS o, cl FROM fp, ls, sh
  WHERE s = 0 AND c >= lc AND h >= lh AND n >= ln_ AND o >= lo AND h - lh + x >= 0)
SELECT t.k AS formula_id, pool_key, pool_n FROM t JOIN pool p ON t.c = p.c AND t.h = p.h AND t.n = p.n AND t.o = p.o AND t.cl = p.cl""")
def _(d):
    return C.common_loss_lookup(d.formulas, "formula_id", d.formulas, "formula_id").drop("canonical")


def annotated_peaks(d):
    """Peaks with one or two formulas from the part they point at, and their parent formula."""
    f = d.formulas
    one = f.select(F.col("formula_id").alias("l_partkey"), F.col("formula").alias("f1"))
    two = f.select((F.col("formula_id") - 1).alias("l_partkey"), F.col("formula").alias("f2"))
    rows = d.table("lineitem").join(one, "l_partkey").join(two, "l_partkey", "left")
    lists = F.when((F.col("l_linenumber") % 2 == 0) & F.col("f2").isNotNull(), F.array("f1", "f2")).otherwise(F.array("f1"))
    rows = rows.select(F.col("l_orderkey").alias("spectrum_id"), F.col("l_linenumber").alias("peak_no"),
                       (F.col("l_extendedprice") / 100.0).alias("mz"), F.col("l_quantity").alias("intensity"), lists.alias("formulas"))
    return rows.join(ion_formulas(d).withColumnRenamed("ion_formula", "parent_formula"), "spectrum_id").join(
        d.spectra.select("spectrum_id", "inchikey", "mol_id"), "spectrum_id")


ANNOTATED_SQL = f"""{FPARTS_SQL}, an0 AS (SELECT l_orderkey AS spectrum_id, l_linenumber AS peak_no, l_extendedprice / 100.0 AS mz,
  l_quantity AS intensity, l_partkey AS k1, CASE WHEN l_linenumber % 2 = 0 AND f2.k IS NOT NULL THEN f2.k END AS k2,
  concat('MOL', o_custkey) AS inchikey, o_custkey % 150 + 1 AS pk
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN fp f1 ON f1.k = l_partkey LEFT JOIN fp f2 ON f2.k = l_partkey + 1
  JOIN fp f3 ON f3.k = o_custkey % 150 + 1),
an AS (SELECT spectrum_id, peak_no, mz, inchikey, pk, k1 AS k, intensity / CASE WHEN k2 IS NULL THEN 1 ELSE 2 END AS w FROM an0
  UNION ALL SELECT spectrum_id, peak_no, mz, inchikey, pk, k2, intensity / 2 FROM an0 WHERE k2 IS NOT NULL)"""
LIBRARY_SQL = f"""{ANNOTATED_SQL}, tr AS (SELECT an.*, a.c, a.h, a.n, a.o, a.cl, b.c AS pc, b.h AS ph, b.n AS pn, b.o AS po, b.cl AS pcl
  FROM an JOIN fp a ON a.k = an.k JOIN fp b ON b.k = an.pk WHERE {split_sql(U64)} = 'train'),
lib0 AS (SELECT 'product' AS kind, {text_sql(HILL, OWN)} AS formula, w FROM tr
  UNION ALL SELECT 'neutral_loss', {text_sql(HILL, DIFF)}, w FROM tr WHERE {FITS}),
lib AS (SELECT kind, formula, sum(w) AS intensity, count(*) AS n, greatest(count(*) OVER (PARTITION BY kind) - 100, 0) AS left_out FROM lib0 WHERE formula <> '' GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY sum(w) DESC, formula) <= 100)"""


# The library of all products and losses.
_TOP_100 = "\n  QUALIFY row_number() OVER (PARTITION BY kind ORDER BY sum(w) DESC, formula) <= 100"
LIBRARY_ALL_SQL = LIBRARY_SQL.replace(_TOP_100, "").replace("greatest(count(*) OVER (PARTITION BY kind) - 100, 0)", "0")


def library(d, top=100):
    group = N.group_key(F.col("inchikey"), F.lit(None).cast("string"), F.col("mol_id"))
    # The spelling of a product is its Hill form on both sides.
    return C.annotation_library(annotated_peaks(d), C.train_split(group), top, top, lambda f: FX.hill(FX.counts(f)))


@query("a09_annotation_library", f"""WITH {LIBRARY_SQL}
SELECT kind, formula, round(intensity, 6) AS intensity, n, round(ln(1 + intensity), 6) AS log_intensity, left_out FROM lib""")
def _(d):
    return out(library(d), "intensity", "log_intensity")


@query("a09_annotation_library_all", f"""WITH {LIBRARY_ALL_SQL}
SELECT kind, formula, round(intensity, 6) AS intensity, n, round(ln(1 + intensity), 6) AS log_intensity, left_out FROM lib""")
def _(d):
    return out(library(d, None), "intensity", "log_intensity")


def pool(d):
    f = d.formulas.select(F.col("formula_id").alias("l_partkey"), "formula")
    rows = d.table("lineitem").filter("l_linenumber % 4 > 0").join(f, "l_partkey")
    shift = F.when(F.col("l_linenumber") == 3, 1).otherwise(0)
    return rows.select(F.col("l_orderkey").alias("spectrum_id"), F.col("l_partkey").alias("cand_id"), "formula",
                       ((F.col("l_extendedprice") + shift) / 100.0).alias("mz"))


_FEATURES_SQL = f""", p AS (
  SELECT DISTINCT l_orderkey AS spectrum_id, l_partkey AS cand_id, o_custkey % 150 + 1 AS pk FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_linenumber % 4 > 0),
x AS (SELECT p.spectrum_id, p.cand_id, {text_sql(HILL, OWN)} AS own, CASE WHEN {FITS} THEN {text_sql(HILL, DIFF)} ELSE '' END AS loss FROM (
  SELECT p.*, a.c, a.h, a.n, a.o, a.cl, b.c AS pc, b.h AS ph, b.n AS pn, b.o AS po, b.cl AS pcl FROM p JOIN fp a ON a.k = p.cand_id
  JOIN fp b ON b.k = p.pk) p),
y AS (SELECT x.spectrum_id, x.cand_id, CASE WHEN a.formula IS NULL THEN 0.0 ELSE 1.0 END AS product_hit, coalesce(ln(1 + a.intensity), 0) AS pl,
  CASE WHEN b.formula IS NULL THEN 0.0 ELSE 1.0 END AS loss_hit, coalesce(ln(1 + b.intensity), 0) AS ll FROM x
  LEFT JOIN lib a ON a.kind = 'product' AND a.formula = x.own LEFT JOIN lib b ON b.kind = 'neutral_loss' AND b.formula = x.loss),
s AS (SELECT spectrum_id, quantile_cont(CASE WHEN pl > 0 THEN pl END, 0.95) AS ps, quantile_cont(CASE WHEN ll > 0 THEN ll END, 0.95) AS ls FROM y GROUP BY 1)
SELECT y.spectrum_id, cand_id, product_hit, round(CASE WHEN ps > 1e-8 THEN least(pl / ps, 1) ELSE pl END, 6) AS product_log, loss_hit,
  round(CASE WHEN ls > 1e-8 THEN least(ll / ls, 1) ELSE ll END, 6) AS loss_log,
  (SELECT coalesce(sum(l), 0)::BIGINT FROM (SELECT max(left_out) AS l FROM lib GROUP BY kind)) AS left_out FROM y JOIN s ON y.spectrum_id = s.spectrum_id"""


def with_library_features(d, top=100):
    cands = pool(d).select("spectrum_id", "cand_id", "formula").distinct().join(
        ion_formulas(d).withColumnRenamed("ion_formula", "parent_formula").drop("fid"), "spectrum_id")
    rows = C.library_features(cands, cut_lineage(library(d, top)), ["spectrum_id"])  # a stored table in use
    return out(rows.drop("formula", "parent_formula"), "product_log", "loss_log")


@query("j12_library_features", f"WITH {LIBRARY_SQL}{_FEATURES_SQL}")
def _(d):
    return with_library_features(d)


@query("j12_library_features_all", f"WITH {LIBRARY_ALL_SQL}{_FEATURES_SQL}")
def _(d):
    return with_library_features(d, None)


POOL_SQL = """pool AS (SELECT l_orderkey AS spectrum_id, f.*, (l_extendedprice + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) / 100.0 AS pmz
  FROM lineitem JOIN fp f ON f.k = l_partkey WHERE l_linenumber % 4 > 0)"""


@query("j13_annotation_support", f"""WITH {ANNOTATED_SQL}, {POOL_SQL},
t AS (SELECT an.*, f.c, f.h, f.n, f.o, f.cl FROM an JOIN fp f ON f.k = an.k),
m AS (SELECT t.spectrum_id, t.peak_no, t.mz, t.k, max(CASE WHEN p.spectrum_id IS NULL THEN 0 ELSE 1 END) AS ip,
  max(CASE WHEN floor(p.pmz / 0.01 + 1e-8) = floor(t.mz / 0.01 + 1e-8) THEN 1 ELSE 0 END) AS ib, any_value(w) AS w FROM t LEFT JOIN pool p
  ON p.spectrum_id = t.spectrum_id AND p.c = t.c AND p.h = t.h AND p.n = t.n AND p.o = t.o AND p.cl = t.cl
  GROUP BY t.spectrum_id, t.peak_no, t.mz, t.k),
n AS (SELECT spectrum_id, peak_no, count(*) AS n FROM t GROUP BY 1, 2),
k AS (SELECT m.spectrum_id, m.peak_no, max(ip) AS p, max(ib) AS b FROM m GROUP BY 1, 2)
SELECT k.spectrum_id, count(*) AS annotated_n, sum(n) AS formula_n, round(avg(p), 6) AS in_pool, round(avg(b), 6) AS in_bin
FROM k JOIN n ON k.spectrum_id = n.spectrum_id AND k.peak_no = n.peak_no GROUP BY 1""")
def _(d):
    p = pool(d)
    bins = p.withColumn("bin", S.bin_index(F.col("mz")))
    return out(C.annotation_support(annotated_peaks(d), p, bins), "in_pool", "in_bin")


# Formulas with one text have one class, a whole number: the joins compare no texts.
@query("j14_annotation_mass_delta", f"""WITH {ANNOTATED_SQL}, {POOL_SQL},
nf AS MATERIALIZED (SELECT f.k, f.mass, g.formula, min(f.k) OVER (PARTITION BY g.formula) AS cls FROM fm f JOIN formulas g ON g.formula_id = f.k),
t AS MATERIALIZED (SELECT an.spectrum_id, an.peak_no, an.mz, nf.formula, nf.mass, nf.cls FROM an JOIN nf ON nf.k = an.k),
pf AS MATERIALIZED (SELECT spectrum_id, nf.cls, pmz FROM pool JOIN nf ON nf.k = pool.k),
nr AS MATERIALIZED (SELECT t.spectrum_id, t.peak_no, t.cls, min(abs(pmz - mz)) AS nearest, count(*) AS n FROM t JOIN pf
  ON pf.spectrum_id = t.spectrum_id AND pf.cls = t.cls GROUP BY 1, 2, 3)
SELECT t.spectrum_id, t.peak_no, round(mz, 6) AS mz, t.formula, round(mass, 6) AS neutral_exact, round(mass - {K.ELECTRON_MASS}, 6) AS ion_exact,
  round(mz - (mass - {K.ELECTRON_MASS}), 6) AS delta, round(nearest, 6) AS nearest, n AS candidate_peak_n FROM t LEFT JOIN nr
  ON nr.spectrum_id = t.spectrum_id AND nr.peak_no = t.peak_no AND nr.cls = t.cls""", "formulas")
def _(d):
    rows = C.annotation_mass_delta(annotated_peaks(d), pool(d))
    return out(rows, "mz", "neutral_exact", "ion_exact", "delta", "nearest")


@query("j15_pair_check", f"""WITH {FPARTS_SQL}, l AS (SELECT * FROM fm WHERE k % 7 <> 0), r AS (
  SELECT k, CASE WHEN k % 5 = 0 THEN h + 1 ELSE h END AS h, c, n, o, cl, mass + (k % 3) * 0.001 AS mass FROM fm WHERE k % 8 <> 0)
SELECT coalesce(l.k, r.k) AS formula_id, CASE WHEN l.k IS NULL THEN 'left missing' WHEN r.k IS NULL THEN 'right missing' ELSE 'both' END AS status,
  CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN CAST(l.h = r.h AS int) END AS formula_match, round(r.mass - l.mass, 6) + 0.0 AS exact_mass_delta
FROM l FULL JOIN r ON l.k = r.k""")
def _(d):
    k = F.col("formula_id")
    rows = d.formulas.withColumn("exact_mass", FX.exact_mass(F.col("formula")))
    more = FX.hill(FX.combine(FX.counts(F.col("formula")), FX.counts(F.lit("H"))))
    right = rows.filter(k % 8 != 0).withColumn("formula", F.when(k % 5 == 0, more).otherwise(F.col("formula"))).withColumn(
        "exact_mass", F.col("exact_mass") + (k % 3) * 0.001)
    return out(C.pair_check(rows.filter(k % 7 != 0), right, "formula_id"), "exact_mass_delta")
