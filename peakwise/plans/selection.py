"""Queries for candidate selection."""

from pyspark.sql import functions as F

from peakwise.operators import formulas as C
from peakwise.operators import selection as K
from peakwise.operators import transforms as T
from peakwise.plans.quality import true_bins
from peakwise.plans.registry import query
from peakwise.plans.spectra import CAND_BINS_SQL, out

RANK = "row_number() OVER (PARTITION BY spectrum_id ORDER BY {0})"


@query("k01_plain_topk", f"""
SELECT spectrum_id, cand_id, {RANK.format('score DESC, cand_id')} AS rank FROM candidates QUALIFY rank <= 2""", "candidates")
def _(d):
    return K.plain_topk(d.candidates, 2).select("spectrum_id", "cand_id", "rank")


BEST_SQL = """b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY spectrum_id, group_id ORDER BY score DESC, cand_id) = 1
  THEN 1 ELSE 0 END AS best FROM candidates)"""


@query("k02_group_unique_topk", f"""WITH {BEST_SQL}
SELECT spectrum_id, cand_id, {RANK.format('best DESC, score DESC, cand_id')} AS rank FROM b QUALIFY rank <= 3""", "candidates")
def _(d):
    return K.group_unique_topk(d.candidates, 3).select("spectrum_id", "cand_id", "rank")


@query("k03_group_unique_mask", f"""WITH {BEST_SQL}
SELECT spectrum_id, cand_id FROM b WHERE best = 1 QUALIFY {RANK.format('score DESC, cand_id')} <= 3""", "candidates")
def _(d):
    return K.group_unique_topk(d.candidates, 3, fill=False).select("spectrum_id", "cand_id")


@query("k04_group_max_softmax", """
WITH c AS (SELECT *, score / 25.0 AS s FROM candidates), g AS (SELECT *, max(s) OVER (PARTITION BY spectrum_id, group_id) AS gm FROM c),
w AS (SELECT *, CASE WHEN s >= gm - 1e-6 THEN 1 ELSE 0 END AS win FROM g),
n AS (SELECT spectrum_id, group_id, max(gm) AS gm, sum(win) AS n FROM w GROUP BY 1, 2),
z AS (SELECT *, exp(gm) / sum(exp(gm)) OVER (PARTITION BY spectrum_id) / n AS p FROM n)
SELECT w.spectrum_id, cand_id, round(CASE WHEN win = 1 THEN p ELSE 0 END, 6) AS prob FROM w JOIN z
  ON w.spectrum_id = z.spectrum_id AND w.group_id = z.group_id""", "candidates")
def _(d):
    cands = d.candidates.withColumn("score", F.col("score") / 25.0)
    return out(K.group_max_softmax(cands).select("spectrum_id", "cand_id", "prob"), "prob")


@query("k05_active_pool", f"""
WITH s AS (SELECT spectrum_id, cand_id, array_to_string(list_sort(list_distinct(list(CAST(floor(mz / 200 + 1e-8) AS bigint)))), ',') AS sig
  FROM cand_peaks WHERE mz <= 2000 GROUP BY 1, 2),
c AS (SELECT c.*, sig FROM candidates c LEFT JOIN s ON c.spectrum_id = s.spectrum_id AND c.cand_id = s.cand_id),
n AS (SELECT spectrum_id, count(*) AS n FROM c WHERE source_flag > 0 GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, sig ORDER BY score DESC, cand_id) AS br FROM c WHERE sig IS NOT NULL),
a AS (SELECT b.spectrum_id, b.cand_id, row_number() OVER (PARTITION BY b.spectrum_id ORDER BY score DESC, b.cand_id) AS rn, coalesce(n.n, 0) AS n
  FROM b LEFT JOIN n ON b.spectrum_id = n.spectrum_id WHERE br = 1 AND source_flag <= 0)
SELECT spectrum_id, cand_id FROM c WHERE source_flag > 0 UNION ALL SELECT spectrum_id, cand_id FROM a WHERE rn <= 3 - n""", "candidates")
def _(d):
    sig = C.support_signatures(T.bin_spectra(d.cand_peaks, ["spectrum_id", "cand_id"], 200.0, 2000.0))
    return K.active_pool(d.candidates, sig, 3)


def records(d):
    """Source records: a part is a formula, a supplier a molecule."""
    li = d.table("lineitem")
    return li.select(
        (F.col("l_suppkey") % 50).alias("mol_id"), (F.col("l_partkey") % 40).alias("formula"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(12,2)")).alias("rec"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), F.col("l_tax").alias("local"),
        (F.col("l_returnflag") == "A").cast("int").alias("brics"), (F.col("l_linenumber") % 4).alias("h_abs"),
        (F.col("l_linenumber") % 3 + 1).alias("source_type"), F.col("l_quantity").alias("atoms"),
        F.floor(F.col("l_extendedprice") / 5000.0).alias("bin"))


RECORDS_SQL = """rec AS (SELECT l_suppkey % 50 AS mol_id, l_partkey % 40 AS formula,
  concat_ws(':', l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS decimal(12, 2))) AS rec, l_orderkey * 8 + l_linenumber AS key, l_tax AS local,
  CAST(l_returnflag = 'A' AS int) AS brics, l_linenumber % 4 AS h_abs, l_linenumber % 3 + 1 AS source_type, l_quantity AS atoms,
  CAST(floor(l_extendedprice / 5000.0) AS bigint) AS bin FROM lineitem)"""


@query("k06_instance_cap", f"""WITH {RECORDS_SQL},
a AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY mol_id, formula ORDER BY brics DESC, local DESC, h_abs, source_type, rec) <= 3)
SELECT mol_id, formula, rec FROM a QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY brics DESC, local DESC, h_abs, source_type, rec) <= 60""")
def _(d):
    order = [F.col("brics"), F.col("local"), -F.col("h_abs"), -F.col("source_type")]
    return K.instance_cap(records(d), "mol_id", "formula", order, "rec", 3, 60).select("mol_id", "formula", "rec")


_O = "brics DESC, local DESC, h_abs DESC, atoms DESC"


def _best(src):
    return f"SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY mol_id, key ORDER BY {_O}, bin DESC, source_type DESC) = 1"


@query("k07_bin_quota", f"""WITH {RECORDS_SQL},
b0 AS (SELECT * FROM rec WHERE source_type IN (1, 2)), b1 AS ({_best('b0')}),
b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY mol_id, bin ORDER BY {_O}, key) <= 2),
b AS (SELECT * FROM b2 QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY {_O}, key) <= 20),
r0 AS (SELECT * FROM rec WHERE source_type = 3 AND NOT EXISTS (SELECT 1 FROM b WHERE b.mol_id = rec.mol_id AND b.key = rec.key)), r1 AS ({_best('r0')}),
r2 AS (SELECT r1.*, row_number() OVER (PARTITION BY r1.mol_id, r1.bin ORDER BY {_O}, key) + coalesce(u.n, 0) AS q FROM r1 LEFT JOIN
  (SELECT mol_id, bin, count(*) AS n FROM b GROUP BY 1, 2) u ON u.mol_id = r1.mol_id AND u.bin = r1.bin),
r3 AS (SELECT * FROM r2 WHERE q <= 2),
r AS (SELECT r3.* FROM r3 LEFT JOIN (SELECT mol_id, count(*) AS n FROM b GROUP BY 1) x ON x.mol_id = r3.mol_id
  QUALIFY row_number() OVER (PARTITION BY r3.mol_id ORDER BY {_O}, key) <= least(15, 40 - coalesce(x.n, 0))),
ch AS (SELECT mol_id, key, bin, source_type, 'base' AS stage FROM b UNION ALL SELECT mol_id, key, bin, source_type, 'recursive' FROM r),
f0 AS (SELECT * FROM rec WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.mol_id = rec.mol_id AND ch.key = rec.key)), f1 AS ({_best('f0')}),
f AS (SELECT f1.* FROM f1 LEFT JOIN (SELECT mol_id, count(*) AS n FROM ch GROUP BY 1) x ON x.mol_id = f1.mol_id
  QUALIFY row_number() OVER (PARTITION BY f1.mol_id ORDER BY {_O}, key) <= 40 - coalesce(x.n, 0))
SELECT * FROM ch UNION ALL SELECT mol_id, key, bin, source_type, 'fill' FROM f""")
def _(d):
    order = [F.col("brics"), F.col("local"), F.col("h_abs"), F.col("atoms")]
    return K.bin_quota(records(d), "mol_id", "key", order, 40, 20, 15, 2, 2)


def capped(d):
    extra = d.cand_peaks.groupBy("spectrum_id", "cand_id").agg(
        F.max("mz").alias("max_mass"), F.sum("intensity").alias("total_intensity"))
    return d.candidates.join(extra, ["spectrum_id", "cand_id"]).withColumn("plausibility", F.col("prior"))


CAPPED_SQL = """x AS (SELECT c.spectrum_id, c.cand_id, c.prior AS plausibility, e.max_mass, e.total, count(*) OVER (PARTITION BY c.spectrum_id) AS n
  FROM candidates c JOIN (SELECT spectrum_id, cand_id, max(mz) AS max_mass, sum(intensity) AS total FROM cand_peaks GROUP BY 1, 2) e
  ON c.spectrum_id = e.spectrum_id AND c.cand_id = e.cand_id)"""
_MODES = {"head": "cand_id", "mass": "max_mass DESC, cand_id", "intensity": "total DESC, cand_id", "plausibility": "plausibility DESC, cand_id",
          "fallback": "total + 1e-4 * max_mass DESC, cand_id",
          "random": "sha1(concat('5|', spectrum_id, ':', cand_id)) DESC, cand_id"}

for _mode, _order in _MODES.items():
    query(f"k08_overflow_{_mode}", f"WITH {CAPPED_SQL} SELECT spectrum_id, cand_id, CAST(n > 3 AS int) AS overflow FROM x "
          f"QUALIFY {RANK.format(_order)} <= 3", "candidates")(
        lambda d, m=_mode: K.overflow_cap(capped(d), 3, m, 5).select("spectrum_id", "cand_id", "overflow"))


@query("k08_overflow_error_rows", f"""WITH {CAPPED_SQL} SELECT spectrum_id, cand_id, CAST(n > 6 AS int) AS overflow,
  CASE WHEN n > 6 THEN concat('pool of ', n, ' exceeds 6') END AS error FROM x""", "candidates")
def _(d):
    return K.overflow_cap(capped(d), 6, "raise").select("spectrum_id", "cand_id", "overflow", "error")


def unit_cand_bins(d):
    """Candidate peaks in 50 Da bins, so that candidates overlap."""
    return T.bin_spectra(d.cand_peaks, ["spectrum_id", "cand_id"], 50.0, 2000.0)


CELLS_SQL = """cells AS (SELECT spectrum_id, cand_id, CAST(floor(mz / 50.0 + 1e-8) AS bigint) AS bin, sum(intensity) AS intensity
  FROM cand_peaks WHERE intensity > 0 AND floor(mz / 50.0 + 1e-8) BETWEEN 0 AND 40 GROUP BY ALL)"""
TRUE_SQL = """true_cells AS (SELECT spectrum_id, CAST(floor(mz / 50.0 + 1e-8) AS bigint) AS bin, sum(intensity) AS intensity
  FROM peaks WHERE intensity > 0 AND floor(mz / 50.0 + 1e-8) BETWEEN 0 AND 40 GROUP BY ALL)"""


def greedy_sql(entries: str, steps: int, gain: str, marks: dict[str, str], ties: str, block: bool = False,
               min_steps: int | None = None, min_new: str = "0") -> str:
    """Common table expressions for greedy steps over ``entries``; the picks are in ``{entries}_picks``.

    ``gain``: what a row adds, over its columns and those of ``marks`` (name -> aggregate over rows of picks, 0 before).
    """
    e, parts, done = entries, [], f"SELECT spectrum_id, cand_id, 0 AS step FROM {entries} WHERE false"
    state = ", ".join(f"{how} AS {m}" for m, how in marks.items())
    zero = ", ".join(f"coalesce({m}, 0) AS {m}" for m in marks)
    unmarked = " AND ".join(f"{m} = 0" for m in marks)
    for n in range(1, steps + 1):
        stop = " AND gain > 0" if min_steps is not None and n > min_steps else ""
        blocked = (f"CASE WHEN EXISTS (SELECT 1 FROM {e}_d{n} d JOIN {e} x ON d.spectrum_id = x.spectrum_id AND d.cand_id = x.cand_id "
                   f"WHERE x.spectrum_id = r.spectrum_id AND x.group_id = r.group_id) THEN 0 ELSE 1 END") if block else "1"
        parts.append(f"""{e}_d{n} AS ({done}),
{e}_s{n} AS (SELECT spectrum_id, bin, {state} FROM {e} JOIN {e}_d{n} USING (spectrum_id, cand_id) GROUP BY 1, 2),
{e}_r{n} AS (SELECT x.*, {zero} FROM {e} x LEFT JOIN {e}_s{n} USING (spectrum_id, bin) ANTI JOIN {e}_d{n} USING (spectrum_id, cand_id)),
{e}_g{n} AS (SELECT r.*, {blocked} AS opened FROM (
  SELECT spectrum_id, cand_id, {'max(group_id) AS group_id, ' if block else ''}round(sum({gain}) + max(fixed), 9) AS gain,
         {', '.join(f'max({t}) AS {t}' for t in ties.split())} FROM {e}_r{n}
  GROUP BY 1, 2 HAVING count(*) FILTER ({unmarked}) >= {min_new}) r),
{e}_p{n} AS (SELECT spectrum_id, cand_id, {n} AS step FROM {e}_g{n} WHERE true{stop}
  QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY opened DESC, gain DESC, {', '.join(f'{t} DESC' for t in ties.split())}, cand_id) = 1)""")
        done = f"SELECT * FROM {e}_d{n} UNION ALL SELECT * FROM {e}_p{n}"
    return ",\n".join(parts) + f",\n{e}_picks AS ({done})"


@query("k09_coverage_aware_topk", f"""WITH {CELLS_SQL},
t AS (SELECT spectrum_id, cand_id, greatest(sum(intensity), 1e-8) AS total, max(intensity) AS top FROM cells GROUP BY 1, 2),
st AS (SELECT spectrum_id, greatest(coalesce(stddev_samp(score), 0), 1e-6) AS spread, quantile_disc(score, 0.5) AS middle FROM candidates GROUP BY 1),
has AS (SELECT spectrum_id FROM t GROUP BY 1),
e AS (SELECT c.spectrum_id, c.cand_id, coalesce(bin, -1) AS bin, coalesce(intensity / total, 0) AS share, coalesce(intensity / top, 0) AS seen, score,
        CASE WHEN has.spectrum_id IS NULL THEN score ELSE 0.2 * least(greatest((score - middle) / spread, -5), 5) END AS fixed,
        CASE WHEN has.spectrum_id IS NULL THEN c.cand_id ELSE group_id END AS group_id
      FROM candidates c JOIN st USING (spectrum_id) LEFT JOIN t USING (spectrum_id, cand_id) LEFT JOIN has ON has.spectrum_id = c.spectrum_id
      LEFT JOIN cells x ON x.spectrum_id = c.spectrum_id AND x.cand_id = c.cand_id),
{greedy_sql('e', 3, 'share * (0.1 - (0.35 + 0.1) * covered)', {'covered': 'max(seen)'}, 'score', block=True)}
SELECT spectrum_id, cand_id, step FROM e_picks""", "candidates")
def _(d):
    return K.coverage_aware_topk(d.candidates, unit_cand_bins(d), 3)


@query("k10_setcover_teacher", f"""WITH {CELLS_SQL}, {TRUE_SQL},
s AS (SELECT spectrum_id, cand_id, bin, intensity / greatest(sum(intensity) OVER (PARTITION BY spectrum_id, cand_id), 1e-8) AS share FROM cells),
tr AS (SELECT spectrum_id, bin, intensity / greatest(sum(intensity) OVER (PARTITION BY spectrum_id), 1e-8) AS ts,
        row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) <= 20 AS top FROM true_cells),
m AS (SELECT s.*, coalesce(ts, 0) AS ts, CASE WHEN top THEN 1.0 ELSE 0.0 END AS is_top, CASE WHEN ts > 0 THEN 1.0 ELSE 0.0 END AS support
      FROM s LEFT JOIN tr USING (spectrum_id, bin)),
b AS (SELECT spectrum_id, cand_id, round(sum((4.0 * ts + support + 2.0 * is_top - (1.0 - support)) * share), 9) AS base,
             -0.8 * sum(share * (1 - support)) AS fixed FROM m GROUP BY 1, 2),
e AS (SELECT spectrum_id, cand_id, bin, base, fixed, share * ts AS tm, share * is_top AS pm FROM m JOIN b USING (spectrum_id, cand_id)),
{greedy_sql('e', 4, '3.0 * tm - (3.0 + 0.3) * tm * least(ct, 1) + 1.5 * pm * (1 - least(cp, 1))', {'ct': 'sum(tm)', 'cp': 'sum(pm)'}, 'base', min_steps=2)},
w AS (SELECT p.*, greatest(base, 0) AS x FROM e_picks p JOIN b USING (spectrum_id, cand_id))
SELECT spectrum_id, cand_id, step, round(CASE WHEN sum(x) OVER (PARTITION BY spectrum_id) > 0 THEN x / sum(x) OVER (PARTITION BY spectrum_id)
  ELSE 1.0 / count(*) OVER (PARTITION BY spectrum_id) END, 6) AS probability FROM w""", "cand_peaks peaks")
def _(d):
    return out(K.setcover_teacher(unit_cand_bins(d), true_bins(d, bin_width=50.0, max_mz=2000.0), 4, 2), "probability")


REGIONS = (("low", 0.0, 300.0, 1), ("mid", 300.0, 600.0, 1), ("high", 600.0, 2000.0, 2))


def _region_sql(i: int, name: str, lo: float, hi: float, budget: int) -> str:
    """Cover and fill of one region, after the candidates chosen in ``ch{i}``; those chosen then are in ``ch{i + 1}``."""
    e = f"x{i}"
    room = f"5 - coalesce((SELECT count(*) FROM {{0}} c WHERE c.spectrum_id = {{1}}.spectrum_id), 0)"
    return f"""in{i} AS (SELECT * FROM bins WHERE bin BETWEEN {int(lo / 50)} AND {int(hi / 50) - 1}),
{e} AS (SELECT spectrum_id, cand_id, bin, base_score AS tie, -first AS early, 0.0 AS fixed FROM in{i} b ANTI JOIN ch{i} USING (spectrum_id, cand_id)
  WHERE NOT EXISTS (SELECT 1 FROM in{i} o JOIN ch{i} c ON o.spectrum_id = c.spectrum_id AND o.cand_id = c.cand_id WHERE o.spectrum_id = b.spectrum_id AND o.bin = b.bin)),
{greedy_sql(e, budget, '1.0 - covered', {'covered': 'max(1)'}, 'tie early', min_new='1')},
cov{i} AS (SELECT spectrum_id, cand_id FROM {e}_picks p WHERE step <= {room.format(f'ch{i}', 'p')}),
mid{i} AS (SELECT * FROM ch{i} UNION ALL SELECT spectrum_id, cand_id, '{name}' FROM cov{i}),
rest{i} AS (SELECT DISTINCT spectrum_id, cand_id, base_score FROM in{i} ANTI JOIN mid{i} USING (spectrum_id, cand_id)),
more{i} AS (SELECT * FROM (SELECT *, {RANK.format('base_score DESC, cand_id')} AS rank FROM rest{i}) r
  WHERE rank <= {budget} - (SELECT count(*) FROM cov{i} c WHERE c.spectrum_id = r.spectrum_id) AND rank <= {room.format(f'mid{i}', 'r')}),
ch{i + 1} AS (SELECT * FROM mid{i} UNION ALL SELECT spectrum_id, cand_id, '{name}_fill' FROM more{i})"""


@query("k11_region_set_cover", f"""WITH {CELLS_SQL},
n AS (SELECT spectrum_id, cand_id, count(*) AS peak_n FROM cand_peaks GROUP BY 1, 2),
sc AS (SELECT c.spectrum_id, c.cand_id, 5.0 * CAST(source_flag > 0 AS int) + prior + 0.03 * peak_n - 0.08 * least(greatest(break_depth, 0), 10) AS base_score,
         count(*) OVER (PARTITION BY c.spectrum_id) AS n FROM candidates c JOIN n ON n.spectrum_id = c.spectrum_id AND n.cand_id = c.cand_id),
big AS (SELECT * FROM sc WHERE n > 5),
bins AS (SELECT spectrum_id, cand_id, bin, base_score, min(bin) OVER (PARTITION BY spectrum_id, cand_id) AS first FROM cells JOIN big USING (spectrum_id, cand_id)),
ch0 AS (SELECT spectrum_id, cand_id, 'source' AS stage FROM big QUALIFY {RANK.format('base_score DESC, cand_id')} <= 1),
{', '.join(_region_sql(i, *r) for i, r in enumerate(REGIONS))},
fill AS (SELECT * FROM (SELECT spectrum_id, cand_id, {RANK.format('base_score DESC, cand_id')} AS rank FROM big ANTI JOIN ch3 USING (spectrum_id, cand_id)) r
  WHERE rank <= 5 - (SELECT count(*) FROM ch3 c WHERE c.spectrum_id = r.spectrum_id))
SELECT spectrum_id, cand_id, 'whole' AS stage, 0 AS left_out FROM sc WHERE n <= 5
UNION ALL SELECT spectrum_id, cand_id, stage, n - 5 FROM (SELECT * FROM ch3 UNION ALL SELECT spectrum_id, cand_id, 'fill' FROM fill) JOIN big USING (spectrum_id, cand_id)
""", "cand_peaks candidates")
def _(d):
    n = d.cand_peaks.groupBy("spectrum_id", "cand_id").agg(F.count(F.lit(1)).alias("peak_n"))
    score = K.region_base_score(F.col("source_flag"), F.lit(0), F.col("prior"), F.col("peak_n"), F.col("break_depth"), F.lit(0))
    cands = d.candidates.join(n, ["spectrum_id", "cand_id"]).withColumn("base_score", score)
    return K.region_set_cover(cands, unit_cand_bins(d), 5, 1, REGIONS, 50.0)


@query("k12_marginal_coverage", f"""WITH {CELLS_SQL}, {TRUE_SQL}, {CAPPED_SQL},
sig AS (SELECT spectrum_id, cand_id, list(bin ORDER BY bin) AS bins, count(*) AS n_bins, sum(intensity) AS total FROM cells GROUP BY 1, 2),
tr AS (SELECT spectrum_id, bin, sqrt(intensity) + 0.8 + CASE WHEN row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, bin) <= 20 THEN 1.2 ELSE 0 END AS weight,
         CASE WHEN count(*) OVER (PARTITION BY spectrum_id) <= 4 THEN 1 ELSE 2 END AS min_hit FROM true_cells),
hits AS (SELECT spectrum_id, cand_id, bin, weight, min_hit FROM cells JOIN tr USING (spectrum_id, bin)),
sc AS (SELECT spectrum_id, cand_id, max(min_hit) AS min_hit, round(sum(weight) + 0.35 * max(plausibility), 9) AS gain, max(plausibility) AS plausibility
       FROM hits JOIN x USING (spectrum_id, cand_id) GROUP BY 1, 2 HAVING count(*) >= max(min_hit)),
un AS (SELECT sc.*, total + 0.05 * n_bins AS tie, first FROM sc JOIN sig USING (spectrum_id, cand_id)
       JOIN (SELECT spectrum_id, cand_id, min(bin) AS first FROM hits GROUP BY 1, 2) USING (spectrum_id, cand_id)
       QUALIFY row_number() OVER (PARTITION BY spectrum_id, bins ORDER BY gain DESC, cand_id) = 1),
fits AS (SELECT *, count(*) OVER (PARTITION BY spectrum_id) AS fit_n FROM un),
e AS (SELECT h.spectrum_id, h.cand_id, h.bin, h.weight, h.min_hit, 0.35 * plausibility AS fixed, tie, -first AS early
      FROM hits h JOIN fits f ON f.spectrum_id = h.spectrum_id AND f.cand_id = h.cand_id WHERE fit_n > 3),
{greedy_sql('e', 3, 'weight * (1 - covered)', {'covered': 'max(1)'}, 'tie early', min_new='max(min_hit)')},
rest AS (SELECT * FROM (SELECT spectrum_id, cand_id, {RANK.format('gain DESC, cand_id')} AS rank FROM fits ANTI JOIN e_picks USING (spectrum_id, cand_id) WHERE fit_n > 3) r
  WHERE rank <= 3 - (SELECT count(*) FROM e_picks p WHERE p.spectrum_id = r.spectrum_id))
SELECT spectrum_id, cand_id FROM fits WHERE fit_n <= 3 UNION ALL SELECT spectrum_id, cand_id FROM e_picks UNION ALL SELECT spectrum_id, cand_id FROM rest
""", "cand_peaks candidates peaks")
def _(d):
    return K.marginal_coverage_cap(capped(d), unit_cand_bins(d), true_bins(d, bin_width=50.0, max_mz=2000.0), 3, True)
