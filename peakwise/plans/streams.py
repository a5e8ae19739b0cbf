"""Queries for streams (everything available is processed) and for the SQL functions."""

from pyspark.sql import functions as F

from peakwise.functions import normalize as N
from peakwise.functions import spectrum as S
from peakwise.functions.registry import register
from peakwise.operators import transforms as T
from peakwise.plans.inputs import library_path
from peakwise.plans.policies import U64, split_sql
from peakwise.plans.registry import query
from peakwise.plans.spectra import BINNED_SQL, out
from peakwise.session import scratch_dir
from peakwise.skew import r6
from peakwise.streaming import streams as ST


def event_stream(d):
    schema = d.table("events").schema
    rows = ST.table_stream(d.spark, d.sf_dir, schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant; sessions run in UTC


def means(stream):
    rows = ST.run_available(stream)
    return rows.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        *[c for c in rows.columns if c not in ("window_start", "window_end", "mean")], r6("mean").alias("mean"))


@query("t01_binned_file_stream", f"WITH {BINNED_SQL} SELECT spectrum_id, bin, round(intensity, 6) AS intensity FROM binned", "peaks")
def _(d):
    rows = ST.run_available(ST.bin_stream(ST.msp_stream(d.spark, library_path(d))))
    return out(rows.groupBy("spectrum_id", "bin").agg(F.sum("intensity").alias("intensity")), "intensity")


@query("t01_binned_event_stream", """
SELECT user_id AS spectrum_id, CAST(floor(value / 0.01 + 1e-8) AS bigint) AS bin, count(*) AS n FROM events WHERE value > 0 AND value < 1005 GROUP BY 1, 2""")
def _(d):
    rows = event_stream(d).select(F.col("user_id").alias("spectrum_id"), F.col("value").alias("mz"), F.lit(1.0).alias("intensity")).filter("mz > 0 AND mz < 1005")
    done = ST.run_available(ST.bin_stream(rows))
    return done.groupBy("spectrum_id", "bin").agg(F.count(F.lit(1)).alias("n"))


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("t02_tumbling_means", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type, value FROM events)
SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM w
GROUP BY 1, 2, 3 HAVING s + INTERVAL 1 HOUR <= {CLOSED}""")
def _(d):
    return means(ST.windowed_means(event_stream(d), "ts", "event_type", "value", "10 minutes", "1 hour"))


@query("t02_sliding_means", f"""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 30 MINUTE AS s, event_type, value FROM events, (VALUES (0), (1)) v(o))
SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM w
GROUP BY 1, 2, 3 HAVING s + INTERVAL 1 HOUR <= {CLOSED}""")
def _(d):
    return means(ST.windowed_means(event_stream(d), "ts", "event_type", "value", "10 minutes", "1 hour", "30 minutes"))


@query("t02_session_means", f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(value) AS n, round(avg(value), 6) AS mean FROM s
GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def _(d):
    return means(ST.windowed_means(event_stream(d), "ts", "user_id", "value", "10 minutes", "30 minutes", session=True))


@query("t03_repeated_conditions", """SELECT DISTINCT sha1(concat('{"event_type":"', event_type, '","precursor_mz":"', format('{:.4f}', round(CAST(user_id AS double), 4)), '"}')) AS content_key FROM events""")
def _(d):
    key = N.content_key(F.col("user_id").cast("double"), event_type=F.col("event_type"))
    return ST.run_available(ST.drop_repeated_conditions(event_stream(d), "ts", key, "3650 days")).select("content_key")


@query("t03_expiring_conditions", """WITH RECURSIVE e AS (SELECT sha1(concat('{"event_type":"', event_type, '","precursor_mz":"', format('{:.4f}', round(CAST(user_id AS double), 4)), '"}')) AS content_key, ts FROM events),
p AS (SELECT content_key, min(ts) AS ts FROM e GROUP BY 1
  UNION ALL SELECT e.content_key, min(e.ts) FROM p JOIN e ON e.content_key = p.content_key AND e.ts >= p.ts + INTERVAL 2 DAY GROUP BY e.content_key, p.ts)
SELECT content_key, ts FROM p""")
def _(d):
    """A condition passes again once two days have gone by since it last passed."""
    key = N.content_key(F.col("user_id").cast("double"), event_type=F.col("event_type"))
    rows = ST.run_available(ST.suppress_repeats(event_stream(d), "ts", key, 2 * 86400, "10 minutes"))
    return rows.select("content_key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("t04_idempotent_sink", "SELECT event_id, user_id FROM events")
def _(d):
    """The same stream is delivered twice; every event is stored once."""
    path = scratch_dir(d.spark, "sink")
    for _ in range(2):
        ST.run_available(event_stream(d).select("event_id", "user_id"), writer=ST.idempotent_writer(path, ["event_id"]))
    return d.spark.read.parquet(path).drop("batch_id")


@query("t05_stream_library_match", """SELECT event_id, e.user_id AS spectrum_id, round(mz, 6) AS library_mz FROM events e
JOIN (SELECT DISTINCT spectrum_id, mz FROM peaks) p ON p.spectrum_id = e.user_id AND abs(e.value - mz) < 25""", "peaks")
def _(d):
    library = d.peaks.select("spectrum_id", F.col("mz").alias("library_mz")).distinct()
    rows = event_stream(d).select("event_id", F.col("user_id").alias("spectrum_id"), F.col("value").alias("mz"))
    return out(ST.run_available(ST.match_library(rows, library, ["spectrum_id"], 25.0)).drop("mz"), "library_mz")


@query("t06_stream_stream_join", """SELECT a.event_id AS spectrum_event, b.event_id AS prediction_event, a.user_id FROM events a JOIN events b ON a.user_id = b.user_id
AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def _(d):
    left = event_stream(d).filter("event_type = 'view'").select(F.col("event_id").alias("spectrum_event"), "user_id", F.col("ts").alias("spectrum_ts"))
    right = event_stream(d).filter("event_type = 'click'").select(F.col("event_id").alias("prediction_event"), "user_id", F.col("ts").alias("prediction_ts"))
    rows = ST.pair_streams(left, right, "user_id", "spectrum_ts", "prediction_ts", "2 hours", "10 minutes")
    return ST.run_available(rows).select("spectrum_event", "prediction_event", "user_id")


@query("u01_sql_functions_on_peaks", """SELECT CAST(floor(mz / 0.01 + 1e-8) AS bigint) AS bin, count(*) AS n, round(max((floor(mz / 0.01 + 1e-8) + 0.5) * 0.01), 6) AS mz FROM peaks GROUP BY 1""", "peaks")
def _(d):
    register(d.spark)
    d.peaks.createOrReplaceTempView("ms_peaks")
    return d.spark.sql("SELECT bin, count(*) AS n, round(max(ms_bin_mz(bin, 0.01D)), 6) AS mz FROM (SELECT ms_bin(mz, 0.01D) AS bin FROM ms_peaks) GROUP BY bin")


@query("u02_sql_functions_on_formulas", """SELECT p_partkey AS formula_id, p_size AS n_c, (2 * p_size + 2 + p_partkey % 4 - (2 * p_size + 2) - CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END) / 2.0 AS dbe,
  round(p_size * 12.0 + (2 * p_size + 2) * 1.00782503223 + (p_partkey % 4) * 14.00307400443 + (p_partkey % 6) * 15.99491461957 + CASE WHEN p_partkey % 11 = 0 THEN 34.968852682 ELSE 0 END, 6) AS mass FROM part""")
def _(d):
    register(d.spark)
    d.formulas.createOrReplaceTempView("ms_formulas")
    return d.spark.sql("SELECT formula_id, ms_element_count(formula, 'C') AS n_c, ms_dbe(formula) AS dbe, round(ms_exact_mass(formula), 6) AS mass FROM ms_formulas")


@query("u03_sql_functions_on_spectra", f"""SELECT {split_sql(U64)} AS split, CASE adduct_raw WHEN 'M+H' THEN '[M+H]+' WHEN '[m + na]+' THEN '[M+Na]+' ELSE '[M+NH4]+' END AS adduct,
  count(*) AS n, round(avg(precursor_mz * 30 / 500.0), 6) AS ev FROM spectra GROUP BY 1, 2""", "spectra")
def _(d):
    register(d.spark)
    d.spectra.createOrReplaceTempView("ms_spectra")
    return d.spark.sql("""SELECT ms_split(concat('inchikey:', inchikey), 42) AS split, ms_adduct(adduct_raw) AS adduct, count(*) AS n,
      round(avg(ms_nce_to_ev(30D, precursor_mz, 1)), 6) AS ev FROM ms_spectra GROUP BY 1, 2""")


@query("u04_table_function_on_peak_lines", """WITH li AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 100.0, 6) AS mz, CAST(l_quantity AS DOUBLE) AS i FROM lineitem)
SELECT l_orderkey AS spectrum_id, l_linenumber AS line_no, l_partkey AS part, 0 AS peak_no, mz, i AS intensity FROM li
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 1, mz, 7.5 FROM li WHERE l_linenumber = 2""")
def _(d):
    register(d.spark)
    mz, i, k = (F.col("l_extendedprice") / 100.0).cast("string"), F.col("l_quantity").cast("string"), F.col("l_linenumber")
    line = F.concat(mz, F.lit(" "), i, F.when(k == 2, F.concat(F.lit('; rest ; '), mz, F.lit(" 7.5;"))).otherwise(F.lit(' "C2H5=p-CO 3/9"')))
    lines = d.table("lineitem").select(F.col("l_orderkey").alias("spectrum_id"), k.alias("line_no"), F.col("l_partkey").alias("part"), line.alias("line"))
    lines.withColumn("line", F.replace("line", F.lit(" rest ;"), F.lit(""))).createOrReplaceTempView("ms_lines")
    return d.spark.sql("SELECT spectrum_id, line_no, part, p.peak_no, round(p.mz, 6) AS mz, p.intensity FROM ms_lines, LATERAL ms_peaks_of(line) AS p")


@query("u05_table_function_on_formulas", """SELECT element, sum(n)::BIGINT AS n, count(*) AS formulas FROM (
  SELECT 'C' AS element, p_size AS n FROM part UNION ALL SELECT 'H', 2 * p_size + 2 FROM part
  UNION ALL SELECT 'N', p_partkey % 4 FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT 'O', p_partkey % 6 FROM part WHERE p_partkey % 6 > 0
  UNION ALL SELECT 'Cl', 1 FROM part WHERE p_partkey % 11 = 0) GROUP BY 1""")
def _(d):
    register(d.spark)
    d.formulas.createOrReplaceTempView("ms_formulas")
    return d.spark.sql("SELECT a.element, sum(a.n) AS n, count(*) AS formulas FROM ms_formulas, LATERAL ms_atoms_of(formula) AS a GROUP BY a.element")


@query("u06_table_function_on_spectra", f"WITH {BINNED_SQL} SELECT spectrum_id, bin, round(intensity, 6) AS intensity FROM binned", "peaks")
def _(d):
    register(d.spark)
    # In order: Spark evaluates the arrays once for the lateral call and once to join its rows back, and both must agree.
    on_axis = S.is_peak(F.col("mz"), F.col("intensity")) & S.bin_index(F.col("mz")).between(0, S.last_bin())
    arrays = d.peaks.filter(on_axis).groupBy("spectrum_id").agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    arrays.select("spectrum_id", F.transform("p", lambda x: x["mz"]).alias("mzs"), F.transform("p", lambda x: x["intensity"]).alias("intensities")
                  ).createOrReplaceTempView("ms_arrays")
    return d.spark.sql("SELECT spectrum_id, b.bin, round(b.intensity, 6) AS intensity FROM ms_arrays, LATERAL ms_bins_of(mzs, intensities, 0.01D) AS b")
