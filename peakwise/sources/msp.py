"""Spectral-library text: records, headers, peak lines and annotations.

The reader splits files at the record separator, so a library of any size is
read in parallel and no record passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakwise.functions import normalize as N

_FLOAT = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
PEAK_PAIR = rf"^\s*({_FLOAT})\s+({_FLOAT})\b"
ANNOTATED_PAIR = rf'({_FLOAT})\s+({_FLOAT})\s*("[^"]*")?\s*(?:;|$)'


def _peak(mz: Column, intensity: Column) -> Column:
    return F.struct(mz.try_cast("double").alias("mz"), intensity.try_cast("double").alias("intensity"))


def _usable(p: Column) -> Column:
    inf = float("inf")
    return p["mz"].isNotNull() & p["intensity"].isNotNull() & (p["mz"] >= 0) & (p["mz"] < inf) & (p["intensity"] > 0) & (
        p["intensity"] < inf)


def parse_peak_line(line: Column) -> Column:
    """Peaks of a line: quoted text removed first, then a leading ``mz intensity`` pair per ``;`` part."""
    parts = F.split(F.regexp_replace(line, '"[^"]*"', ""), ";")
    pairs = F.transform(parts, lambda t: _peak(F.regexp_extract(t, PEAK_PAIR, 1), F.regexp_extract(t, PEAK_PAIR, 2)))
    return F.filter(pairs, _usable)


def parse_peak_line_loose(line: Column) -> Column:
    """Audit variant: the first two numbers of every ``;`` part, any separator."""
    numbers = F.transform(F.split(line, ";"), lambda t: F.regexp_extract_all(t, F.lit(_FLOAT), F.lit(0)))
    pairs = F.transform(F.filter(numbers, lambda n: F.size(n) >= 2), lambda n: _peak(n[0], n[1]))
    return F.filter(pairs, _usable)


def annotation_formulas(quoted: Column) -> Column:
    """Formulas named in a quoted annotation: left of ``=``, without ``p``, ``?`` and isotope marks."""
    lefts = F.transform(F.split(quoted, ";"), lambda t: F.trim(F.split_part(F.trim(t), F.lit("="), F.lit(1))))
    lefts = F.filter(lefts, lambda t: ~t.isin("", "p", "?", "p+i"))
    bare = F.transform(lefts, lambda t: F.regexp_replace(t, r"\+i$", ""))
    return F.filter(bare, lambda t: t.rlike(r"^[A-Z][a-z]?\d*") & ~t.contains("/") & ~t.contains(" "))


def parse_annotated_line(line: Column) -> Column:
    """Peaks with the formulas of the annotation that follows each of them."""
    groups = [F.regexp_extract_all(line, F.lit(ANNOTATED_PAIR), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(groups[0].alias("m"), groups[1].alias("i"), groups[2].alias("q"))
    peaks = F.transform(rows, lambda r: F.struct(
        r["m"].try_cast("double").alias("mz"), r["i"].try_cast("double").alias("intensity"),
        annotation_formulas(F.replace(r["q"], F.lit('"'), F.lit(""))).alias("formulas")))
    return F.filter(peaks, _usable)


def raw_records(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One row per record: name, the text below it and the source file."""
    reader = (spark.readStream if stream else spark.read).option("lineSep", "\nName:")
    text = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    body = F.regexp_replace(F.replace("value", F.lit("\r"), F.lit("")), r"^Name:", "")
    return text.withColumn("body", body).select(
        F.trim(F.substring_index("body", "\n", 1)).alias("name"),
        F.regexp_extract("body", r"(?s)^[^\n]*\n(.*)$", 1).alias("text"), "file")


# Everything up to and including the line that announces the peaks.
HEAD = r"(?ism)\A(.*?^[ \t]*num peaks[ \t]*:[^\n]*)"


def split_sections(records: DataFrame) -> DataFrame:
    """Adds ``head`` (header lines as text) and ``peak_lines``.

    Peak lines run from ``Num Peaks`` to the first blank line; later lines
    count as headers with a colon and as peaks without one.
    """
    rows = records.withColumn("__head", F.regexp_extract("text", HEAD, 1))
    has = F.length("__head") > 0
    rows = rows.withColumn("__tail", F.when(has, F.substring("text", F.length("__head") + 1, F.length("text"))).otherwise(""))
    blocks = F.split("__tail", r"\n[ \t]*\n", 2)
    rows = rows.withColumn("__blocks", blocks)
    filled = lambda x: F.filter(F.split(x, "\n"), lambda t: F.trim(t) != "")
    rows = rows.withColumn("__later", filled(F.coalesce(F.try_element_at("__blocks", F.lit(2)), F.lit(""))))
    more = F.array_join(F.filter("__later", lambda t: t.contains(":")), "\n")
    return rows.select(
        "name", "file", F.concat_ws("\n", F.when(has, F.col("__head")).otherwise(F.col("text")), more).alias("head"),
        F.concat(filled(F.col("__blocks")[0]), F.filter("__later", lambda t: ~t.contains(":"))).alias("peak_lines"))


def _field(key: str) -> Column:
    """Last value of a header key, NULL when absent or blank."""
    hits = F.regexp_extract_all("head", F.lit(rf"(?im)^[ \t]*{key}[ \t]*:(.*)$"), F.lit(1))
    return N.optional_string(F.try_element_at(hits, F.lit(-1)))


def _valid(rows: DataFrame, test) -> DataFrame:
    """Rows passing ``test``.  The test runs on the finished row: pushed below the
    parsing it would repeat the parsing."""
    whole = F.struct(*rows.columns)
    return rows.select(F.explode(F.filter(F.array(whole), test)).alias("r")).select("r.*")


FIELDS = {
    "precursor_type": "precursor_type", "instrument_type": "instrument_type", "instrument": "instrument",
    "collision_energy_raw": "collision_energy", "ion_mode": "ion_mode", "formula": "formula", "inchikey": "inchikey",
    "casno": "casno", "nistno": "nistno",
}


def read_msp(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Records with an id and at least one valid peak; ``peaks`` is an array of (mz, intensity)."""
    rows = split_sections(raw_records(spark, path, stream))
    parsed = rows.select(
        N.optional_float(_field("id")).cast("long").alias("id"), N.optional_string(F.col("name")).alias("name"),
        N.optional_float(_field("precursormz")).alias("precursor_mz"), *[_field(k).alias(n) for n, k in FIELDS.items()],
        F.flatten(F.transform("peak_lines", parse_peak_line)).alias("peaks"))
    parsed = parsed.withColumn("collision_energy", N.optional_float(F.col("collision_energy_raw")))
    return _valid(parsed, lambda r: r["id"].isNotNull() & (F.size(r["peaks"]) > 0))


def read_msp_annotated(spark: SparkSession, path: str) -> DataFrame:
    """Records with annotated peaks (mz, intensity, formulas)."""
    rows = split_sections(raw_records(spark, path))
    return rows.select(
        N.optional_float(_field("id")).cast("long").alias("id"), _field("formula").alias("formula"),
        F.upper(_field("inchikey")).alias("inchikey"), F.flatten(F.transform("peak_lines", parse_annotated_line)).alias("peaks"))


def read_msp_loose(spark: SparkSession, path: str) -> DataFrame:
    """Audit reading: loose peak lines, at most the declared number of lines."""
    rows = split_sections(raw_records(spark, path)).withColumn("__n", N.optional_float(_field("num peaks")).cast("int"))
    kept = F.slice("peak_lines", F.lit(1), F.greatest(F.coalesce("__n", F.size("peak_lines")), F.lit(0)))
    return rows.select(
        N.optional_float(_field("id")).cast("long").alias("id"),
        F.flatten(F.transform(kept, parse_peak_line_loose)).alias("peaks"))


def scan_headers(spark: SparkSession, paths: str | list[str], limit: int | None = None) -> DataFrame:
    """Long (file, name, key, value) metadata of whole libraries; repeated keys are joined with `` || ``.

    ``limit`` stops after that many records.
    """
    rows = split_sections(raw_records(spark, paths))
    if limit:
        rows = rows.limit(limit)
    lines = F.filter(F.split("head", "\n"), lambda t: t.contains(":"))
    heads = F.transform(lines, lambda t: F.struct(
        F.lower(F.trim(F.split_part(t, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_replace(t, r"^[^:]*:", "")).alias("value")))
    rows = rows.select("file", "name", heads.alias("headers"))
    keys = F.array_distinct(F.transform("headers", lambda h: h["key"]))
    merged = F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_join(
        F.transform(F.filter("headers", lambda h: h["key"] == k), lambda h: h["value"]), " || ").alias("value")))
    return rows.select("file", "name", F.explode(merged).alias("h")).select("file", "name", "h.*")


def long_peaks(records: DataFrame, id_col: str = "id") -> DataFrame:
    """(spectrum_id, peak_no, mz, intensity) rows of parsed records."""
    return records.select(F.col(id_col).alias("spectrum_id"), F.posexplode("peaks").alias("peak_no", "p")).select(
        "spectrum_id", "peak_no", "p.*")


def render_msp(spectra: DataFrame, peaks: DataFrame) -> DataFrame:
    """MSP text, one record per row, for ``write.text``.

    ``spectra`` has spectrum_id, name and the header columns to write; peaks of
    a spectrum are listed by m/z.
    """
    lines = peaks.groupBy("spectrum_id").agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("p"))
    rows = spectra.join(lines, "spectrum_id")
    heads = [c for c in spectra.columns if c not in ("spectrum_id", "name")]
    parts = [F.concat(F.lit("Name: "), F.col("name")), F.concat(F.lit("ID: "), F.col("spectrum_id").cast("string"))]
    parts += [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in heads]
    parts += [F.concat(F.lit("Num Peaks: "), F.size("p").cast("string")),
              F.array_join(F.transform("p", lambda x: F.concat_ws(" ", x["mz"].cast("string"), x["intensity"].cast("string"))), "\n"),
              F.lit("")]
    return rows.select(F.concat_ws("\n", *parts).alias("value"))
