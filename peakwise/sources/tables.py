"""Tabular sources: interchange files, structure headers, compounds and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakwise.functions import normalize as N

LIBRARY_PATTERNS = ("*.msp", "*.MSP")


def find_library_files(spark: SparkSession, root: str, patterns: Sequence[str] = LIBRARY_PATTERNS) -> DataFrame:
    """(path, length) of all files below ``root`` matching a pattern; contents are not read."""
    out = None
    for pattern in patterns:
        found = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(root).select("path", "length"))
        out = found if out is None else out.unionByName(found)
    return out.distinct().orderBy("path")


def structure_headers(
    spark: SparkSession, root: str, glob: str = "[Ii][Dd]*.[Mm][Oo][Ll]", id_pattern: str = r"(?i)/ID(\d+)\.MOL$"
) -> DataFrame:
    """``headers_of_structures`` of the structure files below a folder."""
    return headers_of_structures(structure_files(spark, root, glob), id_pattern)


def structure_files(spark: SparkSession, root: str, glob: str = "[Ii][Dd]*.[Mm][Oo][Ll]") -> DataFrame:
    """(path, value) of the structure files below a folder.

    A store lists and opens files one by one, so large libraries are best written
    as such a table once and read from it.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def headers_of_structures(files: DataFrame, id_pattern: str = r"(?i)/ID(\d+)\.MOL$") -> DataFrame:
    """Name, source, CAS number and library id from the first lines of structure files ``(path, value)``.

    The id comes from the file path (``ID<n>.MOL``) and stands in for a missing
    library id.
    """
    number = F.regexp_extract("path", id_pattern, 1)
    lines = F.split("value", r"\r?\n")
    note = F.coalesce(F.try_element_at(lines, F.lit(3)), F.lit(""))
    cas = F.nullif(F.regexp_extract(note, r"(?i)CAS\s*rn\s*=\s*([0-9]+)", 1), F.lit(""))
    lib = F.nullif(F.regexp_extract(note, r"(?i)Library\s*ID\s*=\s*(\d+)", 1), F.lit("")).try_cast("long")
    rows = files.select(
        F.nullif(number, F.lit("")).try_cast("long").alias("mol_id"), N.optional_string(F.try_element_at(lines, F.lit(1))).alias("name"),
        N.optional_string(F.try_element_at(lines, F.lit(2))).alias("source"), cas.alias("cas"), lib.alias("library_id"))
    return rows.filter("mol_id IS NOT NULL").withColumn("library_id", F.coalesce("library_id", "mol_id"))


def read_interchange(spark: SparkSession, parquet_path: str, tsv_path: str, schema: str, fold: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(parquet spectra, TSV rows of one fold); the TSV is read with a fixed schema and pruned columns."""
    tsv = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(tsv_path)
    if fold is not None:
        tsv = tsv.filter(F.col("fold") == fold)
    return spark.read.parquet(parquet_path), tsv


def csv_array(text: Column) -> Column:
    """Comma text to an array of doubles."""
    parts = F.filter(F.split(text, ","), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast("double"))


def array_csv(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


def explode_csv_peaks(df: DataFrame, keys: Sequence[str], mzs: str = "mzs", intensities: str = "intensities") -> DataFrame:
    """Long peaks of rows holding m/z and intensity as comma texts (the shorter list wins)."""
    m, i = csv_array(F.col(mzs)), csv_array(F.col(intensities))
    n = F.least(F.size(m), F.size(i))
    zipped = F.arrays_zip(F.slice(m, F.lit(1), n).alias("mz"), F.slice(i, F.lit(1), n).alias("intensity"))
    return df.select(*keys, F.posexplode(zipped).alias("peak_no", "p")).select(*keys, "peak_no", "p.*")


def explode_line_peaks(df: DataFrame, keys: Sequence[str], column: str = "peaks") -> DataFrame:
    """Long peaks of a newline text ``mz intensity [annotation]``; blank lines are skipped."""
    lines = F.filter(F.split(column, "\n"), lambda x: F.length(x) > 0)
    rows = df.select(*keys, F.posexplode(lines).alias("peak_no", "line"))
    tail = F.regexp_extract("line", r"^\S+ \S+ (.*)$", 1)
    return rows.select(
        *keys, "peak_no", F.split_part("line", F.lit(" "), F.lit(1)).try_cast("double").alias("mz"),
        F.split_part("line", F.lit(" "), F.lit(2)).try_cast("double").alias("intensity"),
        F.nullif(F.replace(tail, F.lit('"'), F.lit("")), F.lit("")).alias("annotation"))


COMPOUND_COLUMNS = ("id", "exact_mass", "inchikey", "smiles", "formula")


def lookup_compounds(compounds: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Compounds whose ``column`` is in the list; Spark picks the join by the list's size."""
    if column not in COMPOUND_COLUMNS:
        raise ValueError(f"lookup by {column} is not supported")
    return compounds.join(wanted.select(column).distinct(), column, "left_semi")


def shard(df: DataFrame, key: str, shards: int, shard_id: int, cap: int | None = None) -> DataFrame:
    """Every ``shards``-th row by id; ``cap`` first takes the smallest ids."""
    rows = df.orderBy(key).limit(cap) if cap else df
    return rows.filter(F.pmod(F.col(key), F.lit(shards)) == shard_id)


def read_whitelist(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Identifiers of a JSON list, ``{split: [...]}`` or ``{"identifiers": [...]}``."""
    text = spark.read.text(path, wholetext=True)
    named = F.from_json("value", "map<string,array<string>>")
    plain = F.from_json("value", "array<string>")
    is_list = F.ltrim("value").startswith("[")
    values = F.when(is_list, plain).otherwise(F.coalesce(F.try_element_at(named, F.lit(split)), F.try_element_at(named, F.lit("identifiers"))))
    return text.select(F.explode(values).alias("identifier")).select(
        N.optional_string(F.col("identifier")).alias("identifier")).filter("identifier IS NOT NULL").distinct()
