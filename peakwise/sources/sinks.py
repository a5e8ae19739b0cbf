"""Writers: predictions, idempotent loads, diagnostics and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows of a batch whose key is neither in the target nor earlier in the batch."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def insert_or_ignore(batch: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the parquet table does not have yet."""
    spark = batch.sparkSession
    try:
        target = spark.read.parquet(path)
    except Exception as exc:  # a table that does not exist yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        batch.dropDuplicates([key]).write.parquet(path)
        return
    new_rows(batch, target, key).write.mode("append").parquet(path)


def prediction_rows(peaks: DataFrame, keys: Sequence[str] = ("mol_id", "phase", "source_idx")) -> DataFrame:
    """One row per prediction with its peaks sorted by m/z.  Peaks are merged per m/z first, which bounds the array."""
    merged = peaks.groupBy(*keys, "mz").agg(F.sum("intensity").alias("intensity"))
    rows = merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))
    return rows.withColumn("n_peaks", F.size("peaks"))


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("phase").parquet(path)


def read_predictions(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """Prediction rows; a phase filter prunes partitions."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("phase") == phase) if phase else rows


def write_diagnostics(rows: DataFrame, path: str) -> None:
    """One JSON object per row."""
    rows.write.mode("append").json(path)


def distributions(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` of every value of the columns; a missing one is ``<missing>``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def manifest(rows: DataFrame, name: str, filters: dict[str, str], distributions: Sequence[str], gate: DataFrame | None = None) -> DataFrame:
    """One JSON document: row count, filters, value distributions and gate result.

    Each distribution shows its 50 most frequent values and the number of
    distinct ones, so the document's size does not grow with the data; the
    whole distributions are a table, ``distributions``.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    parts = []
    for column in distributions:
        counts = rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<missing>")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.orderBy(F.col("n").desc(), "value").limit(50)
        listed = top.agg(F.sort_array(F.collect_list(F.struct(F.col("n").alias("n"), F.col("value").alias("value"))), False)).scalar()
        parts.append(F.struct(listed.alias("top"), counts.agg(F.count(F.lit(1))).scalar().alias("distinct")).alias(column))
    document = [F.lit(name).alias("name"), total.alias("rows"),
                F.struct(*[F.lit(v).alias(k) for k, v in sorted(filters.items())]).alias("filters") if filters else F.lit(None).alias("filters"),
                F.struct(*parts).alias("distributions")]
    if gate is not None:
        document.append(gate.select(F.struct("passed", "errors")).scalar().alias("gate"))
    one = rows.sparkSession.range(1)
    return one.select(F.to_json(F.struct(*document)).alias("manifest"))
