"""Acquisition streams: the batch expressions on unbounded input.

Every operator takes a streaming DataFrame and returns one; ``run_available``
drains what is there into a parquet table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from peakwise.functions import spectrum as S
from peakwise.operators.matching import tolerance_bucket
from peakwise.session import scratch_dir
from peakwise.sources import msp


def msp_stream(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of every library file that appears in a folder."""
    return msp.long_peaks(msp.read_msp(spark, path, stream=True))


def table_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder))


def bin_stream(peaks: DataFrame, bin_width: float = S.BIN_WIDTH, max_mz: float = S.MAX_MZ, mode: str = "floor") -> DataFrame:
    """Valid peaks with their bin, stateless; sums per bin are taken when the table is read."""
    return (
        peaks.filter(S.is_peak(F.col("mz"), F.col("intensity"))).withColumn("bin", S.bin_index(F.col("mz"), bin_width, mode))
        .filter(F.col("bin").between(0, S.last_bin(bin_width, max_mz))))


def windowed_means(
    events: DataFrame, time: str, key: str, value: str, delay: str, length: str, slide: str | None = None, session: bool = False
) -> DataFrame:
    """Count and mean of the finite values per key in tumbling, sliding or session windows."""
    v = F.col(value)
    finite = F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)
    window = F.session_window(time, length) if session else F.window(time, length, slide)
    grouped = events.withWatermark(time, delay).groupBy(window.alias("w"), key)
    return grouped.agg(F.count(finite).alias("n"), F.avg(finite).alias("mean")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "mean")


def drop_repeated_conditions(events: DataFrame, time: str, content_key: Column, delay: str) -> DataFrame:
    """First row of every condition key within the watermark."""
    rows = events.withColumn("content_key", content_key).withWatermark(time, delay)
    return rows.dropDuplicatesWithinWatermark(["content_key"])


def suppress_repeats(events: DataFrame, time: str, content_key: Column, delay_seconds: float, late: str) -> DataFrame:
    """(content_key, ``time``) of the rows of each condition that come ``delay_seconds`` or more after the last one that passed.

    The state of a key is the time of its last row that passed.  It expires
    once the watermark (``late`` behind the newest row) is past the delay, so
    keys that do not return cost nothing; a key that returns then passes again.
    Rows of a key inside one trigger are taken in order of time; one earlier
    than the last that passed is a repeat.  Rows without a time are left out.
    """
    rows = events.filter(F.col(time).isNotNull()).select(F.coalesce(content_key, F.lit("")).alias("content_key"), F.col(time).alias(time))
    wait = int(delay_seconds * 1_000_000)
    schema = T.StructType([T.StructField("content_key", T.StringType()), T.StructField(time, T.TimestampType())])

    def keep(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # Times alone, eight bytes a row; whole rows are never held.
        times = np.sort(np.concatenate([f[time].to_numpy().astype("datetime64[us]").astype(np.int64) for f in frames]))
        passed, at = [], 0
        while at < len(times):
            if last is None or times[at] - last >= wait:
                last = int(times[at])
                passed.append(last)
            at = int(np.searchsorted(times, last + wait)) if times[-1] - last >= wait else len(times)
        if state.getCurrentWatermarkMs() * 1000 < last + wait:
            state.update((last,))
            state.setTimeoutTimestamp((last + wait) // 1000 + 1)
        elif state.exists:
            state.remove()
        if passed:
            stamps = np.array(passed, dtype="datetime64[us]")
            yield pd.DataFrame({"content_key": key[0], time: pd.Series(stamps).dt.tz_localize("UTC")})

    return rows.withWatermark(time, late).groupBy("content_key").applyInPandasWithState(
        keep, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def idempotent_writer(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch as a partition of the table, replacing that partition only.

    A batch that is replayed after a failure writes the same partition again,
    so it adds nothing, and nothing written before is read.  Rows repeated
    inside a batch are written once; repetitions across batches are the
    stream's to drop (``drop_repeated_conditions``), whose state expires.
    """
    keys = list(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(keys).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def match_library(events: DataFrame, library: DataFrame, keys: Sequence[str], tol: float) -> DataFrame:
    """Stream-static match of m/z values within ``tol`` of library peaks of the same keys.

    The static side is bucketed and copied to the neighbouring buckets, so the
    join stays an equi join and needs no state.
    """
    at = tolerance_bucket(F.col("library_mz"), tol, False)
    index = library.withColumn("__bucket", F.explode(F.sequence(at - 1, at + 1)))
    rows = events.withColumn("__bucket", tolerance_bucket(F.col("mz"), tol, False))
    return rows.join(index, [*keys, "__bucket"]).filter(F.abs(F.col("mz") - F.col("library_mz")) < tol).drop("__bucket")


def pair_streams(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, bound: str, delay: str) -> DataFrame:
    """Inner join of two streams on a key where the right row follows within ``bound``.

    Watermarks on both sides let Spark drop state that can no longer match;
    rows later than ``delay`` are dropped.
    """
    r_key = f"__{key}"
    l_rows = left.withWatermark(left_time, delay)
    r_rows = right.withColumnRenamed(key, r_key).withWatermark(right_time, delay)
    on = (F.col(key) == F.col(r_key)) & (F.col(right_time) >= F.col(left_time)) & (
        F.col(right_time) <= F.col(left_time) + F.expr(f"interval {bound}"))
    return l_rows.join(r_rows, on).drop(r_key)


def run_available(stream: DataFrame, mode: str = "append", writer: Callable | None = None, checkpoint: str | None = None) -> DataFrame | None:
    """Processes everything available and returns what was written (None with a ``writer`` of its own)."""
    spark = stream.sparkSession
    base = scratch_dir(spark, "stream")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{base}/checkpoint").trigger(availableNow=True)
    if writer is not None:
        out.foreachBatch(writer).start().awaitTermination()
        return None
    out.format("parquet").option("path", f"{base}/table").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
