"""Session settings and the lineage cut used by the iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators are written for.  Skewed joins are split by
# AQE even where that costs one more exchange, because a single spectrum or
# source may hold a large share of all peaks.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "peakwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; explicit ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: list[str] = []


def _local_folder() -> str:
    """One folder for sessions inside one JVM that name none; removed at exit."""
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-scratch-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset
    and the session runs inside one JVM (tests) a fresh folder is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = _local_folder()
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared checkpoint folder (a local one only in one-JVM sessions)."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, used often, and kept when executors are lost."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 500_000


def parts_for(rows: DataFrame) -> int:
    """Partitions that hold about ``ROWS_A_TASK`` rows each, so that what a task holds does not grow with the input.

    Counts the rows: for tables, whose files know their counts.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))
