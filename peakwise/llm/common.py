"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakwise.session import scratch_dir

# The word patterns of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lineage cut that survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def null_safe_key(col: Column) -> Column:
    """A string key that keeps NULL apart from every value, so that plain equality joins work."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Working column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text (of the empty text for a missing id)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with columns called like ``names`` renamed, and the expressions that give the old columns back."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    fresh = dict(zip(clash, unused(df, *[f"kept_{c}" for c in clash])))
    back = [F.col(f"`{fresh.get(c, c)}`").alias(c) for c in df.columns]
    return df.select(*[F.col(f"`{c}`").alias(fresh.get(c, c)) for c in df.columns]), back
