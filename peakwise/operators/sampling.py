"""Reproducible splits, samples and selections by content hash, never by row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.skew import _counted_positions, exact_quantiles


def uniform_hash(key: Column, seed: int) -> Column:
    """Number in [0, 1) from the first 64 bits of SHA-1 of ``seed|key``."""
    digest = F.sha1(F.concat(F.lit(f"{seed}|"), key))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def uniform_hash_mod(key: Column, seed: int) -> Column:
    """Number in [0, 1) with six digits from the first 48 bits of SHA-1 of ``key|seed``."""
    digest = F.sha1(F.concat(key, F.lit(f"|{seed}")))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(1000000)) / 1000000.0


def split_name(u: Column, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> Column:
    total = train + val + test
    first, second = train / total, val / total
    return F.when(u < first, "train").when(u < first + second, "val").otherwise("test")


def modulo_phase(value: Column, mod: int, train: Sequence[int] | None, test: Sequence[int] | None) -> Column:
    """train / test / null by residue; with one list given the rest is the other phase."""
    r = F.pmod(value, F.lit(mod))
    if train is not None and test is not None:
        return F.when(r.isin(list(train)), "train").when(r.isin(list(test)), "test").otherwise("null")
    if test is not None:
        return F.when(r.isin(list(test)), "test").otherwise("train")
    if train is not None:
        return F.when(r.isin(list(train)), "train").otherwise("test")
    raise ValueError("give train, test or both")


def hash_order(key: Column, seed: int) -> Column:
    """Pseudo-random but reproducible sort key."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order: a distributed top-n, the same on any partitioning."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def bucket_index(value: Column, edges: Sequence[float | Column]) -> Column:
    """Right-open bucket; out of range (also below) is the last bucket, missing is -1."""
    cols = [e if isinstance(e, Column) else F.lit(float(e)) for e in edges]
    out: Column = F.lit(len(cols) - 2)
    for i in reversed(range(len(cols) - 1)):
        out = F.when((value >= cols[i]) & (value < cols[i + 1]), i).otherwise(out)
    return F.when(value.isNull() | F.isnan(value.cast("double")), -1).otherwise(out)


def quantile_edges(df: DataFrame, value: str, n_bins: int) -> DataFrame:
    """One row e0..eN of exact quantile edges made strictly increasing."""
    qs = {f"q{i}": i / n_bins for i in range(n_bins + 1)}
    row = exact_quantiles(df, [], value, qs)
    cols, last = [], None
    for name in qs:
        edge = F.col(name) if last is None else F.when(F.col(name) <= last, last + 1e-9).otherwise(F.col(name))
        cols.append(edge.alias(f"e{name[1:]}"))
        last = edge
    return row.select(*cols)


def stratified_allocation(sizes: DataFrame, target: int) -> DataFrame:
    """``alloc`` per stratum: one each by size, floors of the proportional rest, largest remainders.

    ``sizes(stratum, n)`` has one row per stratum; the windows run over that
    small table.
    """
    whole = W.partitionBy(F.lit(0))
    by_size = whole.orderBy(F.col("n").desc(), "stratum")
    rows = sizes.withColumn("__all", F.sum("n").over(whole)).withColumn(
        "__base", (F.row_number().over(by_size) <= target).cast("long"))
    rows = rows.withColumn("__left", F.lit(target) - F.sum("__base").over(whole)).withColumn(
        "__cap", F.col("n") - F.col("__base")).withColumn("__caps", F.sum("__cap").over(whole))
    share = F.when(F.col("__caps") > 0, F.col("__left") * (F.col("__cap") / F.col("__caps"))).otherwise(0.0)
    rows = rows.withColumn("__x", share).withColumn("__a", F.least(F.floor("__x"), F.col("__cap")))
    rows = rows.withColumn("__open", (F.col("__base") + F.col("__a") < F.col("n")).cast("int"))
    spare = F.col("__left") - F.sum("__a").over(whole)
    turn = F.row_number().over(whole.orderBy(F.col("__open").desc(), (F.col("__x") - F.col("__a")).desc(),
                                             F.col("stratum").desc()))
    extra = ((F.col("__open") == 1) & (turn <= spare)).cast("long")
    alloc = F.when(F.col("__all") <= target, F.col("n")).otherwise(F.col("__base") + F.col("__a") + extra)
    return rows.select("stratum", "n", alloc.alias("alloc"))


def stratified_pick(df: DataFrame, key: str, target: int, seed: int) -> DataFrame:
    """Rows of a proportional stratified sample; needs a ``stratum`` column.

    Each stratum takes its first rows in hash order.  The rank limit is pushed
    below the shuffle through the overall target, so no task sees more than
    ``target`` rows of a stratum per input task.
    """
    alloc = stratified_allocation(df.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), target)
    order = W.partitionBy("stratum").orderBy(hash_order(F.col(key), seed), key)
    ranked = df.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= target)
    return ranked.join(alloc.select("stratum", "alloc"), "stratum").filter(
        F.col("__r") <= F.col("alloc")).drop("__r", "alloc")


def epoch_subset(df: DataFrame, key: str, size: int, epoch: int) -> DataFrame:
    """The ``size`` rows of one epoch when ids in order are walked in a circle.

    Positions come from the two-level rank of a unique key, not from one
    global window.
    """
    positions = _counted_positions(df, [], key)
    offset = F.pmod(F.col("before") - F.lit(epoch * size), F.col("total"))
    chosen = positions.filter(offset < size).select(key, F.col("before").alias("position"))
    return df.join(chosen, key)


def source_switch(first: DataFrame, second: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Rows of ``first`` or ``second`` per spectrum, by hash of the id.

    A spectrum takes ``first`` with probability ``ratio``; where its choice has
    no rows it takes ``first`` if that has any, else ``second``.
    """
    has = lambda df, name: df.select("spectrum_id").distinct().withColumn(name, F.lit(True))
    ids = has(first, "__a").join(has(second, "__b"), "spectrum_id", "full_outer")
    wants_first = uniform_hash(F.col("spectrum_id").cast("string"), seed) < ratio
    pick_first = F.when(wants_first, F.col("__a").isNotNull()).otherwise(F.col("__b").isNull())
    choice = ids.select("spectrum_id", pick_first.alias("__first"))
    a = first.join(choice.filter("__first"), "spectrum_id").withColumn("source", F.lit("first"))
    b = second.join(choice.filter("NOT __first"), "spectrum_id").withColumn("source", F.lit("second"))
    return a.unionByName(b).drop("__first")
