"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows are grouped (by default equal texts) and a group goes to one shard.  The
groups are too many for one task, so they are packed in bounded form: a group
of at least ``1 / BUNDLES`` of the bytes, tokens or rows is an item of its own
(at most ``3 * BUNDLES`` of them can exist); all other groups are dealt by
hash into ``BUNDLES`` bundles, each an item.  The items, largest first, go to
the shard whose residual capacity has the highest dot product with the item's
vector.  A group larger than ``1 / SPLIT`` of a shard's bytes, tokens or rows is first
split into equal pieces by the hash of the id, since no whole placement of it
could be even.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.llm.common import n_words, set_aside, stored, text_or_empty

BUNDLES = 8192
SPLIT = 1.0
# Rows of one sorted part when places inside a shard are numbered.
SLOT_ROWS = 50_000


def pack_items(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item.

    ``vectors`` (items x resources) holds shares of the whole, so that every
    shard has a capacity of ``1 / shards`` in each resource.  Items are placed
    by falling largest share; ties go to the earlier item and the lower shard.
    """
    order = np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))) if len(vectors) else []
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(vectors), dtype=int)
    for item in order:
        shard = int(np.argmax(residual @ vectors[item]))
        chosen[item] = shard
        residual[shard] -= vectors[item]
    return chosen


def _items(groups: DataFrame, totals: dict[str, float], shards: int) -> DataFrame:
    """At most ``4 * BUNDLES`` + pieces rows: ``item`` key, its sums and its number of ``pieces``."""
    share = F.greatest(*[F.col(c) / F.lit(float(max(totals[c], 1))) for c in ("bytes", "tokens", "rows")])
    large = share * BUNDLES >= 1
    pieces = F.when(large, F.greatest(F.lit(1), F.ceil(share * shards / F.lit(SPLIT)))).otherwise(F.lit(1)).cast("int")
    item = F.when(large, F.concat(F.lit("g"), F.col("g").cast("string"))).otherwise(_bundle(F.col("g")))
    return groups.withColumn("item", item).withColumn("pieces", pieces).groupBy("item").agg(
        F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"), F.max("pieces").alias("pieces"))


def _bundle(g: Column) -> Column:
    return F.concat(F.lit("b"), F.pmod(F.xxhash64(g), F.lit(BUNDLES)).cast("string"))


def shard_documents(docs: DataFrame, shards: int = 16, group: Column | None = None) -> DataFrame:
    """Every row of ``docs`` plus ``size``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 length of the text plus 1 (a NULL text: 1).  ``slot``
    counts the rows of a shard from 0 without gaps, in the order of a hash of
    the id, the id and the size.  ``group``: what has to stay together, by
    default the text.  Repeated rows are rows like others; empty tables give no rows.
    Columns of ``docs`` with the names of the results are replaced.
    """
    docs = docs.drop("size", "shard", "slot")
    docs, back = set_aside(docs, ["g", "tokens", "part", "salt", "item", "pieces", "base", "shard_item", "shard_piece", "shard_target"])
    text = text_or_empty("text")
    group = F.xxhash64(text) if group is None else F.xxhash64(group)
    id_hash = F.xxhash64(F.col("doc_id"))
    rows = docs.withColumn("size", F.octet_length(text).cast("long") + 1).withColumn("g", group)
    groups = rows.withColumn("tokens", n_words(text)).groupBy("g").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = stored(groups, "shard-groups")
    sums = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "tokens", "rows")]).first().asDict()
    items = sorted(_items(groups, sums, shards).collect())  # bounded, see above
    keys, vectors = [], []
    for item, n_bytes, tokens, n_rows, pieces in items:
        vector = [n_bytes / max(sums["bytes"], 1), tokens / max(sums["tokens"], 1), n_rows / max(sums["rows"], 1)]
        for piece in range(pieces):
            keys.append((item, piece, pieces))
            vectors.append([v / pieces for v in vector])
    chosen = pack_items(np.array(vectors).reshape(-1, 3), shards)
    spark = docs.sparkSession
    placed = [(item, piece, int(shard)) for (item, piece, _), shard in zip(keys, chosen)]
    placed = F.broadcast(spark.createDataFrame(placed, "shard_item string, shard_piece int, shard_target int"))
    large = [(int(item[1:]), pieces) for item, _, _, _, pieces in items if item[0] == "g"]
    large = F.broadcast(spark.createDataFrame(large, "g long, pieces int"))  # at most 3 * BUNDLES rows
    item = F.when(F.col("pieces").isNotNull(), F.concat(F.lit("g"), F.col("g").cast("string"))).otherwise(_bundle(F.col("g")))
    piece = F.pmod(F.xxhash64(id_hash), F.coalesce(F.col("pieces"), F.lit(1))).cast("int")
    rows = rows.join(large, "g", "left").withColumn("item", item).withColumn("salt", piece)
    rows = rows.join(placed, (F.col("item") == F.col("shard_item")) & (F.col("salt") == F.col("shard_piece")))
    rows = rows.withColumn("shard", F.col("shard_target"))

    # Places: rows counted per (shard, part of the id hash), numbered inside a part.
    parts = max(1, -(-sums["rows"] // (shards * SLOT_ROWS)) * 4)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(id_hash, F.lit(1)), F.lit(int(parts))))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", before.alias("base"))
    inside = W.partitionBy("shard", "part").orderBy(id_hash, F.col("doc_id").asc_nulls_first(), "size")
    numbered = rows.withColumn("slot", F.row_number().over(inside))
    return numbered.join(base, ["shard", "part"]).select(
        *back, "size", "shard", (F.col("base") + F.col("slot") - 1).alias("slot"))
