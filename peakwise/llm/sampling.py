"""The bounded labelled sample that the two classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_labels(labels: DataFrame, column: str, seed: int = 29) -> DataFrame:
    """``doc_id, label, h``: labels 0 and 1 once per document, with a seeded hash of the id.

    A document labelled more than once counts with its highest label; labels
    other than 0 and 1 and NULL ids are left out.
    """
    return labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(column).cast("int").alias("label")).withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))


def sampled_texts(docs: DataFrame, *parts: tuple[DataFrame, int, int]) -> DataFrame:
    """Texts of the first rows by hash of each part: columns ``h, mark, text``.

    A part is (rows of ``known_labels``, mark, limit).  The list of ids is no
    longer than the limits together, the proven bound that lets it be broadcast.
    """
    picks = [part.orderBy("h", "doc_id").limit(limit).select("doc_id", "h", F.lit(mark).alias("mark")) for part, mark, limit in parts]
    picked = picks[0]
    for more in picks[1:]:
        picked = picked.unionByName(more)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("h", "mark", F.coalesce("text", F.lit("")).alias("text"))


def fit_in_task(sample: DataFrame, fit: Callable[[list[int], list[str]], bytes], rows: int, max_chars: int) -> bytes:
    """``fit(marks, texts)``, run by one task over the bounded sample; only the model comes to the driver.

    The task keeps the first ``rows`` texts in hash order, and of these as many
    as fit into ``max_chars``; the rest is read and dropped, so that one id
    with very many rows or very long texts cannot fill its memory.
    """

    def run(batches):
        marks, texts, used = [], [], 0
        for batch in batches:
            for mark, text in zip(batch.column(0), batch.column(1)):
                if len(texts) >= rows or used > max_chars:
                    break
                text = text.as_py()
                used += len(text)
                if used <= max_chars:
                    marks.append(mark.as_py())
                    texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array([fit(marks, texts)], type=pa.binary())], ["model"])

    ordered = sample.repartition(1).sortWithinPartitions("h", "mark", "text")
    fitted = ordered.select("mark", "text").mapInArrow(run, "model binary").collect()
    return bytes(fitted[0]["model"]) if fitted else fit([], [])  # an empty sample has no task
