"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakwise.llm import bpe, jaccard, mixing, pii, quality
from peakwise.llm.common import id_crc, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the compression classifier takes for good."""
    learnable = table(spark, sf_dir, "labels").filter(F.pmod(id_crc(F.col("doc_id")), F.lit(3)) != 1)
    return quality.keep_good(docs, learnable)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one_of_each(docs, n=5, percent=80, prefix=True)


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced; ``n_chars`` follows the text."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions 3, 1, 2 in turn, 150 % of all words, no document more than twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether decoding them gives the text of the same tokens back."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    decoded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), vocabulary, decoded="decoded")
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", sanitise_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

# The classifier is trained, so no SQL gives the rows; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-stage")
    return STAGES[-1][1](spark, docs, sf_dir)
