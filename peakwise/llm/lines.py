"""Line dedup: lines found in several documents stay only in the document with the smallest id.

Lines are exploded with their position, their keys (stripped at both ends, A-Z
in lower case) hashed to 128 bits, and the distinct documents of each hash
counted.  Lines over the threshold lose all their places but those in the
document that keeps them; each text is put together again by position.

Rows with the same id are one document.  Rows without an id are one document
that comes after all others.  Missing and empty texts have one empty line.  A
line repeated inside one document only is left alone.  Repeated rows have the
same fate.  Other columns stay, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakwise.llm.common import lower_ascii, set_aside, stored, text_or_empty

# Fixed value: the white space of the contract, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def split_lines(text: Column | str) -> Column:
    return F.split(text_or_empty(text), "\n")


def _hashes(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: equal ones mean equal values."""
    return [F.xxhash64(F.lit(salt), *cols) for salt in (11, 12)]


def _row_hashes() -> list[Column]:
    """What tells rows apart; rows with the same id and text lose the same lines."""
    # A hash skips NULLs, so whether a value is there is hashed too.
    parts = [part for c in ("doc_id", "text") for part in (F.col(c).isNull(), F.col(c))]
    return [h.alias(name) for h, name in zip(_hashes(*parts), ("row1", "row2"))]


def places(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(row1, row2, doc_id, pos, key1, key2): every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(*_row_hashes(), "doc_id", F.posexplode(split_lines("text")).alias("pos", "line"))
    keys = lines.select("row1", "row2", "doc_id", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    key1, key2 = _hashes(F.col("key"))
    return keys.select("row1", "row2", "doc_id", "pos", key1.alias("key1"), key2.alias("key2"))


def repeated_keys(lines: DataFrame, min_docs: int = 2) -> DataFrame:
    """(key1, key2, keeper) of the keys in at least ``min_docs`` documents; ``keeper`` is NULL if none of them has an id.

    Counted in two steps, first by key and document, so that a key that stands in every document is spread.
    """
    n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    found = lines.groupBy("key1", "key2").agg(n.alias("n_docs"), F.min("doc_id").alias("keeper"))
    return found.filter(F.col("n_docs") >= min_docs).drop("n_docs")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` without the dropped lines, plus ``n_lines`` (before) and ``n_dropped``.

    Columns called ``n_lines`` or ``n_dropped`` are replaced.  Documents without a text get an empty one.
    """
    docs = docs.drop("n_lines", "n_dropped")
    docs, back = set_aside(docs, ["row1", "row2", "dropped"])
    lines = places(docs.select("doc_id", "text"), min_chars)
    # Written first, so that the join has a shuffle of its own on both sides and Spark can split a key of many places.
    repeated = stored(repeated_keys(lines, min_docs), "repeated-lines")
    lost = lines.join(repeated, ["key1", "key2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("row1", "row2").agg(F.collect_set("pos").alias("dropped"))
    joined = docs.withColumns(dict(zip(("row1", "row2"), _row_hashes()))).join(lost, ["row1", "row2"], "left")
    n_lines = F.size(split_lines("text"))
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("dropped"))
    # The lines are handed to the function as a value: split once, not once per position.
    rest = F.transform(F.array(split_lines("text")), lambda all_lines: F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))[0]
    text = F.when(F.col("dropped").isNull(), text_or_empty("text")).otherwise(rest)
    columns = [text.alias("text") if c.lower() == "text" else e for c, e in zip([c for c in docs.columns], back)]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
