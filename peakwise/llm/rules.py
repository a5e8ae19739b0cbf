"""Quality rules with adaptive thresholds.

Base rules are fixed; the other limits follow the data.  Three measures of
each document that passes the base rules go into quantile sketches per
language and source: counts of logarithmic buckets (relative error 1 %), which
merge by adding.  Groups too small for stable quantiles use the merged sketch
of their language, and that of all documents after it.  A measure is an
outlier when it lies more than ``WIDTH`` interquartile ranges beyond a
quartile; the limits are joined to the documents by group.

All steps are DataFrame functions.  Python runs nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.llm.common import WORD, null_safe_key, set_aside, stored, text_or_empty

# White space and symbols of the contract.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
# Buckets per factor e: a bucket spans 2 %, so its middle is within 1 % of its values.
RESOLUTION = 50
WIDTH = 5
GROUP_ROWS = 100
# Per measure the least interquartile range that counts (thousandths): symbols a word, characters a word, share of repeated lines.
LEAST_SPREAD = {"symbols": 40, "word_length": 100, "repeated_lines": 100}
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed"]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it in inner functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, other: F.coalesce(F.get(s, other)["x"] == x["x"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def words(starts: Column) -> Column:
        step = F.transform(starts, lambda v, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(starts, j + 1) - v, F.lit(WINDOW_WORDS))))
        return F.aggregate(step, F.lit(0), lambda total, x: total + x)

    return bound(bound(placed, repeated), words)


def _of_words(words: Column) -> Column:
    def repeats(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW_WORDS)))
        some = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
        return F.struct(F.size(w).alias("n"), F.when(F.size(w) > WINDOW_WORDS, some).otherwise(F.lit(0)).alias("repeated"))

    return bound(words, repeats)


def _of_lines(lines: Column) -> Column:
    return bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("repeated")))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``RESULTS``: counts over the whole text and the verdict of the base rules.

    NULL and empty texts count 0 everywhere and fail.  Columns of ``docs`` with
    these names are replaced.
    """
    text = text_or_empty("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    docs = docs.drop(*RESULTS)
    docs, back = set_aside(docs, ["by_words", "by_lines"])
    counted = docs.select(
        "*", _of_words(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("by_words"), _of_lines(lines).alias("by_lines"))
    n, repeated = F.col("by_words.n").cast("long"), F.col("by_words.repeated").cast("long")
    return counted.select(
        *back, n.alias("n_words"), without(SPACES).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"), F.col("by_lines.repeated").cast("long").alias("n_dup_lines"),
        F.col("by_lines.n").cast("long").alias("n_lines"), repeated.alias("n_repeat_words"),
        ((n < 20) | (100 * repeated > 30 * n)).alias("base_failed"))


def _measures() -> dict[str, Column]:
    """The adaptive measures in whole thousandths."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(F.lit(0)).cast("long")
    return {"symbols": ratio("n_symbols", "n_words"), "word_length": ratio("word_chars", "n_words"),
            "repeated_lines": ratio("n_dup_lines", "n_lines")}


def sketches(measured: DataFrame) -> DataFrame:
    """``lang_key, source_key, measure, bucket, n`` over the documents that pass the base rules."""
    value = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), v.alias("v")) for name, v in _measures().items()]))
    rows = measured.filter(~F.col("base_failed")).select(
        null_safe_key(F.col("lang")).alias("lang_key"), null_safe_key(F.col("source")).alias("source_key"), value.alias("m"))
    bucket = F.when(F.col("m.v") <= 0, F.lit(-1)).otherwise(F.floor(F.log(F.col("m.v").cast("double")) * RESOLUTION)).cast("int")
    return rows.groupBy("lang_key", "source_key", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _limits(sketch: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Rows and limits of each group of a merged sketch."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    # A window holds the buckets of one sketch, of which there are at most a few thousand.
    group = W.partitionBy(*keys, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    middle = F.when(F.col("bucket") < 0, F.lit(0.0)).otherwise(F.exp((F.col("bucket") + 0.5) / RESOLUTION))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, middle))
    found = upto.groupBy(*keys, "measure").agg(F.max("total").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    least = F.create_map(*[F.lit(x) for pair in LEAST_SPREAD.items() for x in pair])
    reach = F.greatest(F.col("q3") - F.col("q1"), least[F.col("measure")].cast("double")) * WIDTH
    found = found.withColumn("low", F.round(F.col("q1") - reach)).withColumn("high", F.round(F.col("q3") + reach))
    return found.select(*keys, "measure", F.struct("rows", "low", "high").alias(level))


def thresholds(measured: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Limits per group: ``lang_key, source_key`` and ``<measure>_low``, ``<measure>_high``."""
    sketch = stored(sketches(measured), "rule-sketches")
    own = _limits(sketch, ["lang_key", "source_key"], "own")
    by_lang, overall = _limits(sketch, ["lang_key"], "by_lang"), _limits(sketch, [], "overall")
    joined = own.join(by_lang, ["lang_key", "measure"]).join(overall, "measure")
    chosen = F.when(F.col("own.rows") >= group_rows, F.col("own")).when(
        F.col("by_lang.rows") >= group_rows, F.col("by_lang")).otherwise(F.col("overall"))
    pick = lambda name, side: F.max(F.when(F.col("measure") == name, chosen[side])).alias(f"{name}_{side}")
    limits = joined.groupBy("lang_key", "source_key").agg(*[pick(name, side) for name in LEAST_SPREAD for side in ("low", "high")])
    return stored(limits, "rule-limits")


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` plus ``kept``: passes the base rules, and no measure lies outside its group's limits."""
    measured, back = set_aside(measured.drop("kept"), limits.columns)
    inside = F.lit(True)
    for name, value in _measures().items():
        inside = inside & (value >= F.col(f"{name}_low")) & (value <= F.col(f"{name}_high"))
    keyed = measured.withColumns({"lang_key": null_safe_key(F.col("lang")), "source_key": null_safe_key(F.col("source"))})
    joined = keyed.join(limits, ["lang_key", "source_key"], "left")
    return joined.select(*back, (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


def keep_by_rules(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``; missing languages and sources are groups of their own."""
    docs, back = set_aside(docs, [*RESULTS, "kept"])
    measured = measure(docs)
    return judge(measured, thresholds(measured)).filter("kept").select(*back)
