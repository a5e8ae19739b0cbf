"""License scans by an exact set-similarity join.

Every line of a text is a block, a set of words, and so is every run of twice
as many consecutive words as a template has, wherever lines end: a notice that
is wrapped over lines stands in such a run.  A template matches a block
that contains at least ``threshold`` of its words.  The words of all templates
are ordered by the number of documents that hold them, rarest first; a
matching block must hold one of the first words of the template (prefix
filter), enough template words altogether (length filter), and enough words
after the first shared one on both sides (positional filter).  Only blocks that
pass are compared with the template.  Runs are looked at around the words of
the prefix filter only, first all of them together, then one by one.  Fixed
phrases are found besides.

All steps are DataFrame functions.  Python runs nowhere.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakwise.llm.common import lower_ascii, set_aside, stored, text_or_empty
from peakwise.llm.rules import bound

# The phrases and labels of the contract, the words of a text with its A-Z not yet lowered,
# and the characters between words.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Notices that the join looks for by default: text and label.
TEMPLATES = [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4"),
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
]
THRESHOLD = 0.8


def _words_of(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(WORD_ANY_CASE, lowered)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The template words, those in the fewest documents first, ties by the word.

    ``words`` is the vocabulary of the templates, a parameter; the driver gets
    one count for each.  Every document is counted.
    """
    held = F.array_intersect(F.regexp_extract_all(lower_ascii(text_or_empty("text")), F.lit(WORD_ANY_CASE), F.lit(0)), _strings(words))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    n = dict(counted.collect())
    return sorted(words, key=lambda w: (n.get(w, 0), w))


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text: rows with the same text share what is found in it."""
    return [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(1), text).alias("text_key2")]


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``text_key, text_key2, found_labels, found_score`` of the texts with a block that matches.

    ``found_score`` is the largest share of a template found in one block, a line or a run of words.
    """
    templates = TEMPLATES if templates is None else templates
    sets = [(sorted(set(_words_of(text))), 2 * len(_words_of(text)), label) for text, label in templates]
    sets = [(words, run, label) for words, run, label in sets if words]
    order = word_order(docs, sorted({w for words, _, _ in sets for w in words}))
    rank = {w: i for i, w in enumerate(order)}
    reach = max([run for _, run, _ in sets], default=1)
    index, first_words = [], set()
    for words, run, label in sets:
        words = sorted(words, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        for place, word in enumerate(words[:len(words) - need + 1]):
            index.append((word, place, words, need, run, label))
            first_words.add(word)
    index = docs.sparkSession.createDataFrame(index, "word string, place int, template array<string>, need int, run int, label string")

    text = text_or_empty("text")
    # A quick look for any first word, before lines are cut.
    some = rf"(?i)(?<!{WORD_ANY_CASE[:-1]})(?:{'|'.join(re.escape(w) for w in sorted(first_words)) or '(?!)'})(?!{WORD_ANY_CASE[:-1]})"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(some))
    likely = docs.filter(text.rlike(some))
    blocks = likely.select(*text_keys(text), F.explode(F.array_distinct(lines)).alias("line"))
    held = F.array_intersect(_strings(order), F.regexp_extract_all(lower_ascii(F.col("line")), F.lit(WORD_ANY_CASE), F.lit(0)))
    blocks = blocks.select("text_key", "text_key2", held.alias("held"))
    started = blocks.select("*", F.posexplode("held").alias("at", "word"))
    left = F.least(F.size("template") - F.col("place"), F.size("held") - F.col("at"))
    candidates = started.join(index, "word").filter((F.size("held") >= F.col("need")) & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("template", "held"))
    matched = candidates.withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    matched = matched.select("text_key", "text_key2", "template", "label", "overlap").unionByName(
        _matched_runs(likely, text, sorted(first_words), index, reach))
    return matched.groupBy("text_key", "text_key2").agg(
        F.collect_set("label").alias("found_labels"),  # at most one entry per template
        F.max(F.col("overlap") / F.size("template")).alias("found_score"))


def _matched_runs(docs: DataFrame, text: Column, first_words: list[str], index: DataFrame, reach: int) -> DataFrame:
    """``text_key, text_key2, template, label, overlap`` of the templates found in runs of words, whatever the lines.

    A run that matches holds one of the template's first words; ``near`` is all that such runs can hold, at most
    ``2 * reach - 1`` words with the first word at place ``at``.
    """
    def around(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda h: h["word"].isin(first_words))
        return F.transform(hits, lambda h: F.struct(
            h["word"].alias("word"), F.least(h["i"], F.lit(reach - 1)).alias("at"),
            F.slice(w, F.greatest(h["i"] - reach + 2, F.lit(1)), F.least(h["i"], F.lit(reach - 1)) + reach).alias("near")))

    words = F.regexp_extract_all(lower_ascii(text), F.lit(WORD_ANY_CASE), F.lit(0))
    hits = docs.select(*text_keys(text), F.explode(F.array_distinct(bound(words, around))).alias("hit")).select("text_key", "text_key2", "hit.*")
    begin = F.greatest(F.col("at") - F.col("run") + 1, F.lit(0))
    own = F.slice("near", begin + 1, F.col("at") + F.col("run") - begin)
    hits = hits.join(index, "word").withColumn("own", own)
    hits = hits.filter(F.size(F.array_intersect("template", "own")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("own") - F.col("run"), F.lit(0)) + 1)
    overlap = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect("template", F.slice("own", s, F.col("run"))))))
    return hits.withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need")).select(
        "text_key", "text_key2", "template", "label", "overlap")


def _starts(w: Column, parts: list[str]) -> Column:
    """Numbers of the words at which the phrase stands."""
    def fits(i: Column) -> Column:
        out = F.lit(True)
        for step, part in enumerate(parts):
            out = out & F.coalesce(F.get(w, i + step) == part, F.lit(False))
        return out

    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), fits)


def _phrase_places(words: Column) -> Column:
    """Sorted starts of every phrase and the labels of the phrases found."""
    def places(w: Column) -> Column:
        each = [F.struct(F.lit(label).alias("label"), _starts(w, phrase.split(" ")).alias("starts")) for phrase, label in PHRASES.items()]
        return bound(F.array(*each), lambda found: F.struct(
            F.array_sort(F.flatten(F.transform(found, lambda f: f["starts"]))).alias("starts"),
            F.transform(F.filter(found, lambda f: F.size(f["starts"]) > 0), lambda f: f["label"]).alias("labels")))

    return bound(words, places)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` plus ``n_words, starts, base_labels, labels, score``.

    ``starts`` are the word numbers at which a phrase begins; ``base_labels``
    and ``labels`` are sorted arrays, ``labels`` with those of the templates;
    ``score`` is 1 where a phrase was found, else the largest share of a
    template in one block (0 below the threshold).  NULL and empty texts have no
    words and no labels; equal rows get equal results; columns of ``docs`` with the names of the results are replaced.
    """
    results = ["n_words", "starts", "base_labels", "labels", "score"]
    docs = docs.drop(*results)
    found = stored(template_matches(docs, templates, threshold), "license-matches")
    docs, back = set_aside(docs, ["text_key", "text_key2", "found_labels", "found_score", "base"])
    text = text_or_empty("text")
    edge = WORD_ANY_CASE[:-1]
    phrases = "|".join(phrase.replace(" ", BETWEEN) for phrase in PHRASES)
    has_phrase = text.rlike(rf"(?i)(?<!{edge})(?:{phrases})(?!{edge})")
    words = F.regexp_extract_all(lower_ascii(text), F.lit(WORD_ANY_CASE), F.lit(0))
    base = F.when(has_phrase, _phrase_places(words))
    none = F.array().cast("array<string>")
    keyed = docs.select("*", *text_keys(text), F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"), base.alias("base"))
    base_labels = F.coalesce(F.col("base.labels"), none)
    has_base = F.size(base_labels) > 0
    joined = keyed.join(found, ["text_key", "text_key2"], "left")
    return joined.select(
        *back, "n_words", F.coalesce(F.col("base.starts"), F.array().cast("array<int>")).alias("starts"),
        F.array_sort(base_labels).alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.coalesce(F.col("found_labels"), none))).alias("labels"),
        F.when(has_base, F.lit(1.0)).otherwise(F.coalesce(F.col("found_score"), F.lit(0.0))).alias("score"))
