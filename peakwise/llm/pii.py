"""Personal data: fixed patterns and information-theoretic sanitisation.

Patterns find protected entities (addresses, numbers).  A term that stands in
the documents of an entity, wherever in them, tells something about it: with
document counts its pointwise mutual information is
``ln(n(e, t) N / (n(e) n(t)))``, and the entity's own information
``ln(N / n(e))``.  A term whose share of that information reaches
``DISCLOSURE`` and that shares at least ``SUPPORT`` different texts with the
entity is sanitised wherever it stands: generalised, or removed if it occurs
in no document without the entity.  Counts cover every document.  An entity in
fewer than ``SUPPORT`` different texts reveals no term.

All steps are DataFrame functions.  Python runs nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakwise.llm.common import lower_ascii, set_aside, stored, text_or_empty
from peakwise.llm.licenses import text_keys
from peakwise.llm.rules import bound

# Kinds and patterns of the contract.  The patterns match the same texts as the plain ones;
# a match may begin only at the start of a run or where the last match ended (\G), and possessive
# quantifiers never give back, so that long runs of digits or letters take linear time and no stack.
KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # The maximal runs of digits with single separators that have 12 to 19 digits; other runs fail anyway.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
TERM = r"\p{L}[\p{L}\p{N}]+"
# Parameters of the sanitisation.
SUPPORT = 3
DISCLOSURE = 0.95
SPAN = "struct<start:int,k:int,end:int,value:string>"


def _valid(kind: str, value: Column) -> Column:
    digits = lambda chars: F.regexp_replace(value, chars, "")
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", digits(r"[\x20-]"))
    if kind == "phone":
        return F.length(digits("[^0-9]")).between(9, 15)
    return F.lit(True)


# Spans are measured and written in blocks of this many, so that arrays and texts that grow by a step stay short.
BLOCK = 64


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column, use: Callable[[Column], Column]) -> Column:
    """``use(block)`` of the blocks of an array, in order."""
    number = F.ceil(F.size(items) / BLOCK).cast("int")
    each = F.transform(F.sequence(F.lit(0), number - 1), lambda i: use(F.slice(items, i * BLOCK + 1, F.lit(BLOCK))))
    return F.when(number > 0, each).otherwise(F.array())


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What came before each value: 0, then the values so far put together by ``join``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))
    step = lambda state, v: F.struct(join(state["at"], v).alias("at"), F.array_append(state["before"], state["at"]).alias("before"))
    return F.aggregate(values, start, step, lambda state: state["before"])


def _located(text: Column, pattern: str, k: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the matches that ``keep`` accepts, with code-point offsets: gaps and matches are measured in turn.

    Offsets are first taken from the start of a block of matches, then moved by what lies before the block.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + piece["gap"]
        end = begin + F.coalesce(F.length(piece["match"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(k).alias("k"), end.alias("end"), piece["match"].alias("value"))
        hit = piece["match"].isNotNull() & keep(piece["match"])
        return F.struct(end.alias("at"), F.when(hit, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def moved(block: Column, by: Column) -> Column:
        return F.transform(block["spans"], lambda s: F.struct(
            (s["start"] + by).alias("start"), s["k"].alias("k"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    measured = _bound(pieces, lambda p: _blocks(p, lambda block: F.aggregate(block, start, step)))
    return _bound(measured, lambda m: F.flatten(F.zip_with(m, _running(F.transform(m, lambda b: b["at"]), lambda x, y: x + y), moved)))


def base_spans(text: Column) -> Column:
    """All valid matches of the patterns in a text, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")
    maybe = {"email": text.contains("@"), "phone": text.contains("+")}
    each = [F.when(maybe.get(kind, F.lit(True)) & text.rlike(pattern), _located(text, pattern, k, lambda m, kind=kind: _valid(kind, m)))
            .otherwise(none) for k, (kind, pattern) in enumerate(PATTERNS.items())]
    return F.sort_array(F.concat(*each))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``term, term_hash, share``: terms that reveal an entity, with the largest share of its information.

    A share of ``disclosure`` needs ``n(t) <= n(e) (N / n(e)) ** (1 - disclosure)``, so terms in more documents are left
    out before they are paired with entities; so are entities in fewer than ``support`` different texts.
    """
    total = float(max(docs.count(), 1))
    keys = ["text_key", "text_key2"]
    with_entity = found.select(*keys, "copies", F.explode(F.array_distinct(F.transform(
        "spans", lambda s: F.xxhash64(s["k"], s["value"])))).alias("entity"))
    # One row per (entity, text); the copies of a text count for documents, not for texts.
    entities = with_entity.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    most = F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - disclosure)) * (1 + 1e-9)
    held = stored(with_entity.join(entities.select("entity", "n_e", most.alias("most")), "entity"), "pii-entities")
    most_of_all = held.agg(F.max("most")).first()[0] or 0.0
    words = docs.select(F.explode(F.array_distinct(_terms(text_or_empty("text")))).alias("term"))
    n_t = words.groupBy(F.xxhash64("term").alias("term_hash")).agg(F.count(F.lit(1)).alias("n_t"))
    n_t = stored(n_t.filter(F.col("n_t").between(support, most_of_all)), "pii-term-counts")
    texts = found.join(held.select(*keys).distinct(), keys, "left_semi")
    terms = texts.select(*keys, F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    terms = terms.withColumn("term_hash", F.xxhash64("term")).join(n_t, "term_hash")
    pairs = terms.join(held, keys).filter(F.col("n_t") <= F.col("most"))
    pairs = pairs.groupBy("entity", "term", "term_hash", "n_e", "n_t").agg(F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("texts"))
    information = F.log(F.lit(total) / F.col("n_e"))
    share = F.when(information > 0, 1 + F.log(F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0))) / information).otherwise(F.lit(0.0))
    found_terms = pairs.filter(F.col("texts") >= support).groupBy("term", "term_hash").agg(F.max(share).alias("share"))
    return found_terms.filter(F.col("share") >= disclosure)


def find_personal_data(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Every row of ``docs`` plus ``spans`` and ``removed``.

    ``spans``: array of (start, k, end, value) by start and kind, ``k`` the
    place in ``KINDS``, offsets in code points, end exclusive; the last kind
    are disclosing terms.  ``removed`` lists those of them that occur in the
    documents of one entity only.  NULL and empty texts have no spans; equal texts have equal
    spans; columns of ``docs`` with the names of the results are replaced.
    """
    docs = docs.drop("spans", "removed")
    docs, back = set_aside(docs, ["text_key", "text_key2", "flagged", "sure", "base"])
    text = text_or_empty("text")
    spans = base_spans(text)
    keys = [k for k in ("text_key", "text_key2")]
    found = docs.select(*text_keys(text), text.alias("text"), spans.alias("spans")).filter(F.size("spans") > 0)
    found = stored(found.groupBy(*keys).agg(
        F.any_value("text").alias("text"), F.any_value("spans").alias("spans"), F.count(F.lit(1)).alias("copies")), "pii-found")
    terms = stored(disclosing_terms(docs, found, support, disclosure), "pii-terms")
    held = docs.select(*text_keys(text), F.explode(F.array_distinct(_terms(text))).alias("term"))
    held = held.withColumn("term_hash", F.xxhash64("term")).join(terms, ["term_hash", "term"])
    flagged = stored(held.groupBy(*keys).agg(
        F.collect_set("term").alias("flagged"),  # no more than the words of one text
        F.collect_set(F.when(F.col("share") >= 1, F.col("term"))).alias("sure")), "pii-flagged")
    joined = docs.select("*", *text_keys(text), spans.alias("base")).join(flagged, keys, "left")
    more = _located(lower_ascii(text), TERM, len(PATTERNS), lambda m: F.array_contains("flagged", m))
    none = F.array().cast(f"array<{SPAN}>")
    more = F.filter(F.when(F.size("flagged") > 0, more).otherwise(none),
                    lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select(*back, F.sort_array(F.concat(F.col("base"), more)).alias("spans"),
                         F.coalesce(F.col("sure"), F.array().cast("array<string>")).alias("removed"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced: ``[EMAIL]`` and so on, disclosing terms by ``[TERM]`` or nothing.

    Of spans that overlap the first stays and takes the text up to the end of the last.
    """
    docs, back = set_aside(docs, ["spans", "removed"])
    found = find_personal_data(docs, **options)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def write_block(block: Column, begin: Column) -> Column:
        """The text from ``begin``, where the spans before this block end, up to the end of the last span of the block."""
        near = F.substring(text, begin + 1, F.greatest(F.element_at(block, -1)["start"] - begin, F.lit(0)))
        start = F.struct(begin.alias("at"), F.lit("").alias("out"))

        def step(part: Column) -> Callable[[Column, Column], Column]:
            def one(state: Column, s: Column) -> Column:
                shown = F.when((s["k"] == len(PATTERNS)) & F.array_contains("removed", s["value"]), F.lit("")).otherwise(F.get(names, s["k"]))
                kept = F.substring(part, state["at"] - begin + 1, s["start"] - state["at"])
                inside = s["start"] < state["at"]
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                                F.when(inside, state["out"]).otherwise(F.concat(state["out"], kept, shown)).alias("out"))
            return one

        return _bound(near, lambda part: F.aggregate(block, start, step(part), lambda state: state["out"]))

    def write(spans: Column) -> Column:
        last = lambda block: F.array_max(F.transform(block, lambda s: s["end"]))

        def joined(blocks: Column) -> Column:
            ends = F.transform(blocks, last)
            before = _running(ends, lambda x, y: F.greatest(x, y))
            rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
            return F.concat(F.array_join(F.zip_with(blocks, before, write_block), ""), rest)

        return _bound(_blocks(spans, lambda block: block), joined)

    written = F.when(F.size("spans") > 0, write(F.col("spans"))).otherwise(text)
    return found.withColumn("text", written).select(*back)
