"""Chemical formulas as text, count maps and derived numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakwise import constants as K

ELEMENT = r"([A-Z][a-z]?)(\d*)"
MAP = "map<string,int>"


def element_tokens(formula: Column) -> Column:
    """Array of (element, n) in order of appearance; a missing number is one."""
    symbols = F.regexp_extract_all(formula, F.lit(ELEMENT), F.lit(1))
    numbers = F.regexp_extract_all(formula, F.lit(ELEMENT), F.lit(2))
    return F.zip_with(
        symbols, numbers,
        lambda s, n: F.struct(s.alias("e"), F.coalesce(F.nullif(n, F.lit("")).try_cast("int"), F.lit(1)).alias("n")),
    )


def counts(formula: Column) -> Column:
    """Count map; repeated symbols add up, entries of zero are dropped."""
    tokens = element_tokens(formula)
    symbols = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: t["e"])))
    total = lambda s: F.aggregate(
        tokens, F.lit(0), lambda acc, t: acc + F.when(t["e"] == s, t["n"]).otherwise(0))
    added = F.transform(symbols, lambda s: F.struct(s.alias("key"), total(s).alias("value")))
    plain = F.transform(F.array_sort(tokens), lambda t: F.struct(t["e"].alias("key"), t["n"].alias("value")))
    # Most formulas name every element once; adding up is needed only for repeats.
    entries = F.when(F.size(symbols) == F.size(tokens), plain).otherwise(added)
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def count(formula: Column, element: str) -> Column:
    """Atoms of one element in a formula text (0 when absent)."""
    return F.aggregate(
        element_tokens(formula), F.lit(0), lambda acc, t: acc + F.when(t["e"] == element, t["n"]).otherwise(0))


def strict_error(formula: Column) -> Column:
    """Why a strict parse refuses the formula (NULL: fine).  Text after the first + or - is ignored."""
    body = F.regexp_extract(formula, r"^([^+-]*)", 1)
    symbols = F.regexp_extract_all(body, F.lit(ELEMENT), F.lit(1))
    return (
        F.when(formula.isNull() | (formula == ""), "missing")
        .when(~body.rlike(rf"^({ELEMENT})*$"), "invalid token")
        .when(F.size(F.array_distinct(symbols)) < F.size(symbols), "repeated element")
    )


def strict_counts(formula: Column) -> Column:
    """Count map of the part before the first + or -, NULL when ``strict_error`` says so."""
    body = F.regexp_extract(formula, r"^([^+-]*)", 1)
    return F.when(strict_error(formula).isNull(), counts(body))


def _render(entries: Column, explicit_one: bool = False) -> Column:
    def piece(e: Column) -> Column:
        number = e["value"].cast("string")
        return F.concat(e["key"], number if explicit_one else F.when(e["value"] == 1, "").otherwise(number))

    return F.array_join(F.transform(entries, piece), "")


def _ordered(count_map: Column, rank) -> Column:
    keyed = F.transform(
        F.filter(F.map_entries(count_map), lambda e: e["value"] > 0),
        lambda e: F.struct(rank(e["key"]).alias("r"), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(keyed)


def hill(count_map: Column) -> Column:
    """C, H, then the rest alphabetically."""
    return _render(_ordered(count_map, lambda k: F.when(k == "C", 0).when(k == "H", 1).otherwise(2)))


def alphabetic(count_map: Column, explicit_one: bool = False) -> Column:
    return _render(_ordered(count_map, lambda k: F.lit(0)), explicit_one)


def canonical(count_map: Column, order: Sequence[str] = K.FORMULA_ELEMENTS) -> Column:
    """Fixed element order, then the other elements alphabetically."""
    positions = F.array(*[F.lit(e) for e in order])

    def rank(k: Column) -> Column:
        at = F.array_position(positions, k)
        return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))

    return _render(_ordered(count_map, rank))


def difference(parent: Column, child: Column) -> Column:
    """Count map parent - child, NULL when any element would be negative."""
    diff = F.map_zip_with(parent, child, lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    negative = F.exists(F.map_values(diff), lambda v: v < 0)
    return F.when(~negative, F.map_filter(diff, lambda k, v: v > 0))


def combine(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def subtract(parent: Column, child: Column) -> Column:
    """Hill formula of the difference, empty when it does not fit."""
    return F.coalesce(hill(difference(counts(parent), counts(child))), F.lit(""))


def _mass_table() -> Column:
    return F.create_map(*[F.lit(x) for e, m in K.ISOTOPE_MASS.items() for x in (e, m)])


def mass_of(count_map: Column) -> Column:
    """Monoisotopic mass of a count map; NULL when an element has no mass in the table.

    Terms are added in alphabetical order of the elements, so equal formulas
    get bit-equal masses.
    """
    table = _mass_table()
    return F.aggregate(
        F.array_sort(F.map_entries(count_map)), F.lit(0.0), lambda acc, e: acc + table[e["key"]] * e["value"])


def exact_mass(formula: Column) -> Column:
    """Monoisotopic mass of a formula text."""
    table = _mass_table()
    return F.aggregate(element_tokens(formula), F.lit(0.0), lambda acc, t: acc + table[t["e"]] * t["n"])


def ion_mz(formula: Column, adduct: Column, isotope: Column | None = None) -> Column:
    """Exact mass plus adduct shift plus isotope number times the neutron mass."""
    shift = F.create_map(*[F.lit(x) for a, m in K.ADDUCT_MASS_SHIFT.items() for x in (a, m)])[adduct]
    extra = F.lit(0.0) if isotope is None else isotope * F.lit(K.NEUTRON_MASS)
    return exact_mass(formula) + shift + extra


def dbe_numerator(formula: Column) -> Column:
    """2C + 2 + N + P - H - halogens, one pass over the tokens."""
    weight = {"C": 2, "N": 1, "P": 1, "H": -1, **{x: -1 for x in K.HALOGENS}}
    table = F.create_map(*[F.lit(x) for pair in weight.items() for x in pair])
    return F.aggregate(
        element_tokens(formula), F.lit(2), lambda acc, t: acc + F.coalesce(table[t["e"]], F.lit(0)) * t["n"])


def dbe(formula: Column) -> Column:
    return dbe_numerator(formula) / 2.0


def halogens(formula: Column) -> Column:
    return F.aggregate(
        element_tokens(formula), F.lit(0),
        lambda acc, t: acc + F.when(t["e"].isin(*K.HALOGENS), t["n"]).otherwise(0))


def elements_subset(formula: Column, allowed: Sequence[str]) -> Column:
    """Whether all elements are allowed; an unparsable formula is not."""
    symbols = F.regexp_extract_all(formula, F.lit(ELEMENT), F.lit(1))
    inside = F.size(F.array_except(symbols, F.array(*[F.lit(a) for a in allowed]))) == 0
    return F.coalesce(strict_error(formula).isNull() & inside, F.lit(False))


def search_space(formula: Column, elements: Sequence[str]) -> Column:
    """Number of sub-formulas over the given elements: product of (n + 1)."""
    m = counts(formula)
    return F.aggregate(
        F.map_entries(F.map_filter(m, lambda k, v: k.isin(list(elements)))), F.lit(1).cast("long"),
        lambda acc, e: acc * (e["value"] + 1))


def _merge_pairs(pairs: Column) -> Column:
    """Count map of (e, n) pairs added up, zero entries dropped."""
    symbols = F.array_sort(F.array_distinct(F.transform(pairs, lambda t: t["e"])))
    total = lambda s: F.aggregate(
        pairs, F.lit(0), lambda acc, t: acc + F.when(t["e"] == s, t["n"]).otherwise(0))
    entries = F.transform(symbols, lambda s: F.struct(s.alias("key"), total(s).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0))


# Fixed value: one signed term of a peak annotation; ``^`` starts the charge.
ANNOTATION_TERM = r"([+\-^]?)([^+\-^]+)"


def annotation_terms(text: Column) -> Column:
    """Terms (sign, body) of an annotation such as ``p-H2O+2i``."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(ANNOTATION_TERM), F.lit(1)),
        F.regexp_extract_all(text, F.lit(ANNOTATION_TERM), F.lit(2)),
        lambda s, b: F.struct(s.alias("sign"), b.alias("body")))


def _is_isotope(body: Column) -> Column:
    return body.endswith("i") & ~body.endswith("Si")


def parse_annotation(text: Column, precursor: Column) -> Column:
    """Struct (formula map, adducts, losses, isotope, charge) of an annotation.

    ``p`` stands for the precursor formula, a leading digit multiplies a term,
    ``i`` terms count isotopes and ``^n`` gives the charge.  Counts may be
    negative when a loss is larger than what it is taken from.
    """
    terms = annotation_terms(text)
    parts = F.filter(terms, lambda t: (t["sign"] != "^") & ~_is_isotope(t["body"]))

    def body_of(t: Column) -> Column:
        return F.regexp_replace(t["body"], r"^\d", "")

    def signed(t: Column) -> Column:
        sign = F.when(t["sign"] == "-", -1).otherwise(1)
        times = F.when(body_of(t) == "p", 1).otherwise(
            F.coalesce(F.nullif(F.regexp_extract(t["body"], r"^(\d)", 1), F.lit("")).try_cast("int"), F.lit(1)))
        tokens = element_tokens(F.when(body_of(t) == "p", precursor).otherwise(body_of(t)))
        return F.transform(tokens, lambda e: F.struct(e["e"].alias("e"), (e["n"] * times * sign).alias("n")))

    def named(sign: str) -> Column:
        return F.transform(F.filter(parts, lambda t: t["sign"] == sign), lambda t: t["body"])

    def isotope_of(t: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(t["body"], r"^(\d*)i$", 1), F.lit("")).try_cast("int"), F.lit(1))
        return F.when(t["sign"] == "-", -number).otherwise(number)

    isotopes = F.transform(F.filter(terms, lambda t: _is_isotope(t["body"])), isotope_of)
    charges = F.filter(terms, lambda t: t["sign"] == "^")
    return F.struct(
        _merge_pairs(F.flatten(F.transform(parts, signed))).alias("formula"),
        named("+").alias("adducts"), named("-").alias("losses"),
        F.coalesce(F.try_element_at(isotopes, F.lit(-1)), F.lit(0)).alias("isotope"),
        F.coalesce(F.try_element_at(charges, F.lit(-1))["body"].try_cast("int"), F.lit(1)).alias("charge"),
    )


def annotation_error(text: Column) -> Column:
    """Why an annotation cannot be parsed (NULL: fine)."""
    bad_term = F.exists(
        annotation_terms(text),
        lambda t: ~F.when(t["sign"] == "^", t["body"].rlike(r"^\d+$"))
        .when(_is_isotope(t["body"]), t["body"].rlike(r"^\d*i$"))
        .otherwise(t["body"].rlike(r"^\d?(p|([A-Z][a-z]?\d*)+)$")))
    return F.when(F.length(text) == 0, "empty annotation").when(bad_term, "invalid term")
