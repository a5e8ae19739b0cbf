"""Normalisation of library metadata as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakwise import constants as K

FLOAT = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def lookup(key: Column, table: dict, kind: str) -> Column:
    """Value of a small fixed table, NULL for other keys."""
    cells = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*cells)[key].cast(kind)


def optional_string(s: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.regexp_replace(s, r"^\s+|\s+$", ""), F.lit(""))


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def optional_float(s: Column) -> Column:
    """First number found in the text, NULL when there is none or it is not finite."""
    found = F.nullif(F.regexp_extract(s, FLOAT, 0), F.lit(""))
    return _finite(found.try_cast("double"))


def name_key(s: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(optional_string(s)), "[^a-z0-9]+", "")


def upper_key(s: Column) -> Column:
    return F.upper(optional_string(s))


def squeezed(s: Column) -> Column:
    """Lower case without blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(s), "[ _-]", "")


def adduct(s: Column) -> Column:
    t = optional_string(s)
    key = F.upper(F.replace(t, F.lit(" "), F.lit("")))
    return (
        F.when(key.isin("[M+H]+", "M+H", "M+H+"), "[M+H]+")
        .when(key.isin("[M+NA]+", "M+NA", "M+NA+"), "[M+Na]+")
        .when(key.isin("[M+NH4]+", "M+NH4", "M+NH4+"), "[M+NH4]+")
        .otherwise(t)
    )


def precursor_type(s: Column) -> Column:
    """Drops an explicit charge of one and spells the formate adduct as a formula."""
    t = F.nullif(s, F.lit(""))
    short = (
        F.when(t.endswith("1+"), F.replace(t, F.lit("1+"), F.lit("+")))
        .when(t.endswith("1-"), F.replace(t, F.lit("1-"), F.lit("-")))
        .otherwise(t)
    )
    return F.when(t == "EI", "EI").when(short == "[M+FA-H]-", "[M+CH2O2-H]-").otherwise(short)


def instrument(s: Column) -> Column:
    t = optional_string(s)
    key = squeezed(t)
    return (
        F.when(key.contains("orbitrap"), "Orbitrap")
        .when(key.contains("qtof") | key.contains("quadrupoletof"), "QTOF")
        .when(key.contains("itft"), "ITFT")
        .otherwise(t)
    )


def joined_fields(*fields: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(f, F.lit("")) for f in fields])


def platform(*fields: Column) -> Column:
    """Analyser class from several free-text fields."""
    key = F.regexp_replace(F.lower(joined_fields(*fields)), "[^a-z0-9]+", "")
    any_of = lambda *words: F.greatest(*[key.contains(w) for w in words], F.lit(False))
    return (
        F.when(any_of("orbitrap", "qexactive", "exactive"), "Orbitrap")
        .when(any_of("qtof", "quadrupoletof", "quadtof"), "QTOF")
        .when(any_of("itft", "iontrapft"), "ITFT")
        .when(key.contains("fticr"), "FTICR")
        .when(key.contains("iontrap"), "IonTrap")
        .otherwise("<unknown>")
    )


def _method(low: Column, key: Column) -> Column:
    hcd = low.contains("hcd") | low.contains("higher-energy") | low.contains("higher energy") | key.contains("higherenergy")
    cid = (
        low.contains("cid") | low.contains("collision-induced") | low.contains("collision induced")
        | key.contains("collisioninduceddissociation")
    )
    return F.when(hcd, "HCD").when(cid, "CID").when(low.contains("etd"), "ETD")


def fragmentation_method(s: Column) -> Column:
    """HCD, CID or ETD; analyser names give NULL."""
    t = optional_string(s)
    return _method(F.lower(t), squeezed(t))


def fragmentation_method_of(*fields: Column) -> Column:
    text = F.lower(joined_fields(*fields))
    return F.coalesce(_method(text, F.regexp_replace(text, "[^a-z0-9]+", "")), F.lit("<unknown>"))


def instrument_class(type_text: Column, name_text: Column) -> Column:
    """Class by type string, else by instrument name; unknown texts are Other, both missing NULL."""
    t, n = F.nullif(type_text, F.lit("")), F.nullif(name_text, F.lit(""))
    by_type = F.coalesce(lookup(t, K.INSTRUMENT_TYPE_CLASS, "string"), F.lit("Other"))
    by_name = F.coalesce(lookup(n, K.INSTRUMENT_NAME_CLASS, "string"), F.lit("Other"))
    return F.when(t.isNotNull(), by_type).when(n.isNotNull(), by_name)


def fragmentation_mode(type_text: Column, energy_text: Column, mode_text: Column) -> Column:
    """HCD by type, energy text or mode; CID when missing; other modes NULL."""
    mode = F.nullif(mode_text, F.lit(""))
    return (
        F.when(type_text == "HCD", "HCD")
        .when(energy_text.contains("HCD"), "HCD")
        .when(mode.isNull() | (mode == "CID"), "CID")
        .when(mode == "HCD", "HCD")
    )


def ion_mode(s: Column) -> Column:
    return (
        F.when(s.isin("P", "N", "E", "EI"), s).when(s == "POSITIVE", "P").when(s == "NEGATIVE", "N")
    )


def charge(s: Column) -> Column:
    """Signed charge written after the closing bracket; EI is one."""
    pattern = r"\]([0-9]*)([+-])$"
    size = F.coalesce(F.nullif(F.regexp_extract(s, pattern, 1), F.lit("")).cast("int"), F.lit(1))
    sign = F.regexp_extract(s, pattern, 2)
    return F.when(s == "EI", 1).when(sign == "+", size).when(sign == "-", -size)


def nce_value(s: Column) -> Column:
    """Number after ``nce=``, else the first number."""
    named = F.nullif(F.regexp_extract(F.lower(s), r"nce\s*=\s*([-+]?\d*\.?\d+)", 1), F.lit(""))
    return F.coalesce(named.try_cast("double"), optional_float(s))


def charge_factor(charge_col: Column, beyond: float) -> Column:
    """Energy factor of the absolute charge; ``beyond`` for charges outside the table."""
    return F.coalesce(lookup(F.abs(charge_col).cast("int"), K.CHARGE_FACTOR, "double"), F.lit(beyond))


def nce_to_ev(nce: Column, precursor_mz: Column, charge_col: Column, beyond: float = 1.0) -> Column:
    ok = precursor_mz.isNotNull() & ~F.isnan(precursor_mz) & (precursor_mz > 0)
    return F.when(ok, nce * precursor_mz / 500.0 * charge_factor(charge_col, beyond))


def ev_to_nce(ev: Column, precursor_mz: Column, charge_col: Column, beyond: float = 0.75) -> Column:
    return ev * 500.0 / F.nullif(precursor_mz * charge_factor(charge_col, beyond), F.lit(0.0))


def with_collision_energy(
    df: DataFrame, raw: Column, precursor_mz: Column, instrument_text: Column, charge_col: Column
) -> DataFrame:
    """Adds ce_ev, ce_raw, ce_type, ce_ok: keV, eV, normalised, then bare numbers by instrument.

    The text, its number and the rule that fits are separate columns so that
    each regular expression runs once per row.
    """
    rows = df.withColumns({
        "__raw": optional_string(raw), "__z": charge_col, "__m": precursor_mz,
        "__inst": F.lower(F.trim(F.coalesce(instrument_text, F.lit("")))),
    }).withColumns({"__low": F.lower("__raw"), "__value": optional_float(F.col("__raw"))})
    low, value = F.col("__low"), F.col("__value")
    nce_inst = F.lit(False)
    for word in K.NCE_INSTRUMENTS:
        nce_inst = nce_inst | F.col("__inst").contains(word)
    normalised = low.contains("nce") | low.contains("hcd") | low.contains("%") | low.contains("nominal")
    rule = (
        F.when(F.col("__raw").isNull(), "missing").when(value.isNull(), "unknown")
        .when(low.contains("kev"), "keV").when(low.contains("ev"), "eV").when(normalised, "NCE")
        .when(nce_inst, "numeric_NCE").otherwise("numeric_eV")
    )
    rows = rows.withColumn("__rule", rule)
    rule = F.col("__rule")
    ev = (
        F.when(rule == "keV", value * 1000.0).when(rule.isin("eV", "numeric_eV"), value)
        .when(rule.isin("NCE", "numeric_NCE"), nce_to_ev(value, F.col("__m"), F.col("__z")))
    )
    rows = rows.withColumn("ce_ev", ev)
    unresolved = rule.isin("NCE", "numeric_NCE") & F.col("ce_ev").isNull()
    return rows.withColumns({
        "ce_raw": F.col("__raw"),
        "ce_type": F.when(unresolved, F.concat(rule, F.lit("_unresolved"))).otherwise(rule),
        "ce_ok": F.col("ce_ev").isNotNull().cast("int"),
    }).drop("__raw", "__z", "__m", "__inst", "__low", "__value", "__rule")


_NUM = r"([0-9]+[.]?[0-9]*)"
# Whole-text patterns of an absolute energy, in order.
ABSOLUTE_ENERGY_PATTERNS = (
    rf"^{_NUM}$", rf"^{_NUM}[ ]?eV$", rf"^NCE=[0-9]+[.]?[0-9]*% {_NUM}eV$", rf"^{_NUM}HCD$", rf"^CE {_NUM}$",
)
# Whole-text patterns of a normalised energy, in order; the bare
# number (fourth) counts as a fraction below 2 and as unknown otherwise.
NORMALISED_ENERGY_PATTERNS = (
    rf"^NCE={_NUM}% [0-9]+[.]?[0-9]*eV$", rf"^NCE={_NUM}%$", r"^([0-9]+)% resonant relative/normalized$",
    rf"^{_NUM}$", rf"^{_NUM}[ ]?[%]? \(nominal\)$", rf"^HCD {_NUM}%$", rf"^{_NUM} NCE$", rf"^{_NUM}\(NCE\)$",
    rf"^{_NUM}[ ]?%$", rf"^HCD \(NCE {_NUM}%\)$",
)


def strict_absolute_energy(s: Column) -> Column:
    out = F.lit(None).cast("double")
    for pattern in reversed(ABSOLUTE_ENERGY_PATTERNS):
        out = F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1).try_cast("double")).otherwise(out)
    return out


def strict_normalised_energy(s: Column) -> Column:
    out = F.lit(None).cast("double")
    for i, pattern in reversed(list(enumerate(NORMALISED_ENERGY_PATTERNS))):
        value = F.regexp_extract(s, pattern, 1).try_cast("double")
        if i == 3:
            value = F.when(value < 2.0, value * 100.0)
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def energy_dialect(s: Column) -> Column:
    """Struct (text, normalized, ramped) from ``<value> normalized=.. ramped=..`` texts."""
    first = F.split_part(s, F.lit(" "), F.lit(1))
    normal = F.coalesce(s.contains("normalized=True"), F.lit(False))
    text = F.when(s.isNull(), "").when(normal, F.concat(F.lit("NCE="), first, F.lit("%"))).otherwise(
        F.concat(first, F.lit(" eV")))
    return F.struct(text.alias("text"), normal.alias("normalized"),
                    F.coalesce(s.contains("ramped=True"), F.lit(False)).alias("ramped"))


def infer_precursor(precursor_mz: Column, exact_mass: Column, adduct_col: Column, ms2: Column) -> Column:
    """Missing MS2 precursors from exact mass plus adduct shift."""
    shift = lookup(adduct_col, K.PRECURSOR_INFERENCE_SHIFT, "double")
    return F.coalesce(precursor_mz, F.when(ms2, exact_mass + shift))


def candidate_adduct_shift(s: Column, mode: str = "table") -> Column:
    """Shift of neutral candidate masses; unknown or missing adducts count as protonated."""
    if mode in ("none", "neutral"):
        return F.lit(0.0)
    if mode == "mh_only":
        return F.lit(K.PROTON_MASS)
    key = F.upper(F.replace(F.coalesce(s, F.lit("")), F.lit(" "), F.lit("")))
    return F.coalesce(lookup(key, K.CANDIDATE_ADDUCT_SHIFT, "double"), F.lit(K.PROTON_MASS))


def encode_adduct(s: Column, missing: int = 0, unknown: int = 0) -> Column:
    t = F.trim(s)
    code = F.coalesce(lookup(t, K.ADDUCT_VOCABULARY, "int"), F.lit(unknown))
    return F.when(t.isNull() | (t == ""), missing).otherwise(code)


def encode_instrument(s: Column, missing: int = 0, unknown: int = 0) -> Column:
    """Exact word first, then the class contained in the text."""
    key = squeezed(F.trim(s))
    vocab = K.INSTRUMENT_VOCABULARY
    fuzzy = F.lit(unknown)
    for word in ("triplequad", "fticr", "iontrap", "qtof", "orbitrap"):
        fuzzy = F.when(key.contains(word), vocab[word]).otherwise(fuzzy)
    code = F.coalesce(lookup(key, vocab, "int"), fuzzy)
    return F.when(s.isNull() | (F.trim(s) == ""), missing).otherwise(code)


def encode_ms_level(s: Column, missing: int = 0, unknown: int = 0) -> Column:
    """Whole part of a numeric text, else the first digits."""
    t = F.trim(s)
    number = F.when(t.rlike(rf"^{FLOAT}$"), t.try_cast("double").cast("int"))
    digits = F.nullif(F.regexp_extract(t, "[0-9]+", 0), F.lit("")).try_cast("int")
    return F.when(t.isNull() | (t == ""), missing).otherwise(F.coalesce(number, digits, F.lit(unknown)))


def numeric_string(s: Column) -> Column:
    """Whole text as a number, NULL when missing or malformed."""
    t = F.trim(s)
    return F.when(t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), t.try_cast("double"))


# Fixed value: token pattern of a SMILES string.
SMILES_TOKEN = (
    r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|[0-9])"
)


def smiles_tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(SMILES_TOKEN), F.lit(1))


def smiles_valid(s: Column) -> Column:
    """Whether the tokens give the text back."""
    return F.array_join(smiles_tokens(s), "") == s


def decimals(s: Column) -> Column:
    """Digits after the decimal point of a numeric text."""
    return F.when(s.contains("."), F.length(F.substring_index(s, ".", -1))).otherwise(0)


def short_key(s: Column) -> Column:
    return F.left(s, F.lit(14))


def group_key(inchikey: Column, smiles: Column, source_id: Column) -> Column:
    """Leakage group: structure key, else SMILES, else the source id."""
    k, m = upper_key(inchikey), optional_string(smiles)
    return F.coalesce(
        F.concat(F.lit("inchikey:"), k), F.concat(F.lit("smiles:"), m),
        F.concat(F.lit("source_id:"), F.coalesce(source_id.cast("string"), F.lit("None"))),
    )


def content_key(precursor_mz: Column, **conditions: Column) -> Column:
    """SHA-1 of the conditions as JSON with sorted names, precursor at four decimals."""
    fields = {**conditions, "precursor_mz": F.format_string("%.4f", F.round(precursor_mz, 4))}
    return F.sha1(F.to_json(F.struct(*[fields[n].cast("string").alias(n) for n in sorted(fields)])))


def one_hot(values: list[Column], sizes: list[int], cumulative: bool = False) -> Column:
    """Concatenated one-hot blocks; cumulative blocks are ones below the value."""
    def block(value: Column, size: int) -> Column:
        def cell(i: Column) -> Column:
            return F.coalesce(((i < value) if cumulative else (i == value)).cast("int"), F.lit(0))

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell)

    return F.concat(*[block(v, n) for v, n in zip(values, sizes)])
