"""Queries for metadata normalisation.  Raw texts are derived from the given tables."""

from pyspark.sql import functions as F

from peakwise import constants as K
from peakwise.functions import normalize as N
from peakwise.plans.registry import query
from peakwise.skew import r6

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def opt(x):
    return f"nullif({TRIM.format(x)}, '')"


def first_float(x):
    return f"TRY_CAST(nullif(regexp_extract({x}, '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?', 0), '') AS double)"


def case_map(key, table):
    def q(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def squeeze(x):
    return f"regexp_replace(lower({x}), '[ _-]', '', 'g')"


# Texts derived from orders, one spelling per key class.
def texts(d):
    k = F.col("spectrum_id")

    def pick(modulus, *options):
        out = F.lit(None).cast("string")
        for i, o in enumerate(options):
            out = F.when(k % modulus == i, o if not isinstance(o, str) else F.lit(o)).otherwise(out)
        return out

    n = (k % 90).cast("string")
    return d.spectra.select(
        "*",
        pick(7, "[M+H]1+", "[M-H]1-", "[M+FA-H]-", "EI", "[M+2H]2+", "[M+Na]+").alias("prec_type"),
        pick(6, "P", "POSITIVE", "NEGATIVE", "EI", "other").alias("ion_text"),
        pick(9, "HCD", "Q-TOF", "IT/ion trap", "Orbitrap", "ESI-QTOF", "", "LC-ESI-QFT", "strange").alias("inst_type"),
        pick(4, "Orbitrap", "Maxis II HD Q-TOF Bruker", "odd").alias("inst_name"),
        pick(5, "CID", "HCD", "ECD", "higher-energy dissociation").alias("mode_text"),
        pick(14, n, F.concat(n, F.lit(" eV")), F.concat(F.lit("NCE="), n, F.lit("% 12.5eV")), F.concat(n, F.lit("HCD")),
             F.concat(F.lit("CE "), n), F.concat(F.lit("NCE="), n, F.lit("%")),
             F.concat(n, F.lit("% resonant relative/normalized")), F.concat(n, F.lit(" % (nominal)")),
             F.concat(F.lit("HCD "), n, F.lit("%")), F.concat(n, F.lit(" NCE")), F.concat(n, F.lit("(NCE)")),
             F.concat(n, F.lit(" %")), F.concat(F.lit("HCD (NCE "), n, F.lit("%)"))).alias("energy_text"),
        pick(4, F.concat(n, F.lit(" normalized=True")), F.concat(n, F.lit(" ramped=True")), n).alias("dialect_text"),
        pick(5, "MS2", "2", "3.0", "ms level", "").alias("level_text"),
        pick(3, F.concat(F.lit(" "), n, F.lit(".5 ")), F.concat(F.lit("ri "), n)).alias("ri_text"),
        F.concat(F.lit("C(=O)N"), F.repeat(F.lit("c1ccccc1Cl"), (k % 3 + 1).cast("int")),
                 pick(3, "[NH4+]", "Br%12", "xyz")).alias("smiles_text"),
    )


TEXTS_SQL = """texts AS (SELECT *, CAST(spectrum_id % 90 AS varchar) AS n,
  CASE spectrum_id % 7 WHEN 0 THEN '[M+H]1+' WHEN 1 THEN '[M-H]1-' WHEN 2 THEN '[M+FA-H]-' WHEN 3 THEN 'EI'
    WHEN 4 THEN '[M+2H]2+' WHEN 5 THEN '[M+Na]+' END AS prec_type,
  CASE spectrum_id % 6 WHEN 0 THEN 'P' WHEN 1 THEN 'POSITIVE' WHEN 2 THEN 'NEGATIVE' WHEN 3 THEN 'EI' WHEN 4 THEN 'other' END AS ion_text,
  CASE spectrum_id % 9 WHEN 0 THEN 'HCD' WHEN 1 THEN 'Q-TOF' WHEN 2 THEN 'IT/ion trap' WHEN 3 THEN 'Orbitrap'
    WHEN 4 THEN 'ESI-QTOF' WHEN 5 THEN '' WHEN 6 THEN 'LC-ESI-QFT' WHEN 7 THEN 'strange' END AS inst_type,
  CASE spectrum_id % 4 WHEN 0 THEN 'Orbitrap' WHEN 1 THEN 'Maxis II HD Q-TOF Bruker' WHEN 2 THEN 'odd' END AS inst_name,
  CASE spectrum_id % 5 WHEN 0 THEN 'CID' WHEN 1 THEN 'HCD' WHEN 2 THEN 'ECD' WHEN 3 THEN 'higher-energy dissociation' END AS mode_text,
  CASE spectrum_id % 14 WHEN 0 THEN n WHEN 1 THEN concat(n, ' eV') WHEN 2 THEN concat('NCE=', n, '% 12.5eV')
    WHEN 3 THEN concat(n, 'HCD') WHEN 4 THEN concat('CE ', n) WHEN 5 THEN concat('NCE=', n, '%')
    WHEN 6 THEN concat(n, '% resonant relative/normalized') WHEN 7 THEN concat(n, ' % (nominal)')
    WHEN 8 THEN concat('HCD ', n, '%') WHEN 9 THEN concat(n, ' NCE') WHEN 10 THEN concat(n, '(NCE)')
    WHEN 11 THEN concat(n, ' %') WHEN 12 THEN concat('HCD (NCE ', n, '%)') END AS energy_text,
  CASE spectrum_id % 4 WHEN 0 THEN concat(n, ' normalized=True') WHEN 1 THEN concat(n, ' ramped=True') WHEN 2 THEN n END AS dialect_text,
  CASE spectrum_id % 5 WHEN 0 THEN 'MS2' WHEN 1 THEN '2' WHEN 2 THEN '3.0' WHEN 3 THEN 'ms level' WHEN 4 THEN '' END AS level_text,
  CASE spectrum_id % 3 WHEN 0 THEN concat(' ', n, '.5 ') WHEN 1 THEN concat('ri ', n) END AS ri_text,
  concat('C(=O)N', repeat('c1ccccc1Cl', spectrum_id % 3 + 1),
    CASE spectrum_id % 3 WHEN 0 THEN '[NH4+]' WHEN 1 THEN 'Br%12' ELSE 'xyz' END) AS smiles_text
FROM spectra)"""


def tq(name, select):
    """A query over the derived texts: SQL select list next to its Spark columns."""
    return query(name, f"WITH {TEXTS_SQL} SELECT spectrum_id, {select} FROM texts", "spectra")


@tq("n01_optional_values", f"{opt('ri_text')} AS text, round({first_float('ri_text')}, 6) AS number")
def _(d):
    return texts(d).select("spectrum_id", N.optional_string(F.col("ri_text")).alias("text"),
                           r6(N.optional_float(F.col("ri_text"))).alias("number"))


@tq("n02_name_key", "regexp_replace(lower(mode_text), '[^a-z0-9]+', '', 'g') AS key")
def _(d):
    return texts(d).select("spectrum_id", N.name_key(F.col("mode_text")).alias("key"))


ADDUCT_SQL = """CASE WHEN upper(replace(adduct_raw, ' ', '')) IN ('[M+H]+', 'M+H', 'M+H+') THEN '[M+H]+'
  WHEN upper(replace(adduct_raw, ' ', '')) IN ('[M+NA]+', 'M+NA', 'M+NA+') THEN '[M+Na]+'
  WHEN upper(replace(adduct_raw, ' ', '')) IN ('[M+NH4]+', 'M+NH4', 'M+NH4+') THEN '[M+NH4]+' ELSE adduct_raw END"""
INSTRUMENT_SQL = f"""CASE WHEN contains({squeeze('instrument_raw')}, 'orbitrap') THEN 'Orbitrap'
  WHEN contains({squeeze('instrument_raw')}, 'qtof') OR contains({squeeze('instrument_raw')}, 'quadrupoletof') THEN 'QTOF'
  WHEN contains({squeeze('instrument_raw')}, 'itft') THEN 'ITFT' ELSE instrument_raw END"""


@tq("n03_adduct", f"{ADDUCT_SQL} AS adduct")
def _(d):
    return texts(d).select("spectrum_id", N.adduct(F.col("adduct_raw")).alias("adduct"))


PREC_SQL = """CASE WHEN prec_type = 'EI' THEN 'EI' WHEN prec_type LIKE '%1+' THEN replace(prec_type, '1+', '+')
  WHEN prec_type LIKE '%1-' THEN replace(prec_type, '1-', '-') WHEN prec_type = '[M+FA-H]-' THEN '[M+CH2O2-H]-'
  ELSE prec_type END"""


@tq("n04_precursor_type", f"{PREC_SQL} AS prec_type")
def _(d):
    return texts(d).select("spectrum_id", N.precursor_type(F.col("prec_type")).alias("prec_type"))


@tq("n05_instrument", f"{INSTRUMENT_SQL} AS instrument")
def _(d):
    return texts(d).select("spectrum_id", N.instrument(F.col("instrument_raw")).alias("instrument"))


_PF = "regexp_replace(lower(concat(coalesce(instrument_raw, ''), ' | ', coalesce(inst_type, ''))), '[^a-z0-9]+', '', 'g')"


@tq("n06_platform", f"""CASE WHEN contains({_PF}, 'orbitrap') OR contains({_PF}, 'exactive') THEN 'Orbitrap'
  WHEN contains({_PF}, 'qtof') OR contains({_PF}, 'quadrupoletof') OR contains({_PF}, 'quadtof') THEN 'QTOF'
  WHEN contains({_PF}, 'itft') OR contains({_PF}, 'iontrapft') THEN 'ITFT'
  WHEN contains({_PF}, 'fticr') THEN 'FTICR' WHEN contains({_PF}, 'iontrap') THEN 'IonTrap' ELSE '<unknown>' END AS platform""")
def _(d):
    return texts(d).select("spectrum_id", N.platform(F.col("instrument_raw"), F.col("inst_type")).alias("platform"))


@tq("n07_fragmentation_method", """CASE WHEN lower(mode_text) LIKE '%hcd%' OR lower(mode_text) LIKE '%higher-energy%' THEN 'HCD'
  WHEN lower(mode_text) LIKE '%cid%' THEN 'CID' WHEN lower(mode_text) LIKE '%etd%' THEN 'ETD' END AS method""")
def _(d):
    return texts(d).select("spectrum_id", N.fragmentation_method(F.col("mode_text")).alias("method"))


_MF = "lower(concat_ws(' | ', coalesce(inst_type, ''), coalesce(instrument_raw, ''), coalesce(ce_raw, ''), coalesce(mode_text, '')))"


@tq("n08_method_over_fields", f"""CASE WHEN {_MF} LIKE '%hcd%' OR {_MF} LIKE '%higher-energy%' THEN 'HCD'
  WHEN {_MF} LIKE '%cid%' THEN 'CID' WHEN {_MF} LIKE '%etd%' THEN 'ETD' ELSE '<unknown>' END AS method""")
def _(d):
    cols = [F.col(c) for c in ("inst_type", "instrument_raw", "ce_raw", "mode_text")]
    return texts(d).select("spectrum_id", N.fragmentation_method_of(*cols).alias("method"))


@tq("n09_instrument_class", f"""
  CASE WHEN nullif(inst_type, '') IS NOT NULL THEN coalesce({case_map('inst_type', K.INSTRUMENT_TYPE_CLASS)}, 'Other')
       WHEN inst_name IS NOT NULL THEN coalesce({case_map('inst_name', K.INSTRUMENT_NAME_CLASS)}, 'Other') END AS inst_class,
  CASE WHEN inst_type = 'HCD' OR contains(energy_text, 'HCD') THEN 'HCD' WHEN mode_text IS NULL OR mode_text = 'CID' THEN 'CID'
       WHEN mode_text = 'HCD' THEN 'HCD' END AS frag_mode""")
def _(d):
    t, n, e, m = (F.col(c) for c in ("inst_type", "inst_name", "energy_text", "mode_text"))
    return texts(d).select("spectrum_id", N.instrument_class(t, n).alias("inst_class"),
                           N.fragmentation_mode(t, e, m).alias("frag_mode"))


@tq("n10_ion_mode", """CASE WHEN ion_text IN ('P', 'N', 'E', 'EI') THEN ion_text WHEN ion_text = 'POSITIVE' THEN 'P'
  WHEN ion_text = 'NEGATIVE' THEN 'N' END AS ion_mode""")
def _(d):
    return texts(d).select("spectrum_id", N.ion_mode(F.col("ion_text")).alias("ion_mode"))


CHARGE_SQL = """CASE WHEN prec_type = 'EI' THEN 1 WHEN regexp_extract(prec_type, '\\]([0-9]*)([+-])$', 2) = '+'
  THEN coalesce(TRY_CAST(nullif(regexp_extract(prec_type, '\\]([0-9]*)([+-])$', 1), '') AS int), 1)
  WHEN regexp_extract(prec_type, '\\]([0-9]*)([+-])$', 2) = '-'
  THEN -coalesce(TRY_CAST(nullif(regexp_extract(prec_type, '\\]([0-9]*)([+-])$', 1), '') AS int), 1) END"""


@tq("n11_charge", f"{CHARGE_SQL} AS charge")
def _(d):
    return texts(d).select("spectrum_id", N.charge(F.col("prec_type")).alias("charge"))


NCE_SQL = f"""coalesce(TRY_CAST(nullif(regexp_extract(lower(ce_raw), 'nce\\s*=\\s*([-+]?\\d*\\.?\\d+)', 1), '') AS double),
  {first_float('ce_raw')})"""


@tq("n12_nce_value", f"round({NCE_SQL}, 6) AS nce")
def _(d):
    return texts(d).select("spectrum_id", r6(N.nce_value(F.col("ce_raw"))).alias("nce"))


_CV = first_float("ce_raw")
_NI = " OR ".join(f"contains(lower(trim(coalesce(instrument_raw, ''))), '{w}')" for w in K.NCE_INSTRUMENTS)
CE_TYPE_SQL = f"""CASE WHEN nullif(trim(ce_raw), '') IS NULL THEN 'missing' WHEN {_CV} IS NULL THEN 'unknown'
  WHEN lower(ce_raw) LIKE '%kev%' THEN 'keV' WHEN lower(ce_raw) LIKE '%ev%' THEN 'eV'
  WHEN lower(ce_raw) LIKE '%nce%' OR lower(ce_raw) LIKE '%hcd%' OR contains(ce_raw, '%') THEN 'NCE'
  WHEN {_NI} THEN 'numeric_NCE' ELSE 'numeric_eV' END"""
CE_EV_SQL = f"""CASE {CE_TYPE_SQL} WHEN 'keV' THEN {_CV} * 1000 WHEN 'eV' THEN {_CV} WHEN 'numeric_eV' THEN {_CV}
  WHEN 'NCE' THEN {_CV} * precursor_mz / 500.0 WHEN 'numeric_NCE' THEN {_CV} * precursor_mz / 500.0 END"""


@tq("n13_collision_energy", f"""round({CE_EV_SQL}, 6) AS ev, ce_raw AS raw, {CE_TYPE_SQL} AS type,
  CASE WHEN {CE_TYPE_SQL} IN ('missing', 'unknown') THEN 0 ELSE 1 END AS ok""")
def _(d):
    rows = N.with_collision_energy(
        texts(d), F.col("ce_raw"), F.col("precursor_mz"), F.col("instrument_raw"), F.lit(1))
    return rows.select("spectrum_id", r6("ce_ev").alias("ev"), F.col("ce_raw").alias("raw"),
                       F.col("ce_type").alias("type"), F.col("ce_ok").alias("ok"))


def _pattern_case(patterns, special=None):
    parts = []
    for i, p in enumerate(patterns):
        value = f"TRY_CAST(regexp_extract(energy_text, '{p}', 1) AS double)"
        if i == special:
            value = f"CASE WHEN {value} < 2 THEN {value} * 100 END"
        parts.append(f"WHEN regexp_matches(energy_text, '{p}') THEN {value}")
    return "CASE " + " ".join(parts) + " END"


@tq("n14_strict_energies", f"{_pattern_case(N.ABSOLUTE_ENERGY_PATTERNS)} AS ace, "
    f"{_pattern_case(N.NORMALISED_ENERGY_PATTERNS, 3)} AS nce")
def _(d):
    e = F.col("energy_text")
    return texts(d).select("spectrum_id", N.strict_absolute_energy(e).alias("ace"),
                           N.strict_normalised_energy(e).alias("nce"))


@tq("n15_energy_dialect", """CASE WHEN dialect_text IS NULL THEN '' WHEN contains(dialect_text, 'normalized=True')
  THEN concat('NCE=', split_part(dialect_text, ' ', 1), '%') ELSE concat(split_part(dialect_text, ' ', 1), ' eV') END AS text,
  coalesce(contains(dialect_text, 'normalized=True'), false) AS normalized,
  coalesce(contains(dialect_text, 'ramped=True'), false) AS ramped""")
def _(d):
    return texts(d).select("spectrum_id", N.energy_dialect(F.col("dialect_text")).alias("x")).select("spectrum_id", "x.*")


_ACE, _NCE = _pattern_case(N.ABSOLUTE_ENERGY_PATTERNS), _pattern_case(N.NORMALISED_ENERGY_PATTERNS, 3)
_CF = f"coalesce({case_map(f'abs({CHARGE_SQL})', K.CHARGE_FACTOR)}, 0.75)"


@tq("n16_fill_energies", f"""round(coalesce({_NCE}, {_ACE} * 500.0 / (precursor_mz * {_CF})), 6) AS nce,
  round(coalesce({_ACE}, {_NCE} * precursor_mz / 500.0 * {_CF}), 6) AS ace""")
def _(d):
    e, z, m = F.col("energy_text"), N.charge(F.col("prec_type")), F.col("precursor_mz")
    ace, nce = N.strict_absolute_energy(e), N.strict_normalised_energy(e)
    return texts(d).select(
        "spectrum_id", r6(F.coalesce(nce, N.ev_to_nce(ace, m, z))).alias("nce"),
        r6(F.coalesce(ace, N.nce_to_ev(nce, m, z, beyond=0.75))).alias("ace"))


def impute(df, energy, defaults, fallback):
    """Defaults for missing conditions with ``<name>_missing`` flags; raw values stay in ``<name>_raw``."""
    sources = {"ce": energy, "instrument": F.col("inst_name"), "prec": F.col("prec_type"),
               "precursor": F.when(F.col("spectrum_id") % 3 != 0, F.col("precursor_mz"))}
    cols = []
    for name, raw in sources.items():
        default = F.coalesce(fallback, F.lit(0.0)) if name == "precursor" else F.lit(defaults[name])
        cols += [F.coalesce(raw, default).alias(name), raw.isNull().cast("int").alias(f"{name}_missing"),
                 raw.alias(f"{name}_raw")]
    return df.select("spectrum_id", *cols)


@tq("n17_impute_conditions", f"""round(coalesce({_NCE}, 20.0), 6) AS ce,
  CASE WHEN {_NCE} IS NULL THEN 1 ELSE 0 END AS ce_missing, round({_NCE}, 6) AS ce_raw,
  coalesce(inst_name, 'Orbitrap') AS instrument, CASE WHEN inst_name IS NULL THEN 1 ELSE 0 END AS instrument_missing,
  inst_name AS instrument_raw, coalesce(prec_type, '[M+H]+') AS prec,
  CASE WHEN prec_type IS NULL THEN 1 ELSE 0 END AS prec_missing, prec_type AS prec_raw,
  round(CASE WHEN spectrum_id % 3 <> 0 THEN precursor_mz ELSE precursor_mz * 2 END, 6) AS precursor,
  CASE WHEN spectrum_id % 3 = 0 THEN 1 ELSE 0 END AS precursor_missing,
  round(CASE WHEN spectrum_id % 3 <> 0 THEN precursor_mz END, 6) AS precursor_raw""")
def _(d):
    nce = N.strict_normalised_energy(F.col("energy_text"))
    res = impute(texts(d), nce, {"ce": 20.0, "instrument": "Orbitrap", "prec": "[M+H]+"}, F.col("precursor_mz") * 2)
    return res.withColumns({c: r6(c) for c in ("ce", "ce_raw", "precursor", "precursor_raw")})


_SHIFT = f"{case_map(PREC_SQL, K.PRECURSOR_INFERENCE_SHIFT)}"


@tq("n18_infer_precursor", f"""round(coalesce(CASE WHEN spectrum_id % 2 = 0 THEN precursor_mz END,
  precursor_mz + {_SHIFT}), 6) AS precursor_mz""")
def _(d):
    known = F.when(F.col("spectrum_id") % 2 == 0, F.col("precursor_mz"))
    adduct = N.precursor_type(F.col("prec_type"))
    got = N.infer_precursor(known, F.col("precursor_mz"), adduct, F.lit(True))
    return texts(d).select("spectrum_id", r6(got).alias("precursor_mz"))


@tq("n19_candidate_adduct_shift", f"""round(coalesce({case_map("upper(replace(coalesce(adduct_raw, ''), ' ', ''))",
    K.CANDIDATE_ADDUCT_SHIFT)}, {K.PROTON_MASS}), 9) AS shift""")
def _(d):
    return texts(d).select("spectrum_id", r6(N.candidate_adduct_shift(F.col("adduct_raw")), 9).alias("shift"))


@tq("n20_encode_vocabularies", f"""CASE WHEN nullif(trim(prec_type), '') IS NULL THEN 0 ELSE
    coalesce({case_map('trim(prec_type)', K.ADDUCT_VOCABULARY)}, 9) END AS adduct_code,
  CASE WHEN nullif(trim(instrument_raw), '') IS NULL THEN 0 ELSE coalesce({case_map(squeeze('instrument_raw'),
    K.INSTRUMENT_VOCABULARY)}, CASE WHEN contains({squeeze('instrument_raw')}, 'orbitrap') THEN 1
    WHEN contains({squeeze('instrument_raw')}, 'qtof') THEN 2 WHEN contains({squeeze('instrument_raw')}, 'iontrap') THEN 4
    WHEN contains({squeeze('instrument_raw')}, 'fticr') THEN 5 WHEN contains({squeeze('instrument_raw')}, 'triplequad') THEN 6
    ELSE 9 END) END AS instrument_code,
  CASE level_text WHEN 'MS2' THEN 2 WHEN '2' THEN 2 WHEN '3.0' THEN 3 WHEN 'ms level' THEN 9 ELSE 0 END AS level_code""")
def _(d):
    return texts(d).select(
        "spectrum_id", N.encode_adduct(F.col("prec_type"), 0, 9).alias("adduct_code"),
        N.encode_instrument(F.col("instrument_raw"), 0, 9).alias("instrument_code"),
        N.encode_ms_level(F.col("level_text"), 0, 9).alias("level_code"))


@tq("n21_numeric_string", "TRY_CAST(CASE WHEN spectrum_id % 3 = 0 THEN trim(ri_text) END AS double) AS value")
def _(d):
    return texts(d).select("spectrum_id", N.numeric_string(F.col("ri_text")).alias("value"))


_TOK = N.SMILES_TOKEN.replace("'", "''")


@tq("n22_smiles_tokens", f"""len(regexp_extract_all(smiles_text, '{_TOK}')) AS n_tokens,
  array_to_string(regexp_extract_all(smiles_text, '{_TOK}'), ' ') AS tokens,
  array_to_string(regexp_extract_all(smiles_text, '{_TOK}'), '') = smiles_text AS valid""")
def _(d):
    s = F.col("smiles_text")
    return texts(d).select("spectrum_id", F.size(N.smiles_tokens(s)).alias("n_tokens"),
                           F.array_join(N.smiles_tokens(s), " ").alias("tokens"), N.smiles_valid(s).alias("valid"))


@query("n23_decimal_resolution", """
WITH t AS (SELECT l_orderkey AS spectrum_id, rtrim(CAST(CAST(l_extendedprice AS decimal(12, 2)) AS varchar), '0') AS s
           FROM lineitem)
SELECT spectrum_id, max(CASE WHEN contains(s, '.') THEN length(s) - strpos(s, '.') ELSE 0 END) AS resolution
FROM t GROUP BY 1""")
def _(d):
    s = F.rtrim(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.lit("0"))
    return d.table("lineitem").groupBy(F.col("l_orderkey").alias("spectrum_id")).agg(
        F.max(N.decimals(s)).alias("resolution"))


@tq("n24_short_key", "left(concat(inchikey, '-UHFFFAOYSA-N'), 14) AS short_key")
def _(d):
    key = F.concat(F.col("inchikey"), F.lit("-UHFFFAOYSA-N"))
    return texts(d).select("spectrum_id", N.short_key(key).alias("short_key"))


@tq("n25_content_key", """sha1(concat('{"adduct":"', adduct_raw, '","inchikey":"', inchikey, '","precursor_mz":"',
  format('{:.4f}', round(precursor_mz, 4)), '"}')) AS content_key""")
def _(d):
    key = N.content_key(F.col("precursor_mz"), inchikey=F.col("inchikey"), adduct=F.col("adduct_raw"))
    return texts(d).select("spectrum_id", key.alias("content_key"))


@tq("n26_one_hot", """array_to_string(list_concat(
    [CASE WHEN i = spectrum_id % 4 THEN 1 ELSE 0 END FOR i IN range(0, 4)],
    [CASE WHEN i = spectrum_id % 3 THEN 1 ELSE 0 END FOR i IN range(0, 3)]), '') AS plain,
  array_to_string(list_concat([CASE WHEN i < spectrum_id % 4 THEN 1 ELSE 0 END FOR i IN range(0, 4)],
    [CASE WHEN i < spectrum_id % 3 THEN 1 ELSE 0 END FOR i IN range(0, 3)]), '') AS cumulative""")
def _(d):
    vals = [F.col("spectrum_id") % 4, F.col("spectrum_id") % 3]
    text = lambda cum: F.array_join(N.one_hot(vals, [4, 3], cum).cast("array<string>"), "")
    return texts(d).select("spectrum_id", text(False).alias("plain"), text(True).alias("cumulative"))
