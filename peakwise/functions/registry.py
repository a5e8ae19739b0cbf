"""SQL functions: the scalar expressions of this library under SQL names.

They are created as SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN``),
so a call is inlined into the plan and no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from peakwise import constants as K


def _table(values: dict) -> str:
    cells = ", ".join(f"'{k}', {v!r}" if not isinstance(v, str) else f"'{k}', '{v}'" for k, v in values.items())
    return f"map({cells})"


_TEXT = r"nullif(regexp_replace(s, '^\\s+|\\s+$', ''), '')"
_FLOAT = r"[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?"
_ELEMENT = r"([A-Z][a-z]?)(\\d*)"
_TOKENS = (
    f"arrays_zip(regexp_extract_all(f, '{_ELEMENT}', 1), regexp_extract_all(f, '{_ELEMENT}', 2))"
)
_COUNT = "coalesce(try_cast(nullif(t['1'], '') AS int), 1)"

# name -> (arguments, return type, expression)
SCALARS: dict[str, tuple[str, str, str]] = {
    "ms_bin": ("mz DOUBLE, width DOUBLE", "BIGINT", "CAST(floor(mz / width + 1e-8D) AS BIGINT)"),
    "ms_bin_mz": ("bin BIGINT, width DOUBLE", "DOUBLE", "(bin + 0.5D) * width"),
    "ms_text": ("s STRING", "STRING", _TEXT),
    "ms_first_float": ("s STRING", "DOUBLE", f"try_cast(nullif(regexp_extract(s, '{_FLOAT}', 0), '') AS DOUBLE)"),
    "ms_name_key": ("s STRING", "STRING", "regexp_replace(lower(s), '[^a-z0-9]+', '')"),
    "ms_adduct": (
        "s STRING", "STRING",
        "CASE WHEN upper(replace(s, ' ', '')) IN ('[M+H]+', 'M+H', 'M+H+') THEN '[M+H]+' "
        "WHEN upper(replace(s, ' ', '')) IN ('[M+NA]+', 'M+NA', 'M+NA+') THEN '[M+Na]+' "
        f"WHEN upper(replace(s, ' ', '')) IN ('[M+NH4]+', 'M+NH4', 'M+NH4+') THEN '[M+NH4]+' ELSE {_TEXT} END"),
    "ms_nce_to_ev": (
        "nce DOUBLE, precursor_mz DOUBLE, charge INT", "DOUBLE",
        "CASE WHEN precursor_mz > 0 THEN nce * precursor_mz / 500D * "
        f"coalesce(map({', '.join(f'{k}, {v}D' for k, v in K.CHARGE_FACTOR.items())})[abs(charge)], 1D) END"),
    "ms_adduct_shift": ("a STRING", "DOUBLE", f"{_table(K.ADDUCT_MASS_SHIFT)}[a]"),
    "ms_element_count": (
        "f STRING, e STRING", "INT",
        f"aggregate({_TOKENS}, 0, (acc, t) -> acc + CASE WHEN t['0'] = e THEN {_COUNT} ELSE 0 END)"),
    "ms_exact_mass": (
        "f STRING", "DOUBLE",
        f"aggregate({_TOKENS}, 0D, (acc, t) -> acc + {_table(K.ISOTOPE_MASS)}[t['0']] * {_COUNT})"),
    "ms_dbe": (
        "f STRING", "DOUBLE",
        f"aggregate({_TOKENS}, 2D, (acc, t) -> acc + {_COUNT} * CASE WHEN t['0'] = 'C' THEN 2 WHEN t['0'] IN ('N', 'P') THEN 1 "
        "WHEN t['0'] IN ('H', 'F', 'Cl', 'Br', 'I') THEN -1 ELSE 0 END) / 2D"),
    "ms_split": (
        "k STRING, seed INT", "STRING",
        "CASE WHEN CAST(CAST(conv(substring(sha1(concat(seed, '|', k)), 1, 16), 16, 10) AS DECIMAL(20, 0)) AS DOUBLE) / 18446744073709551616D < 0.8D THEN 'train' "
        "WHEN CAST(CAST(conv(substring(sha1(concat(seed, '|', k)), 1, 16), 16, 10) AS DECIMAL(20, 0)) AS DOUBLE) / 18446744073709551616D < 0.9D THEN 'val' ELSE 'test' END"),
}

_PAIRS = (
    "filter(transform(split(regexp_replace(line, '\"[^\"]*\"', ''), ';'), t -> named_struct("
    f"'mz', try_cast(nullif(regexp_extract(t, '^\\\\s*({_FLOAT})\\\\s+({_FLOAT})\\\\b', 1), '') AS DOUBLE), "
    f"'intensity', try_cast(nullif(regexp_extract(t, '^\\\\s*({_FLOAT})\\\\s+({_FLOAT})\\\\b', 2), '') AS DOUBLE))), "
    "p -> p.mz >= 0 AND p.mz < double('inf') AND p.intensity > 0 AND p.intensity < double('inf'))")

# name -> (arguments, columns, query): table-valued functions, called with LATERAL; they are inlined like the others.
TABLES: dict[str, tuple[str, str, str]] = {
    "ms_peaks_of": (
        "line STRING", "peak_no INT, mz DOUBLE, intensity DOUBLE",
        f"SELECT pos, col.mz, col.intensity FROM (SELECT posexplode({_PAIRS}))"),
    "ms_atoms_of": (
        "f STRING", "element STRING, n INT",
        f"SELECT t['0'], CAST(sum({_COUNT}) AS INT) FROM (SELECT explode({_TOKENS}) AS t) GROUP BY 1"),
    "ms_bins_of": (
        "mzs ARRAY<DOUBLE>, intensities ARRAY<DOUBLE>, width DOUBLE", "bin BIGINT, intensity DOUBLE",
        "SELECT p.b, sum(p.i) FROM (SELECT explode(transform(mzs, (m, k) -> named_struct("
        "'b', CAST(floor(m / width + 1e-8D) AS BIGINT), 'i', intensities[k]))) AS p) WHERE p.b IS NOT NULL AND p.i > 0 GROUP BY 1"),
}


def register(spark: SparkSession) -> list[str]:
    """Creates all functions in the session and returns their names."""
    for name, (args, returns, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    for name, (args, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({columns}) RETURN {body}")
    return sorted([*SCALARS, *TABLES])
