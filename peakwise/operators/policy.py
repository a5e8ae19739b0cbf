"""Row policies: every row is rejected for its first failing rule and counted once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakwise.functions import formula as FX
from peakwise.functions import normalize as N
from peakwise.operators.transforms import top_peaks

Rule = tuple[str, Column]


def first_failure(rules: Sequence[Rule]) -> Column:
    """Name of the first rule whose failure condition holds, NULL when none does."""
    out: Column = F.lit(None).cast("string")
    for name, fails in reversed(list(rules)):
        out = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(out)
    return out


def apply_policy(df: DataFrame, rules: Sequence[Rule], out: str = "reject_reason") -> DataFrame:
    return df.withColumn(out, first_failure(rules))


def kept(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.filter(F.col(reason).isNull()).drop(reason)


def reject_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def not_in(value: Column, allowed: Sequence[str]) -> Column:
    """Fails when a list is given and the value is missing or not in it."""
    if not allowed:
        return F.lit(False)
    return value.isNull() | ~value.isin(list(allowed))


def above(value: Column, cap: float, positive: bool = False) -> Column:
    """Fails when missing or above the cap (0 or less: no cap); ``positive`` also rejects <= 0."""
    if cap <= 0:
        return F.lit(False)
    bad = value.isNull() | (value > cap)
    return bad | (value <= 0) if positive else bad


def empty_spectrum(total: Column) -> Column:
    return total.isNull() | (total <= 0)


def ingest_rules(
    split: str | None = None, require_ce: bool = True, adducts: Sequence[str] = (), instruments: Sequence[str] = (),
    methods: Sequence[str] = (), max_precursor_mz: float = 0.0, reject_key_mismatch: bool = True,
) -> list[Rule]:
    """Library ingest: cheap metadata first, then the molecule join and its identity checks."""
    c = F.col
    return [
        ("split_skip", (c("split") != split) if split else F.lit(False)),
        ("ce_missing", c("ce_nce").isNull() if require_ce else F.lit(False)),
        ("adduct_not_allowed", not_in(c("adduct"), adducts)),
        ("instrument_not_allowed", not_in(c("instrument"), instruments)),
        ("fragmentation_method_not_allowed", not_in(c("frag_method"), methods)),
        ("precursor_mz_invalid", above(c("precursor_mz"), max_precursor_mz)),
        ("empty_spectrum", empty_spectrum(c("total_intensity"))),
        ("join_missing_mol", c("mol_found").isNull()),
        ("hard_cas_mismatch", c("cas") != c("mol_cas")),
        ("hard_inchikey_mismatch",
         N.upper_key(c("inchikey")) != N.upper_key(c("mol_inchikey")) if reject_key_mismatch else F.lit(False)),
    ]


def attach_molecules(spectra: DataFrame, molecules: DataFrame, key: str = "mol_id") -> tuple[DataFrame, DataFrame]:
    """(every spectrum with its molecule's columns and ``mol_found``, one row with the numbers of hits and misses).

    ``molecules`` has one row per key; ``mol_found`` is NULL where there is none.
    """
    rows = spectra.join(molecules.withColumn("mol_found", F.lit(True)), key, "left")
    return rows, rows.agg(F.count("mol_found").alias("joined"), (F.count(F.lit(1)) - F.count("mol_found")).alias("missed"))


def soft_match_flags(rows: DataFrame, name: str, mol_name: str, inchikey: str = "inchikey", mol_inchikey: str = "mol_inchikey") -> DataFrame:
    """``rows`` plus ``soft_name_match`` and ``soft_inchikey_match``; NULL where a side is missing.  They reject nothing."""
    same = lambda key, a, b: key(F.col(a)) == key(F.col(b))
    return rows.withColumns({"soft_name_match": same(N.name_key, name, mol_name),
                             "soft_inchikey_match": same(N.upper_key, inchikey, mol_inchikey)})


def with_formula_facts(molecules: DataFrame, elements: Sequence[str]) -> DataFrame:
    """``molecules`` plus ``elements_ok`` and ``search_space``: a formula is parsed once per molecule, before any join."""
    return molecules.withColumns({"elements_ok": FX.elements_subset(F.col("formula"), elements),
                                  "search_space": FX.search_space(F.col("formula"), elements)})


def _elements_bad(allowed: Sequence[str], facts: bool = False) -> Column:
    return ~(F.col("elements_ok") if facts else FX.elements_subset(F.col("formula"), allowed))


def strict_rules(
    adduct: str, max_precursor_mz: float, max_heavy: int, elements: Sequence[str], require_ce: bool = True
) -> list[Rule]:
    """Strict audit: the adduct first; a precursor at or below zero is also invalid."""
    c = F.col
    return [
        ("adduct_not_allowed", c("adduct").isNull() | (c("adduct") != adduct)),
        ("precursor_mz_invalid", above(c("precursor_mz"), max_precursor_mz, positive=True)),
        ("ce_missing", c("ce_nce").isNull() if require_ce else F.lit(False)),
        ("allowed_elements_not_ok", _elements_bad(elements)),
        ("heavy_atom_overflow", c("n_heavy") > max_heavy),
        ("charged_molecule", c("charge").isNull() | (c("charge") != 0)),
        ("radical_molecule", c("n_radicals").isNull() | (c("n_radicals") != 0)),
        ("multi_component", c("n_components").isNull() | (c("n_components") != 1)),
        ("canonical_failed", N.optional_string(c("mol_inchikey")).isNull()),
        ("empty_or_zero_spectrum", empty_spectrum(c("total_intensity"))),
    ]


def row_rules(
    whitelisted: Column, adducts: Sequence[str], instruments: Sequence[str], max_precursor_mz: float, max_heavy: int,
    elements: Sequence[str], hard_formula_cap: int, require_ce: bool = True, strict_molecule: bool = True, facts: bool = False,
) -> list[Rule]:
    """Row filter before sampling: whitelist, molecule, conditions, size and formula-count cap.

    ``facts``: the rows carry the columns of ``with_formula_facts``, so no formula is parsed again.
    """
    space = F.col("search_space") if facts else FX.search_space(F.col("formula"), elements)
    c = F.col
    low = lambda x: F.lower(F.trim(x))
    molecule = [
        ("charged_molecule", c("charge").isNull() | (c("charge") != 0)),
        ("radical_molecule", c("n_radicals").isNull() | (c("n_radicals") != 0)),
        ("multi_component", c("n_components").isNull() | (c("n_components") != 1)),
        ("canonical_failed", N.optional_string(c("mol_inchikey")).isNull()),
        ("empty_or_zero_spectrum", empty_spectrum(c("total_intensity"))),
    ]
    return [
        ("identifier_not_selected", ~whitelisted),
        *(molecule if strict_molecule else []),
        ("ce_missing", c("ce_nce").isNull() if require_ce else F.lit(False)),
        ("adduct_not_allowed", not_in(low(c("adduct")), [a.lower() for a in adducts])),
        ("instrument_not_allowed", not_in(low(c("instrument")), [i.lower() for i in instruments])),
        ("precursor_mz_invalid", above(c("precursor_mz"), max_precursor_mz)),
        ("allowed_elements_not_ok", _elements_bad(elements, facts)),
        ("heavy_atom_overflow", c("n_heavy") > max_heavy if max_heavy > 0 else F.lit(False)),
        ("formula_n_raw_overflow",
         space > hard_formula_cap if hard_formula_cap > 0 else F.lit(False)),
    ]


def pass_rates(df: DataFrame, masks: dict[str, Column], must_keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows passing every mask, one row per mask with the share of rows it passes).

    All shares, and that of the conjunction, come from one scan; a NULL mask
    counts as failed.  ``must_keep``: an empty result is an error.
    """
    flags = {n: F.coalesce(m, F.lit(False)) for n, m in masks.items()}
    every = F.lit(True)
    for flag in flags.values():
        every = every & flag
    rows = df.agg(*[F.avg(f.cast("double")).alias(n) for n, f in {**flags, "everything": every}.items()])
    names = [*flags, "everything"]
    report = rows.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("mask"), F.col(n).alias("pass_rate")) for n in names])).alias("x")).select("x.*")
    kept = df.filter(every)
    if must_keep and kept.isEmpty():
        raise ValueError(f"no row passes all of {', '.join(flags)}")
    return kept, report


def molecule_class(
    rule: str, elements: Column, n_rings: Column, n_aromatic: Column, mass: Column, mw_min: float, mw_max: float
) -> Column:
    """Named molecule classes within a mass range (``mw_max`` 0 or less: open)."""
    only = lambda *s: F.size(F.array_except(elements, F.array(*map(F.lit, s)))) == 0
    halogen = F.arrays_overlap(elements, F.array(*map(F.lit, ("F", "Cl", "Br", "I"))))
    rules = {
        "all": F.lit(True), "chno": only("C", "H", "N", "O"), "chnops": only("C", "H", "N", "O", "P", "S"),
        "no_halogen": ~halogen, "halogen": halogen, "aromatic": n_aromatic > 0, "non_aromatic": n_aromatic == 0,
        "ring": n_rings > 0, "no_ring": n_rings == 0,
    }
    inside = (mass >= mw_min) & ((mass < mw_max) if mw_max > 0 else F.lit(True))
    return inside & rules[rule]


def nonempty_spectra(peaks: DataFrame) -> DataFrame:
    """Ids whose positive intensities sum to more than zero."""
    return (
        peaks.groupBy("spectrum_id").agg(F.sum(F.greatest("intensity", F.lit(0.0))).alias("total"))
        .filter(F.col("total") > 0).select("spectrum_id")
    )


def keep_listed(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` appears in ``ids`` (same column name); duplicates there do not matter."""
    return df.join(ids.select(column), column, "left_semi")


def candidate_hard_filter(cands: DataFrame, slack: float = 4.1) -> DataFrame:
    """Drops candidates that cannot be part of their parent.

    Needs ``formula``, ``parent_formula``: non-empty with a heavy atom, heavy
    counts within the parent's, mass at most parent + ``slack``.  Hydrogen is
    not limited.
    """
    own, parent = FX.counts(F.col("formula")), FX.counts(F.col("parent_formula"))
    rows = cands.withColumn("__own", own).withColumn("__parent", parent)
    fits = F.forall(
        F.map_entries("__own"),
        lambda e: (e["key"] == "H") | (e["value"] <= F.coalesce(F.col("__parent")[e["key"]], F.lit(0))),
    )
    heavy = F.exists(F.map_entries("__own"), lambda e: (e["key"] != "H") & (e["value"] > 0))
    light = FX.mass_of(F.col("__own")) <= FX.mass_of(F.col("__parent")) + F.lit(slack)
    return rows.filter(heavy & fits & light).drop("__own", "__parent")


def candidate_safe_filter(
    cand_peaks: DataFrame, candidates: DataFrame, precursors: DataFrame, tol_da: float,
    dbe_ok: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(kept candidates, removal counts per spectrum).

    A candidate needs a valid peak, one at or below precursor + ``tol_da``
    (only with a positive precursor) and ``dbe_ok``.  A spectrum that would
    lose everything keeps its strongest candidate.
    """
    keys = ["spectrum_id", "cand_id"]
    stats = cand_peaks.filter(F.col("intensity") > 0).groupBy(*keys).agg(
        F.min("mz").alias("__lowest"), F.sum("intensity").alias("__total"))
    rows = candidates.join(stats, keys, "left").join(precursors.select("spectrum_id", "precursor_mz"), "spectrum_id", "left")
    has_peak = F.col("__total").isNotNull()
    known = F.coalesce(F.col("precursor_mz") > 0, F.lit(False))
    below = ~known | F.coalesce(F.col("__lowest") <= F.col("precursor_mz") + tol_da, F.lit(False))
    good = F.lit(True) if dbe_ok is None else F.coalesce(dbe_ok, F.lit(True))
    rows = rows.withColumns({"__peak": has_peak, "__below": below, "__dbe": good,
                             "__keep": has_peak & below & good, "__total": F.coalesce("__total", F.lit(0.0))})
    report = rows.groupBy("spectrum_id").agg(
        F.count(F.lit(1)).alias("n_before"),
        F.sum((~F.col("__peak")).cast("long")).alias("removed_empty_peak"),
        F.sum((~F.col("__below")).cast("long")).alias("removed_precursor_cap"),
        F.sum((~F.col("__dbe")).cast("long")).alias("removed_dbe"),
        F.sum(F.col("__keep").cast("long")).alias("__n"),
    ).withColumn("fallback_keep_one", (F.col("__n") == 0).cast("int")).withColumn(
        "n_after", F.greatest("__n", F.lit(1)))
    strongest = top_peaks(rows, 1, ["spectrum_id"], "__total", "cand_id").select(*keys, F.lit(True).alias("__best"))
    emptied = report.filter("fallback_keep_one = 1").select("spectrum_id", F.lit(True).alias("__emptied"))
    kept_rows = (
        rows.join(emptied, "spectrum_id", "left").join(strongest, keys, "left")
        .filter(F.col("__keep") | (F.col("__emptied") & F.col("__best")))
        .select(*candidates.columns)
    )
    return kept_rows, report.drop("__n")


def condition_filter(
    df: DataFrame, adducts: Sequence[str] = (), instruments: Sequence[str] = (), max_precursor_mz: float | None = None
) -> DataFrame:
    """Case-insensitive lists and a precursor cap, applied to the columns that exist."""
    for column, allowed in (("adduct", adducts), ("instrument", instruments)):
        if allowed and column in df.columns:
            df = df.filter(F.lower(F.trim(column)).isin([a.strip().lower() for a in allowed]))
    if max_precursor_mz is not None and "precursor_mz" in df.columns:
        df = df.filter(F.col("precursor_mz") <= max_precursor_mz)
    return df


def phase_filter(df: DataFrame, caps: dict[str, float], phase: Column, wanted: str) -> DataFrame:
    """Numeric upper limits and the wanted phase."""
    for column, cap in caps.items():
        df = df.filter(F.col(column) <= cap)
    return df.filter(phase == wanted)
