"""Formula operators: enumeration, isotopes, lookups, scores and peak features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise import constants as K
from peakwise.functions import formula as FX
from peakwise.functions import spectrum as S
from peakwise.operators import sampling
from peakwise.operators.transforms import TINY, top_peaks
from peakwise.session import write_once
from peakwise.skew import exact_quantiles


def enumerate_subformulas(
    formulas: DataFrame, key: str, elements: Sequence[str], cap: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sub-formula rows, refused rows): all count vectors 0..n of the given elements.

    Every formula is enumerated, one element range after the other.  With a
    ``cap`` the size product is checked before anything is exploded, and
    formulas above it come back whole in the second table with their size.
    """
    rows = formulas.withColumn("__size", FX.search_space(F.col("formula"), elements))
    rows = rows.withColumns({f"__max_{e}": FX.count(F.col("formula"), e) for e in elements})
    large = F.lit(False) if cap is None else F.col("__size") > cap
    refused = rows.filter(large).select(key, "formula", F.col("__size").alias("search_space"))
    small = rows.filter(~large)
    for e in elements:
        small = small.withColumn(f"n_{e.lower()}", F.explode(F.sequence(F.lit(0), F.col(f"__max_{e}"))))
    mass = F.lit(0.0)
    for e in elements:
        mass = mass + F.col(f"n_{e.lower()}") * F.lit(K.ISOTOPE_MASS[e])
    cols = [f"n_{e.lower()}" for e in elements]
    return small.select(key, *cols, mass.alias("mass")), refused


def isotope_envelope(formulas: DataFrame, key: str, top: int = 16) -> DataFrame:
    """Exact-mass envelope with 0, 1 and 2 heavy-isotope substitutions.

    Every formula meets the fixed list of 55 channel terms; the ``top``
    heaviest terms are kept, ordered by mass and divided by their total.
    """
    elements = sorted({c[0] for c in K.ISOTOPE_CHANNELS})
    rows = formulas.select(
        key, FX.exact_mass(F.col("formula")).alias("__m"),
        *[FX.count(F.col("formula"), e).cast("double").alias(f"__{e}") for e in elements])
    no_sub = {e: 1.0 - sum(p for x, p, _, _ in K.ISOTOPE_CHANNELS if x == e) for e in elements}
    p0 = F.lit(0.0)
    for e in elements:
        p0 = p0 + F.col(f"__{e}") * F.log(F.lit(no_sub[e]))
    rows = rows.withColumn("__p0", F.exp(p0))

    terms = [(F.lit(1.0), 0.0, 1.0)]
    ch = [(e, p / no_sub[e], delta) for e, p, _, delta in K.ISOTOPE_CHANNELS]
    for i, (ei, ri, di) in enumerate(ch):
        ni = F.col(f"__{ei}")
        terms.append((ni, di, ri))
        for j in range(i, len(ch)):
            ej, rj, dj = ch[j]
            if i == j:
                comb = 0.5 * ni * (ni - 1.0)
            elif ei == ej:
                comb = ni * (ni - 1.0)
            else:
                comb = ni * F.col(f"__{ej}")
            terms.append((comb, di + dj, ri * rj))
    cells = F.array(*[
        F.struct(F.lit(i).alias("no"), (F.col("__m") + F.lit(d)).alias("mz"),
                 (F.col("__p0") * c * F.lit(r)).alias("w"))
        for i, (c, d, r) in enumerate(terms)])
    peaks = rows.select(key, F.explode(F.filter(cells, lambda t: t["w"] > 0)).alias("t")).select(key, "t.*")
    kept = top_peaks(peaks, top, [key], "w", "no").drop("rank")  # at most 55 rows per formula
    whole = W.partitionBy(key)
    return kept.select(
        key, "mz", (F.col("w") / F.sum("w").over(whole)).alias("intensity"),
        F.row_number().over(whole.orderBy("mz", "no")).alias("peak_no"))


def poisson_envelope(formulas: DataFrame, key: str, n_peaks: int = 6) -> DataFrame:
    """Approximate envelope: lines at the 13C spacing with Poisson terms of +1 and +2 isotopes."""
    def rate(table: dict) -> Column:
        out = F.lit(0.0)
        for e, p in table.items():
            out = out + FX.count(F.col("formula"), e) * F.lit(p)
        return out

    rows = formulas.select(key, FX.exact_mass(F.col("formula")).alias("__m"),
                           rate(K.POISSON_PLUS1).alias("__l1"), rate(K.POISSON_PLUS2).alias("__l2"))
    factorial = [1.0]
    for i in range(1, n_peaks + 1):
        factorial.append(factorial[-1] * i)

    def weight(k: int) -> Column:
        out = F.lit(0.0)
        for j in range(k // 2 + 1):
            a = k - 2 * j
            out = out + (F.pow("__l1", F.lit(float(a))) / F.lit(factorial[a])) * (
                F.pow("__l2", F.lit(float(j))) / F.lit(factorial[j]))
        return out

    total = F.lit(0.0)
    for k in range(n_peaks):
        total = total + weight(k)
    cells = [F.struct(F.lit(k).alias("peak_no"), (F.col("__m") + F.lit(k * S.ISOTOPE_STEP)).alias("mz"),
                      (weight(k) / total).alias("intensity")) for k in range(n_peaks)]
    return rows.select(key, F.explode(F.array(*cells)).alias("t")).select(key, "t.*")


def pool_index(pool: DataFrame, key: str) -> DataFrame:
    """One row per canonical formula of the pool: smallest key and how many rows share it."""
    return pool.groupBy(FX.canonical(FX.counts(F.col("formula"))).alias("canonical")).agg(
        F.min(key).alias("pool_key"), F.count(F.lit(1)).alias("pool_n"))


def formula_lookup(rows: DataFrame, count_map: Column, pool: DataFrame, key: str) -> DataFrame:
    """``rows`` plus ``pool_key`` and ``pool_n`` of the pool formula with the same counts (NULL: none)."""
    return rows.withColumn("canonical", FX.canonical(count_map)).join(pool_index(pool, key), "canonical", "left")


def common_loss_lookup(
    parents: DataFrame, parent_key: str, pool: DataFrame, pool_key: str, h_window: int = 3,
    losses: Sequence[str] = K.COMMON_LOSSES,
) -> DataFrame:
    """Pool formulas equal to a parent minus a common loss, hydrogens moved by up to ``h_window``.

    Parents are reduced to distinct formulas first; each meets the fixed loss
    list and H window (a constant number of rows).
    """
    distinct = parents.select("formula").distinct()
    # The explode gets a projection of its own: next to one, Spark strips struct field names.
    moves = distinct.withColumn("loss", F.explode(F.array(*[F.lit(x) for x in losses])))
    moves = moves.withColumn(
        "__base", FX.difference(FX.counts(F.col("formula")), FX.counts(F.col("loss")))
    ).filter(F.col("__base").isNotNull())
    moves = moves.withColumn("h_shift", F.explode(F.sequence(F.lit(-h_window), F.lit(h_window))))
    h = F.coalesce(F.col("__base")["H"], F.lit(0)) + F.col("h_shift")
    shifted = F.map_concat(
        F.map_filter("__base", lambda k, v: k != "H"), F.create_map(F.lit("H"), F.greatest(h, F.lit(0))))
    moves = moves.filter(h >= 0).withColumn("canonical", FX.canonical(shifted))
    hits = moves.select("formula", "canonical").distinct().join(pool_index(pool, pool_key), "canonical")
    return parents.select(parent_key, "formula").join(hits, "formula").select(
        parent_key, "canonical", "pool_key", "pool_n")


def annotation_library(
    annotated: DataFrame, split_of_group: Column, top_product: int | None = None, top_loss: int | None = None,
    spelling: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Product and neutral-loss statistics of the training split, all or the strongest of each kind.

    ``annotated(group_key, parent_formula, intensity, formulas)`` has one row
    per peak; a peak's intensity is shared equally by its formulas.  Sums are
    taken per (parent, formula) before any loss is computed and before ``spelling`` rewrites the formulas.
    ``left_out`` is the number of formulas of the kind beyond its limit.
    """
    rows = annotated.withColumn("__split", split_of_group).filter(
        (F.col("__split") == "train") & F.col("parent_formula").isNotNull() & (F.size("formulas") > 0))
    share = F.greatest("intensity", F.lit(0.0)) / F.size("formulas")
    pairs = rows.select("parent_formula", share.alias("w"), F.explode("formulas").alias("formula")).groupBy(
        "parent_formula", "formula").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    if spelling is not None:
        texts = pairs.select("formula").distinct().withColumn("__spelled", spelling(F.col("formula")))
        pairs = pairs.join(texts, "formula").drop("formula").withColumnRenamed("__spelled", "formula")
    loss = FX.subtract(F.col("parent_formula"), F.col("formula"))
    both = pairs.select(F.lit("product").alias("kind"), "formula", "w", "n").unionByName(
        pairs.select(F.lit("neutral_loss").alias("kind"), loss.alias("formula"), "w", "n").filter("formula <> ''"))
    totals = both.groupBy("kind", "formula").agg(F.sum("w").alias("intensity"), F.sum("n").alias("n"))
    kinds = []
    for kind, top in (("product", top_product), ("neutral_loss", top_loss)):
        part = totals.filter(F.col("kind") == kind)
        if top is None:
            kinds.append(part.withColumn("left_out", F.lit(0).cast("long")))
            continue
        beyond = part.groupBy("kind").agg(F.greatest(F.count(F.lit(1)) - top, F.lit(0)).alias("left_out"))
        kinds.append(top_peaks(part, top, ["kind"], "intensity", "formula").drop("rank").join(beyond, "kind"))
    return kinds[0].unionByName(kinds[1]).select(
        "kind", "formula", "intensity", "n", F.log1p("intensity").alias("log_intensity"), "left_out")


def library_features(cands: DataFrame, library: DataFrame, keys: Sequence[str]) -> DataFrame:
    """product_hit, product_log, loss_hit, loss_log per candidate.

    ``cands`` has ``formula`` and ``parent_formula``; logs are divided by the
    95th percentile of the positive ones per spectrum and cut at one.  The
    library is small by its own top-n, but its size is left to Spark to check.
    ``left_out``: formulas of both kinds that the library's limits left out, whose candidates have no features.
    """
    # Formulas are parsed and looked up once per pair of texts, not once per candidate.
    pairs = cands.select("formula", "parent_formula").distinct()
    known = pairs.withColumn("__own", FX.hill(FX.counts(F.col("formula")))).withColumn(
        "__loss", FX.subtract(F.col("parent_formula"), F.col("formula")))
    for kind, key, name in (("product", "__own", "product"), ("neutral_loss", "__loss", "loss")):
        part = library.filter(F.col("kind") == kind).select(
            F.col("formula").alias(key), F.lit(1.0).alias(f"{name}_hit"), F.col("log_intensity").alias(f"{name}_log"))
        known = known.join(part, key, "left").fillna(0.0, [f"{name}_hit", f"{name}_log"])
    known = write_once(known.drop("__own", "__loss"), "formula-pairs").withColumnsRenamed({"formula": "__f", "parent_formula": "__p"})
    rows = cands.join(known, F.col("formula").eqNullSafe(F.col("__f")) & F.col("parent_formula").eqNullSafe(F.col("__p"))).drop("__f", "__p")
    logs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("product_log", "loss_log")])
    long = rows.select(*keys, F.explode(logs).alias("x")).select(*keys, "x.*").filter("value > 0")
    scale = exact_quantiles(long, [*keys, "name"], "value", {"p95": 0.95}).groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == n, F.col("p95"))).alias(f"__{n}") for n in ("product_log", "loss_log")])
    rows = rows.join(scale, list(keys), "left")
    for name in ("product_log", "loss_log"):
        top = F.col(f"__{name}")
        rows = rows.withColumn(name, F.when(
            F.coalesce(top > 1e-8, F.lit(False)), F.least(F.col(name) / top, F.lit(1.0))).otherwise(F.col(name))).drop(top)
    beyond = library.groupBy("kind").agg(F.max("left_out").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return rows.withColumn("left_out", beyond.scalar())


def with_canonical(df: DataFrame) -> DataFrame:
    """``df`` plus ``canonical``, the spelling of its ``formula``; every text is parsed once."""
    texts = df.select(F.col("formula").alias("__text")).distinct().select(
        "__text", FX.canonical(FX.counts(F.col("__text"))).alias("canonical"))
    return df.join(texts, F.col("formula").eqNullSafe(F.col("__text")), "left").drop("__text")


def annotation_support(annotated: DataFrame, pool: DataFrame, pool_bins: DataFrame, bin_width: float = S.BIN_WIDTH) -> DataFrame:
    """Share of annotated peaks whose formula is in the pool, and in the peak's bin.

    ``annotated(spectrum_id, peak_no, mz, formulas)``, ``pool(spectrum_id,
    cand_id, formula)``, ``pool_bins(spectrum_id, cand_id, bin)``.
    """
    keys = ["spectrum_id", "canonical"]
    terms = annotated.filter(F.size("formulas") > 0).select(
        "spectrum_id", "peak_no", S.bin_index(F.col("mz"), bin_width).alias("bin"),
        F.explode("formulas").alias("formula"))
    terms, named = with_canonical(terms), with_canonical(pool)
    in_pool = named.select(*keys).distinct().withColumn("__pool", F.lit(1))
    in_bin = named.join(pool_bins.select("spectrum_id", "cand_id", "bin"), ["spectrum_id", "cand_id"]).select(
        *keys, "bin").distinct().withColumn("__bin", F.lit(1))
    per_peak = (
        terms.join(in_pool, keys, "left").join(in_bin, [*keys, "bin"], "left")
        .groupBy("spectrum_id", "peak_no").agg(
            F.coalesce(F.max("__pool"), F.lit(0)).alias("p"), F.coalesce(F.max("__bin"), F.lit(0)).alias("b"),
            F.count(F.lit(1)).alias("n")))
    return per_peak.groupBy("spectrum_id").agg(
        F.count(F.lit(1)).alias("annotated_n"), F.sum("n").alias("formula_n"),
        F.avg("p").alias("in_pool"), F.avg("b").alias("in_bin"))


def annotation_mass_delta(annotated: DataFrame, cand_peaks: DataFrame) -> DataFrame:
    """Per annotated (peak, formula): exact masses, their gap to the measured m/z and to the nearest candidate peak.

    ``cand_peaks(spectrum_id, formula, mz)`` are the rendered peaks of the pool.
    """
    rows = annotated.select("spectrum_id", "peak_no", "mz", F.explode("formulas").alias("formula"))
    exact = FX.exact_mass(F.col("formula"))
    rows = rows.withColumn("neutral_exact", exact).withColumn("ion_exact", F.col("neutral_exact") - K.ELECTRON_MASS)
    rows = rows.withColumn("delta", F.col("mz") - F.col("ion_exact"))
    near = rows.select("spectrum_id", "peak_no", "mz", "formula").join(
        cand_peaks.select("spectrum_id", "formula", F.col("mz").alias("__c")), ["spectrum_id", "formula"]
    ).groupBy("spectrum_id", "peak_no", "formula").agg(
        F.min(F.abs(F.col("__c") - F.col("mz"))).alias("nearest"), F.count(F.lit(1)).alias("candidate_peak_n"))
    return rows.join(near, ["spectrum_id", "peak_no", "formula"], "left")


def pair_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Outer comparison by id of two (formula, exact_mass) tables."""
    l_rows = left.select(key, F.col("formula").alias("lf"), F.col("exact_mass").alias("lm"), F.lit(1).alias("__l"))
    r_rows = right.select(key, F.col("formula").alias("rf"), F.col("exact_mass").alias("rm"), F.lit(1).alias("__r"))
    status = F.when(F.col("__l").isNull(), "left missing").when(F.col("__r").isNull(), "right missing").otherwise("both")
    same = FX.hill(FX.counts(F.col("lf"))) == FX.hill(FX.counts(F.col("rf")))
    return l_rows.join(r_rows, key, "full_outer").select(
        key, status.alias("status"), same.cast("int").alias("formula_match"),
        (F.col("rm") - F.col("lm")).alias("exact_mass_delta"))


def annotation_table(peaks: DataFrame, spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotation rows, rejected spectra with their first error).

    ``peaks(spectrum_id, peak_no, mz, annotation)`` holds the quoted text of a
    peak; ``spectra(spectrum_id, ion_formula)`` the precursor ion formula.  One
    bad annotation rejects its whole spectrum.
    """
    annotated = peaks.filter(F.col("annotation").isNotNull()).select("spectrum_id", "peak_no", "mz", "annotation")
    # Annotations are read once per text, terms once per term and precursor: both repeat from peak to peak.
    texts = annotated.select("annotation").distinct().select("annotation", F.posexplode(F.split("annotation", ";")).alias("part_no", "part"))
    stripped = F.regexp_replace(F.trim("part"), r" ?\d+/\d+$", "")
    core = F.split_part(F.split_part(stripped, F.lit("/"), F.lit(1)), F.lit("="), F.lit(1))
    texts = texts.withColumn("__s", stripped).filter(~F.col("__s").isin("?", "more")).withColumn("product_text", core)
    error = (
        F.when(F.col("annotation").contains("|"), "glycans not supported")
        .when(F.col("annotation").rlike(r"^(?:a|b|y)\d+|^pi"), "peptides not supported")
        .when(F.col("__s") == "", "empty annotation")
        .otherwise(FX.annotation_error(F.col("product_text"))))
    texts = texts.select("annotation", "part_no", "product_text", error.alias("error"))
    rejected = annotated.join(texts.filter(F.col("error").isNotNull()), "annotation").groupBy("spectrum_id").agg(
        F.min_by("error", F.struct("peak_no", "part_no")).alias("error"))
    good = annotated.join(texts.filter(F.col("error").isNull()).select("annotation", "product_text"), "annotation").join(
        rejected.select("spectrum_id"), "spectrum_id", "left_anti").join(spectra.select("spectrum_id", "ion_formula"), "spectrum_id")
    parsed = good.select(F.col("product_text").alias("__t"), F.col("ion_formula").alias("__i")).distinct()
    parsed = parsed.withColumn("__a", FX.parse_annotation(F.col("__t"), F.col("__i"))).withColumn("__f", F.col("__a.formula"))
    loss = F.map_zip_with(FX.counts(F.col("__i")), F.col("__f"),
                          lambda k, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    parsed = parsed.select(
        "__t", "__i", FX.alphabetic(F.col("__f"), True).alias("product"), FX.alphabetic(loss, True).alias("loss"),
        F.col("__a.isotope").alias("isotope"), F.col("__a.charge").alias("charge"),
        (FX.mass_of(F.col("__f")) + F.col("__a.isotope") * F.lit(K.NEUTRON_MASS)).alias("exact_mz"))
    rows = good.join(parsed, (F.col("product_text") == F.col("__t")) & F.col("ion_formula").eqNullSafe(F.col("__i")))
    return rows.select("spectrum_id", "peak_no", "mz", "product", "loss", "isotope", "charge", "exact_mz"), rejected


def candidate_descriptors(cands: DataFrame, keys: Sequence[str], peaks: DataFrame) -> DataFrame:
    """The fifteen formula descriptors of a candidate.

    ``cands`` has ``formula`` and ``parent_formula``; ``peaks(keys, bin,
    intensity)`` are the candidate's isotope peaks, a fixed number each.
    """
    own, parent = F.col("__own"), F.col("__parent")
    rows = cands.withColumn("__own", FX.counts(F.col("formula"))).withColumn(
        "__parent", FX.counts(F.col("parent_formula")))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda a, v: a + v)
    lost = F.map_zip_with(parent, own, lambda k, a, b: F.greatest(
        F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)), F.lit(0)))
    mass, parent_mass = F.col("mass"), FX.mass_of(parent)
    rows = rows.withColumn("mass", FX.mass_of(own)).withColumn("__pm", parent_mass).withColumn("__lost", lost)
    num = FX.dbe_numerator(F.col("formula"))
    described = rows.select(
        *keys, total(own).alias("atoms"), F.size(own).alias("elements"), "mass", (num / 2.0).alias("dbe"),
        (num < 0).cast("int").alias("negative_dbe"), F.pmod(F.abs(num), F.lit(2)).alias("odd_dbe"),
        F.greatest(F.col("__pm") - mass, F.lit(0.0)).alias("loss_mass"), total(F.col("__lost")).alias("loss_atoms"),
        F.size(F.filter(F.map_values("__lost"), lambda v: v > 0)).alias("loss_elements"),
        FX.halogens(F.col("formula")).alias("halogens"), F.abs(F.col("__pm") - mass).alias("precursor_gap"))
    whole = W.partitionBy(*keys)  # isotope peaks of one candidate
    shares = peaks.filter(F.col("intensity") > 0).withColumn(
        "p", F.col("intensity") / F.greatest(F.sum("intensity").over(whole), F.lit(TINY))
    ).withColumn("shift", F.col("bin") - F.min("bin").over(whole))
    n = F.count(F.lit(1))
    at = lambda k: F.sum(F.when(F.col("shift") == k, F.col("p")).otherwise(0.0))
    isotopes = shares.groupBy(*keys).agg(
        F.when(n > 1, -F.sum(F.col("p") * F.log("p")) / F.log(n.cast("double"))).otherwise(0.0).alias("isotope_entropy"),
        at(0).alias("m0"), at(1).alias("m1"), at(2).alias("m2"))
    return described.join(isotopes, list(keys), "left").fillna(0.0, ["isotope_entropy", "m0", "m1", "m2"])


def prior_score(rows: DataFrame, out: str = "prior_score") -> DataFrame:
    """Label-free prior of a candidate formula.

    Needs ``formula``, ``parent_formula``, ``precursor_mz`` and, when a library
    is used, the four columns of ``library_features``.
    """
    rows = rows.withColumns({
        "__mass": FX.exact_mass(F.col("formula")), "__pm": FX.exact_mass(F.col("parent_formula")),
        "__dbe": FX.dbe_numerator(F.col("formula")),
        "__loss": FX.subtract(F.col("parent_formula"), F.col("formula")),
    })
    loss_mass = F.greatest(F.col("__pm") - F.col("__mass"), F.lit(0.0))
    closest = F.least(*[F.abs(loss_mass - F.lit(m)) for m in K.PRIOR_LOSS_MASSES])
    hills = [FX.hill(FX.counts(F.lit(x))) for x in K.PRIOR_LOSSES]
    gap = F.abs(F.col("__pm") - F.col("__mass")) / F.greatest("precursor_mz", F.lit(1e-6))
    score = (
        F.when(F.col("__dbe") < 0, -2.0).otherwise(0.8)
        + 1.2 * F.exp(-(closest * closest) / (2.0 * 0.8 * 0.8))
        + F.when(F.col("__loss").isin(*hills), 1.0).otherwise(0.0)
        - F.when(F.col("precursor_mz") > 0, 0.5 * F.least(gap, F.lit(1.0))).otherwise(0.0))
    if "product_hit" in rows.columns:
        score = score + F.col("product_hit") + 0.5 * F.col("product_log") + 0.8 * F.col("loss_hit") + 0.4 * F.col("loss_log")
    return rows.withColumn(out, score).drop("__mass", "__pm", "__dbe", "__loss")


def plausibility(prior: Column, source_flag: Column, break_depth: Column, ring_cut: Column, peak_n: Column) -> Column:
    """Prior plus source, depth, ring and peak-count terms.

    Source 1 is structural, 2 a common loss, 3 both.
    """
    struct, loss = source_flag.isin(1, 3), source_flag.isin(2, 3)
    bonus = F.when(struct, 1.2).otherwise(0.0) + F.when(loss, 1.0).otherwise(0.0) + F.when(struct & loss, 0.4).otherwise(0.0)
    depth = F.when(break_depth == 1, 0.8).when(break_depth == 2, 0.55).when(break_depth == 3, 0.35).when(
        break_depth >= 4, 0.2).otherwise(0.0)
    ring = F.when(ring_cut > 0, 0.4).otherwise(0.0)
    peaks = 0.05 * F.log1p(peak_n) - F.when(peak_n <= 0, 1.0).otherwise(0.0)
    return prior + bonus + depth - ring + peaks


def support_signatures(cand_bins: DataFrame) -> DataFrame:
    """``signature`` per candidate: an order-free 128-bit digest of its set of bins.

    Two candidates share it when their bins agree; the bins themselves are
    never collected.
    """
    cells = cand_bins.select("spectrum_id", "cand_id", "bin").distinct()
    return cells.groupBy("spectrum_id", "cand_id").agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"),
                    F.hex(F.bit_xor(F.xxhash64(F.lit(1), "bin"))), F.hex(F.bit_xor(F.xxhash64(F.lit(2), "bin")))
                    ).alias("signature"), F.count(F.lit(1)).alias("n_bins"), F.min("bin").alias("first_bin"))


def coverage_score(cand_bins: DataFrame, true_bins: DataFrame, max_shift: int) -> DataFrame:
    """Per candidate the best shifted overlap: max over shifts of sum(true * intensity)."""
    moved = cand_bins.select(
        "spectrum_id", "cand_id", "intensity", "bin", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))).alias("shift")
    ).withColumn("bin", F.col("bin") + F.col("shift"))
    true = true_bins.select("spectrum_id", "bin", F.col("intensity").alias("__t"))
    per_shift = moved.join(true, ["spectrum_id", "bin"], "left").groupBy("spectrum_id", "cand_id", "shift").agg(
        F.sum(F.coalesce(F.col("__t") * F.col("intensity"), F.lit(0.0))).alias("s"))
    return per_shift.groupBy("spectrum_id", "cand_id").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("coverage_score"))


def peak_summary(
    cand_bins: DataFrame, precursors: DataFrame, peak_slots: int = 32, bin_width: float = S.BIN_WIDTH
) -> DataFrame:
    """Eight scaled summaries of a candidate's peaks.

    Mean and deviation come from sums of the centred bin numbers, so one
    aggregate with map-side combine is enough; the entropy uses
    -sum(p ln p) = ln(total) - sum(x ln x) / total.
    """
    mz = S.bin_to_mz(F.col("bin"), bin_width)
    x = F.col("intensity")
    rows = cand_bins.filter(x > 0).withColumn("__mz", mz)
    agg = rows.groupBy("spectrum_id", "cand_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.max(x).alias("hi"),
        F.sum(x * F.log(x)).alias("xl"), F.avg("__mz").alias("mean"), F.stddev_pop("__mz").alias("std"))
    pmz = F.greatest("precursor_mz", F.lit(1e-6))
    slots = F.log(F.lit(float(max(2, peak_slots))))
    return agg.join(precursors.select("spectrum_id", "precursor_mz"), "spectrum_id").select(
        "spectrum_id", "cand_id", (F.col("n") / 32.0).alias("count"), F.col("s").alias("total"), F.col("hi").alias("largest"),
        ((F.log("s") - F.col("xl") / F.col("s")) / slots).alias("entropy"), (F.col("mean") / 1500.0).alias("mz_mean"),
        (F.col("std") / 300.0).alias("mz_std"), (F.col("mean") / pmz).alias("relative_center"),
        (F.greatest(F.col("precursor_mz") - F.col("mean"), F.lit(0.0)) / pmz).alias("relative_gap"))


def subset_peak_summary(
    members: DataFrame, precursors: DataFrame, subset: str = "subset_id", peak_slots: int = 32, bin_width: float = S.BIN_WIDTH
) -> DataFrame:
    """The eight summaries for every subset of a spectrum's peaks, one row per (spectrum, subset).

    ``members(spectrum_id, subset, bin, intensity)``; a subset may overlap others.  Peaks with a negative bin or an
    intensity that is missing, not finite or not positive are not valid: they keep their subset in the result but add
    nothing.  A subset without valid peaks has zeros, and the whole precursor as its gap; a spectrum without a
    precursor counts as precursor 0.  One aggregate with map-side combine, as for candidates.
    """
    x = F.col("intensity").cast("double")
    valid = F.coalesce((F.col("bin") >= 0) & (x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))
    rows = members.select("spectrum_id", subset, F.when(valid, x).alias("__x"), F.when(valid, S.bin_to_mz(F.col("bin"), bin_width)).alias("__mz"))
    v, zero = F.col("__x"), F.lit(0.0)
    agg = rows.groupBy("spectrum_id", subset).agg(
        F.count("__x").alias("n"), F.coalesce(F.sum(v), zero).alias("s"), F.coalesce(F.max(v), zero).alias("hi"), F.sum(v * F.log(v)).alias("xl"),
        F.coalesce(F.avg("__mz"), zero).alias("mean"), F.coalesce(F.stddev_pop("__mz"), zero).alias("std"))
    pmz = F.coalesce(F.col("precursor_mz"), zero)
    per = F.greatest(pmz, F.lit(1e-6))
    entropy = F.when(F.col("n") > 0, (F.log("s") - F.col("xl") / F.col("s")) / F.log(F.lit(float(max(2, peak_slots))))).otherwise(0.0)
    return agg.join(precursors.select("spectrum_id", "precursor_mz"), "spectrum_id", "left").select(
        "spectrum_id", subset, (F.col("n") / 32.0).alias("count"), F.col("s").alias("total"), F.col("hi").alias("largest"), entropy.alias("entropy"),
        (F.col("mean") / 1500.0).alias("mz_mean"), (F.col("std") / 300.0).alias("mz_std"), (F.col("mean") / per).alias("relative_center"),
        (F.greatest(pmz - F.col("mean"), zero) / per).alias("relative_gap"))


def peak_features(cand_bins: DataFrame, precursors: DataFrame, bin_width: float = S.BIN_WIDTH) -> DataFrame:
    """Six features of every candidate peak."""
    mz, pmz = S.bin_to_mz(F.col("bin"), bin_width), F.greatest("precursor_mz", F.lit(1e-6))
    return cand_bins.join(precursors.select("spectrum_id", "precursor_mz"), "spectrum_id").select(
        "spectrum_id", "cand_id", "bin", (mz / 1500.0).alias("mz_scaled"), (mz / pmz).alias("mz_relative"),
        (F.greatest(F.col("precursor_mz") - mz, F.lit(0.0)) / pmz).alias("gap_relative"), "intensity",
        F.log1p(F.greatest("intensity", F.lit(0.0))).alias("log_intensity"),
        (F.col("intensity") > 0).cast("int").alias("valid"))


# Ion forms of a fragment and their mass shifts.
ION_MODES = (
    ("[M+H]+", K.ISOTOPE_MASS["H"] - 0.000548579909),
    ("[M]+", 0.0),
    ("[M-H]+", -(K.ISOTOPE_MASS["H"] + 0.000548579909)),
    ("[M-2H]+", -2 * K.ISOTOPE_MASS["H"]),
    ("[M-3H]+", -2 * K.ISOTOPE_MASS["H"] - (K.ISOTOPE_MASS["H"] + 0.000548579909)),
)


def loss_events(fragments: DataFrame, keys: Sequence[str], max_mz: float = S.MAX_MZ, bin_width: float = S.BIN_WIDTH) -> DataFrame:
    """Each fragment in five ion forms: m/z, bin, neutral-loss mass and precursor gap.

    ``fragments`` has ``formula``, ``parent_formula`` and ``precursor_mz``.
    """
    modes = F.array(*[F.struct(F.lit(n).alias("mode"), F.lit(m).alias("shift")) for n, m in ION_MODES])
    rows = fragments.withColumn("__m", FX.exact_mass(F.col("formula"))).withColumn(
        "loss_mass", F.greatest(FX.exact_mass(F.col("parent_formula")) - F.col("__m"), F.lit(0.0)))
    rows = rows.withColumn("__mode", F.explode(modes)).withColumn("mz", F.col("__m") + F.col("__mode.shift"))
    return rows.filter((F.col("mz") > 0) & (F.col("mz") < max_mz)).select(
        *keys, F.col("__mode.mode").alias("mode"), "mz", S.bin_index(F.col("mz"), bin_width).alias("bin"), "loss_mass",
        F.abs(F.col("precursor_mz") - F.col("mz")).alias("precursor_gap"))


def train_split(group_key: Column, seed: int = 42) -> Column:
    """The default split used for train-only libraries."""
    return sampling.split_name(sampling.uniform_hash(group_key, seed))
