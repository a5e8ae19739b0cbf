"""Spectrum transforms over long peak tables: bin, merge, normalise, cut, project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.functions import spectrum as S
from peakwise.skew import with_group_stats

ID = ["spectrum_id"]
TINY = 1e-12


def _merge(intensity: Column, agg: str) -> Column:
    if agg == "sum":
        return F.sum(intensity)
    if agg == "max":
        return F.max(intensity)
    raise ValueError(f"unknown merge {agg}")


def log_sum_exp(df: DataFrame, keys: Sequence[str], value: str, out: str, eps: float = 1e-9) -> DataFrame:
    """Stable log-sum-exp per group: group maximum first, shifted sum second."""
    top = with_group_stats(df, keys, __top=F.max(value))
    return top.groupBy(*keys).agg(
        (F.max("__top") + F.log(F.sum(F.exp(F.col(value) - F.col("__top"))) + F.lit(eps))).alias(out)
    )


def filter_peaks(peaks: DataFrame, min_intensity: float = 0.0, max_mz: float = 0.0) -> DataFrame:
    """Finite peaks above ``min_intensity`` and below ``max_mz`` (0 or less: no limit)."""
    keep = S.is_peak(F.col("mz"), F.col("intensity")) & (F.col("intensity") > min_intensity)
    if max_mz > 0:
        keep = keep & (F.col("mz") < max_mz)
    return peaks.filter(keep)


def bin_spectra(
    peaks: DataFrame, keys: Sequence[str] = ID, bin_width: float = S.BIN_WIDTH,
    max_mz: float = S.MAX_MZ, mode: str = "floor", parts: int | None = None,
) -> DataFrame:
    """Summed intensity per (keys, bin) for 0 <= bin <= floor(max_mz / bin_width).

    After this step a spectrum has at most that many rows, so later windows
    over one binned spectrum have a fixed size bound.  With ``parts`` the peaks
    are dealt into so many partitions by spectrum and bin before they are
    summed, and the result stays dealt that way.
    """
    rows = (
        peaks.filter(S.is_peak(F.col("mz"), F.col("intensity")))
        .withColumn("bin", S.bin_index(F.col("mz"), bin_width, mode))
        .filter(F.col("bin").between(0, S.last_bin(bin_width, max_mz)))
    )
    if parts:
        rows = rows.select(*keys, "bin", "intensity").repartition(parts, *ID, "bin")
    return rows.groupBy(*keys, "bin").agg(F.sum("intensity").alias("intensity"))


def bin_spectra_centred(
    peaks: DataFrame, first_center: float, bin_width: float, n_bins: int, keys: Sequence[str] = ID
) -> DataFrame:
    """Bins centred on ``first_center + k * bin_width``, divided by the spectrum total."""
    binned = (
        peaks.withColumn("bin", S.bin_centred(F.col("mz"), first_center, bin_width))
        .filter(F.col("bin").between(0, n_bins - 1))
        .groupBy(*keys, "bin").agg(F.sum("intensity").alias("intensity"))
    )
    whole = W.partitionBy(*keys)  # at most n_bins rows per spectrum
    return binned.withColumn(
        "intensity", F.col("intensity") / F.greatest(F.sum("intensity").over(whole), F.lit(1e-6))
    )


def bin_spectra_edges(
    peaks: DataFrame, resolution: float = 0.01, agg: str = "sum", precursors: DataFrame | None = None,
    as_mz: bool = False, keys: Sequence[str] = ID,
) -> DataFrame:
    """Bins between right-open edges; ``agg`` is sum, max or lse (log intensities).

    With ``precursors(spectrum_id, precursor_mz)`` the peaks sharing the
    precursor's bin keep their bin but count as zero intensity.
    """
    rows = peaks.withColumn("bin", S.bin_edge(F.col("mz"), resolution))
    if precursors is not None:
        rows = rows.join(precursors.select(*keys, "precursor_mz"), list(keys), "left")
        same = F.col("bin") == S.bin_edge(F.col("precursor_mz"), resolution)
        rows = rows.withColumn(
            "intensity", F.when(F.coalesce(same, F.lit(False)), 0.0).otherwise(F.col("intensity"))
        )
    if agg == "lse":
        out = log_sum_exp(rows, [*keys, "bin"], "intensity", "intensity")
    else:
        out = rows.groupBy(*keys, "bin").agg(_merge(F.col("intensity"), agg).alias("intensity"))
    if as_mz:
        centre = (F.col("bin") + 1) * F.lit(resolution) - F.lit(resolution / 2.0)
        out = out.withColumn("mz", centre).drop("bin")
    return out


def histogram(peaks: DataFrame, edges: Sequence[float], keys: Sequence[str] = ID) -> DataFrame:
    """Weighted histogram: right-open buckets, the last one closed; outside is dropped."""
    last = len(edges) - 2
    bucket: Column = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        upper = (F.col("mz") <= hi) if i == last else (F.col("mz") < hi)
        bucket = F.when((F.col("mz") >= lo) & upper, i).otherwise(bucket)
    return (
        peaks.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
        .groupBy(*keys, "bucket").agg(F.sum("intensity").alias("weight"))
    )


def merge_integer_mass(peaks: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Sum per integer mass, rounding half to even."""
    return peaks.groupBy(*keys, F.rint("mz").cast("long").alias("mass")).agg(
        F.sum("intensity").alias("intensity")
    )


def merge_rounded_mz(
    peaks: DataFrame, decimals: int = 4, agg: str = "sum", keys: Sequence[str] = ID
) -> DataFrame:
    """Merge peaks whose m/z agree after rounding; ``agg`` is sum, max or lse."""
    scale = F.lit(float(10**decimals))
    rows = peaks.withColumn("mz", F.rint(F.col("mz") * scale) / scale)
    if agg == "lse":
        return log_sum_exp(rows, [*keys, "mz"], "intensity", "intensity")
    return rows.groupBy(*keys, "mz").agg(_merge(F.col("intensity"), agg).alias("intensity"))


def merge_group_spectra(
    peaks: DataFrame, spectra: DataFrame, group: str, agg: str = "sum", renormalise: bool = False
) -> DataFrame:
    """Union of the peaks of all spectra of a group, same m/z merged, long form."""
    rows = peaks.join(spectra.select("spectrum_id", group), "spectrum_id")
    merged = rows.groupBy(group, "mz").agg(_merge(F.col("intensity"), agg).alias("intensity"))
    if renormalise:
        merged = with_group_stats(merged, [group], __total=F.sum("intensity")).withColumn(
            "intensity", F.col("intensity") / F.nullif(F.col("__total"), F.lit(0.0))
        ).drop("__total")
    return merged


def merge_group_meta(
    spectra: DataFrame, group: str, first: Sequence[str], kept_lists: Sequence[str] = ()
) -> DataFrame:
    """Metadata of the first spectrum of each group; energies as sorted distinct values or dropped."""
    aggs = [F.min_by(c, "spectrum_id").alias(c) for c in first]
    aggs += [F.array_sort(F.collect_set(c)).alias(c) for c in kept_lists]
    return spectra.groupBy(group).agg(F.count(F.lit(1)).alias("n_spectra"), *aggs)


def drop_precursor_bin(
    peaks: DataFrame, precursors: DataFrame, bin_width: float = S.BIN_WIDTH, mode: str = "floor"
) -> DataFrame:
    """Peaks outside the precursor's bin; spectra without a positive precursor keep all."""
    rows = peaks.join(precursors.select("spectrum_id", "precursor_mz"), "spectrum_id", "left")
    same = S.bin_index(F.col("mz"), bin_width, mode) == S.bin_index(F.col("precursor_mz"), bin_width, mode)
    return rows.filter(~F.coalesce(same & (F.col("precursor_mz") > 0), F.lit(False))).drop("precursor_mz")


def drop_precursor_window(
    peaks: DataFrame, precursors: DataFrame, tol_da: float, isotopes: int = 0, step: float = 1.0
) -> DataFrame:
    """Peaks further than ``tol_da`` from the precursor and its isotope lines."""
    rows = peaks.join(precursors.select("spectrum_id", "precursor_mz"), "spectrum_id", "left")
    return rows.filter(
        ~S.near_precursor(F.col("mz"), F.col("precursor_mz"), tol_da, isotopes, step)
    ).drop("precursor_mz")


def normalise(
    peaks: DataFrame, kind: str, keys: Sequence[str] = ID, value: str = "intensity", out: str | None = None
) -> DataFrame:
    """l1, l2, max1000, max100 or minmax per group; a tiny norm gives zeros."""
    return normalise_many(peaks, {out or value: kind}, keys, value)


def shares(binned: DataFrame, keys: Sequence[str] = ID) -> DataFrame:
    """Binned intensities divided by their total.

    For binned rows only: a group has at most one row per bin of the axis, so a
    window over it is bounded and saves the second scan ``normalise`` takes.
    """
    total = F.sum("intensity").over(W.partitionBy(*keys))
    return binned.withColumn("intensity", F.when(total > TINY, F.col("intensity") / total).otherwise(0.0))


def normalise_many(
    peaks: DataFrame, kinds: dict[str, str], keys: Sequence[str] = ID, value: str = "intensity"
) -> DataFrame:
    """Several normalisations (output column -> kind) from one pass of group totals."""
    x = F.col(value)
    rows = with_group_stats(
        peaks, keys, __l1=F.sum(x), __l2=F.sqrt(F.sum(x * x)), __hi=F.max(x), __lo=F.min(x)
    )
    forms = {
        "l1": (x, F.col("__l1")),
        "l2": (x, F.col("__l2")),
        "max1000": (x * 1000.0, F.col("__hi")),
        "max100": (x * 100.0, F.col("__hi")),
        "minmax": (x - F.col("__lo"), F.col("__hi") - F.col("__lo")),
    }
    cols = {o: F.when(forms[k][1] > TINY, forms[k][0] / forms[k][1]).otherwise(0.0) for o, k in kinds.items()}
    return rows.withColumns(cols).drop("__l1", "__l2", "__hi", "__lo")


def transform_intensities(peaks: DataFrame, kind: str) -> DataFrame:
    return peaks.withColumn("intensity", S.transform_intensity(F.col("intensity"), kind))


def restore_intensities(peaks: DataFrame, kind: str, keys: Sequence[str] = ID) -> DataFrame:
    rows = with_group_stats(peaks, keys, __top=F.max("intensity"))
    return rows.withColumn(
        "intensity", S.restore_intensity(F.col("intensity"), F.col("__top"), kind)
    ).drop("__top")


# Spark limits a ranked group before the shuffle below this k only.
WIDE_K = 1000
WIDE_PARTS = 64


def top_peaks(
    rows: DataFrame, k: int, keys: Sequence[str] = ID, value: str = "intensity", tie: str = "bin"
) -> DataFrame:
    """The k strongest rows per group, ties by ascending ``tie``; column ``rank`` from 1.

    Each task sends at most k rows of a group however large the group is: Spark
    pushes the rank filter below the shuffle for small k.  From ``WIDE_K`` on it
    does not, and the group is ranked in ``WIDE_PARTS`` parts by hash first.
    """
    if k >= WIDE_K:
        part = F.pmod(F.xxhash64(F.col(value), F.col(tie)), F.lit(WIDE_PARTS))
        inside = W.partitionBy(*keys, part).orderBy(F.col(value).desc(), F.col(tie))
        rows = rows.withColumn("rank", F.row_number().over(inside)).filter(F.col("rank") <= k).drop("rank")
    order = W.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def precursor_target(
    peaks: DataFrame, precursors: DataFrame, bin_width: float = S.BIN_WIDTH, max_mz: float = S.MAX_MZ
) -> DataFrame:
    """Per spectrum: precursor bin, its intensity, its share and whether it is present."""
    binned = bin_spectra(peaks, bin_width=bin_width, max_mz=max_mz)
    pre = precursors.filter(F.col("precursor_mz") > 0).select(
        "spectrum_id", S.bin_index(F.col("precursor_mz"), bin_width).alias("precursor_bin")
    )
    at = F.col("bin") == F.col("precursor_bin")
    return (
        pre.join(binned, "spectrum_id", "left")
        .groupBy("spectrum_id", "precursor_bin")
        .agg(
            F.coalesce(F.sum(F.when(at, F.col("intensity"))), F.lit(0.0)).alias("precursor_intensity"),
            F.coalesce(F.sum("intensity"), F.lit(0.0)).alias("__total"),
            F.coalesce(F.max(at.cast("int")), F.lit(0)).alias("present"),
        )
        .withColumn(
            "share",
            F.when(F.col("__total") > TINY, F.col("precursor_intensity") / F.col("__total")).otherwise(0.0),
        )
        .drop("__total")
    )


def bin_candidates(
    cand_peaks: DataFrame, k: int | None = 32, l1: bool = False, bin_width: float = S.BIN_WIDTH,
    max_mz: float = S.MAX_MZ, parts: int | None = None,
) -> DataFrame:
    """Candidate peaks per bin, summed; the k strongest bins of each candidate.

    ``l1`` divides by the candidate total and then keeps bins in m/z order.
    """
    keys = ["spectrum_id", "cand_id"]
    binned = bin_spectra(cand_peaks.filter(F.col("mz") < max_mz), keys, bin_width, max_mz, parts=parts)
    if l1:
        binned = shares(binned, keys)
    if k is None:
        return binned
    if l1:
        first = W.partitionBy(*keys).orderBy("bin")
        return binned.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return top_peaks(binned, k, keys)


def project_candidates(
    cand_bins: DataFrame, probs: DataFrame, shifts: dict[int, float] | None = None,
    bin_width: float = S.BIN_WIDTH, max_mz: float = S.MAX_MZ,
) -> DataFrame:
    """Expected spectrum: sum of probability times candidate intensity per bin.

    ``shifts`` maps bin offsets to weights; shifted bins outside the axis are lost.
    """
    rows = cand_bins.join(probs.select("spectrum_id", "cand_id", "prob"), ["spectrum_id", "cand_id"])
    weighted = F.col("prob") * F.col("intensity")
    top = S.last_bin(bin_width, max_mz)
    if shifts:
        moves = F.array(*[F.struct(F.lit(int(o)).alias("o"), F.lit(float(w)).alias("w"))
                          for o, w in shifts.items()])
        rows = rows.filter(F.col("bin").between(0, top)).withColumn("move", F.explode(moves))
        rows = rows.withColumn("bin", F.col("bin") + F.col("move.o"))
        weighted = weighted * F.col("move.w")
    return (
        rows.withColumn("__v", weighted).filter(F.col("bin").between(0, top))
        .groupBy("spectrum_id", "bin").agg(F.sum("__v").alias("intensity"))
    )


def project_exact(
    cand_peaks: DataFrame, probs: DataFrame, top_k: int = 0, min_prob: float = 0.0
) -> DataFrame:
    """Peaks (m/z, probability times intensity) of the kept candidates, unbinned."""
    kept = top_peaks(probs, top_k, ID, "prob", "cand_id").drop("rank") if top_k > 0 else probs
    if top_k <= 0 or min_prob > 0:
        kept = kept.filter(F.col("prob") > min_prob)
    return (
        cand_peaks.join(kept.select("spectrum_id", "cand_id", "prob"), ["spectrum_id", "cand_id"])
        .withColumn("intensity", F.col("intensity") * F.col("prob"))
        .filter(S.is_peak(F.col("mz"), F.col("intensity")))
        .select("spectrum_id", "cand_id", "mz", "intensity")
    )


def sparsify_probs(probs: DataFrame, top_k: int = 0, min_prob: float = 0.0) -> DataFrame:
    """Zero small or low-ranked probabilities and renormalise; an emptied row keeps all.

    The rank cut is a limit-pushed top-k joined back as a flag, so no task ever
    holds a whole candidate pool.
    """
    keys = ["spectrum_id", "cand_id"]
    rows = probs.select(*keys, "prob")
    keep = (F.col("prob") >= min_prob) if min_prob > 0 else F.lit(True)
    if top_k > 0:
        best = top_peaks(rows, top_k, ID, "prob", "cand_id").select(*keys, F.lit(True).alias("__in"))
        rows = rows.join(best, keys, "left")
        keep = keep & F.col("__in").isNotNull()
    rows = rows.withColumn("__kept", F.when(keep, F.col("prob")).otherwise(0.0))
    rows = with_group_stats(rows, ID, __sum=F.sum("__kept"), __all=F.sum("prob"))
    return rows.select(
        *keys,
        F.when(F.col("__sum") > 1e-8, F.col("__kept") / F.col("__sum"))
        .otherwise(F.col("prob") / F.greatest(F.col("__all"), F.lit(1e-8))).alias("prob"),
    )


def sparsify_prediction(peaks: DataFrame, min_prob: float, l1: bool = True) -> DataFrame:
    """Optionally divide by the total, then keep values above ``min_prob``."""
    rows = normalise(peaks, "l1") if l1 else peaks
    return rows.filter(F.col("intensity") > min_prob)


def union_support(cand_bins: DataFrame) -> DataFrame:
    """Largest candidate intensity per bin of each spectrum."""
    return cand_bins.groupBy("spectrum_id", "bin").agg(F.max("intensity").alias("intensity"))


def dedup(df: DataFrame, keys: Sequence[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Unique keys with out = (agg, column); agg is sum, min, mean, max or lse."""
    simple = {"sum": F.sum, "min": F.min, "mean": F.avg, "max": F.max}
    plain = [simple[a](c).alias(out) for out, (a, c) in aggs.items() if a != "lse"]
    result = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    for out, (agg, col) in aggs.items():
        if agg == "lse":
            result = result.join(log_sum_exp(df, keys, col, out), list(keys))
    return result.select(*keys, *aggs)


def mask_above_precursor(binned: DataFrame, precursors: DataFrame, offset: int) -> DataFrame:
    """Bins at or below precursor bin + offset."""
    return (
        binned.join(precursors.select("spectrum_id", "precursor_bin"), "spectrum_id")
        .filter(F.col("bin") <= F.col("precursor_bin") + offset).drop("precursor_bin")
    )


def reverse_around_precursor(binned: DataFrame, precursors: DataFrame, offset: int, n_bins: int) -> DataFrame:
    """Mirror the axis so that bin b becomes precursor + offset - b, wrapping modulo n_bins."""
    edge = F.least(F.lit(n_bins), F.col("precursor_bin") + offset + 1)
    return (
        binned.join(precursors.select("spectrum_id", "precursor_bin"), "spectrum_id")
        .withColumn("bin", F.pmod(edge - 1 - F.col("bin"), F.lit(n_bins))).drop("precursor_bin")
    )


def peak_arrays(binned: DataFrame, mz_col: str = "mz") -> DataFrame:
    """One row per spectrum with m/z and intensity arrays sorted by m/z.

    For merged or binned peaks only: their number per spectrum is bounded by
    the m/z axis, which is what makes one array per spectrum safe.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(mz_col).alias("mz"), "intensity")))
    return binned.groupBy("spectrum_id").agg(pairs.alias("pairs")).select(
        "spectrum_id",
        F.transform("pairs", lambda p: p["mz"]).alias("mzs"),
        F.transform("pairs", lambda p: p["intensity"]).alias("intensities"),
    )


def vector_to_peaks(binned: DataFrame, cutoff: float = 0.0, keys: Sequence[str] = ID) -> DataFrame:
    """Integer-bin vector to peaks at bin + 1: drop shares below ``cutoff``, renormalise."""
    share = normalise(binned, "l1", keys).filter(F.col("intensity") >= cutoff)
    return normalise(share, "l1", keys).select(
        *keys, (F.col("bin") + 1).cast("double").alias("mz"), "intensity"
    )
