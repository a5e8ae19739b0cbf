"""Column expressions on m/z and intensity."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BIN_WIDTH = 0.01
MAX_MZ = 1005.0
ISOTOPE_STEP = 1.0033548378


def bin_index(mz: Column, bin_width: float = BIN_WIDTH, mode: str = "floor") -> Column:
    """Bin number: ``floor`` (guarded against 0.999.. boundaries) or ``round`` (half even)."""
    if mode == "floor":
        return F.floor(mz / F.lit(bin_width) + F.lit(1e-8))
    if mode == "round":
        return F.rint(mz / F.lit(bin_width)).cast("long")
    raise ValueError(f"unknown bin mode {mode}")


def last_bin(bin_width: float = BIN_WIDTH, max_mz: float = MAX_MZ) -> int:
    return math.floor(max_mz / bin_width)


def bin_centred(mz: Column, first_center: float, bin_width: float) -> Column:
    """Bin whose centre lies nearest, counted from ``first_center``."""
    return F.floor((mz - F.lit(first_center) + F.lit(bin_width / 2.0)) / F.lit(bin_width))


def bin_edge(mz: Column, resolution: float) -> Column:
    """Number of right-open edges (resolution, 2*resolution, ...) at or below mz."""
    return F.floor(mz / F.lit(resolution))


def bin_to_mz(bin_col: Column, bin_width: float = BIN_WIDTH) -> Column:
    return (bin_col + F.lit(0.5)) * F.lit(bin_width)


def is_peak(mz: Column, intensity: Column) -> Column:
    """Finite m/z and positive finite intensity."""
    inf = F.lit(float("inf"))
    return (
        mz.isNotNull() & ~F.isnan(mz) & (F.abs(mz) < inf)
        & intensity.isNotNull() & ~F.isnan(intensity) & (intensity > 0) & (intensity < inf)
    )


def near_precursor(mz: Column, precursor: Column, tol_da: float, isotopes: int, step: float = 1.0) -> Column:
    """Within ``tol_da`` of the precursor or one of its next isotope lines."""
    hit = F.lit(False)
    for k in range(isotopes + 1):
        hit = hit | (F.abs(mz - (precursor + F.lit(k * step))) <= F.lit(tol_da))
    return F.coalesce(hit & (precursor > 0), F.lit(False))


# name -> (forward, backward, transformed value of the reference maximum 1000)
INTENSITY_TRANSFORMS = {
    "log10": (lambda x: F.log10(x + 1.0), lambda y: F.pow(F.lit(10.0), y) - 1.0, math.log10(1001.0)),
    "log10t3": (
        lambda x: F.log10(x / 3.0 + 1.0),
        lambda y: 3.0 * (F.pow(F.lit(10.0), y) - 1.0),
        math.log10(1000.0 / 3.0 + 1.0),
    ),
    "loge": (lambda x: F.log(x + 1.0), lambda y: F.exp(y) - 1.0, math.log(1001.0)),
    "sqrt": (lambda x: F.sqrt(x), lambda y: y * y, math.sqrt(1000.0)),
    "none": (lambda x: x, lambda y: y, 1000.0),
}


def transform_intensity(intensity: Column, kind: str) -> Column:
    return INTENSITY_TRANSFORMS[kind][0](intensity)


def restore_intensity(value: Column, group_max: Column, kind: str) -> Column:
    """Inverse transform after rescaling the group maximum to the maximum 1000 maps to."""
    _, backward, top = INTENSITY_TRANSFORMS[kind]
    scaled = value / (group_max + F.lit(1e-9)) * F.lit(top)
    return F.greatest(backward(scaled), F.lit(0.0))
