"""Named queries, one or more per operator."""

import importlib

MODULES = [
    "spectra", "quality", "matching", "normalise", "policies", "formulas", "selection", "audits", "graphs", "inputs", "streams",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"peakwise.plans.{name}")
