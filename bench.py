"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from peakwise.plans import load_all  # noqa: E402
from peakwise.plans.registry import QUERIES  # noqa: E402
from peakwise.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_quality_by_instrument", "p01_bin_floor", "p07_merge_molecule_spectra", "p10_normalise_kinds", "p12_top_peaks",
    "p14_candidate_bins", "j06_tolerance_match_da", "j07_nearest_distance", "j08_exact_mass_range", "j17_library_search",
    "m21_ndcg", "m25_correlations", "c12_isotope_envelope", "c18_peak_summary", "a11_candidate_probe", "a24_overlap_teacher",
    "k02_group_unique_topk", "k07_bin_quota", "f03_row_policy", "s08_stratified_pick",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-bench-"),
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.log.level": "ERROR"})
    load_all()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
