"""Named queries against their SQL twins on the smallest tables.

A selection by default; PEAKWISE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SELECTION = [
    "flagship_quality_by_instrument", "p01_bin_floor", "p09_drop_precursor_isotopes", "p17_sparsify_probs", "p21_reverse_axis",
    "m03_js_similarity", "m04_stein_dot", "m21_ndcg", "m25_correlations", "j06_tolerance_match_relative", "j07_nearest_distance",
    "j09_bin_window_support", "j17_library_search", "n13_collision_energy", "n14_strict_energies", "n25_content_key", "f01_ingest_policy",
    "f11_removal_counts", "s01_stable_split", "s08_stratified_pick", "c03_formula_styles", "c06_parse_annotation", "c12_isotope_envelope",
    "j11_common_losses", "k02_group_unique_topk", "k05_active_pool", "k07_bin_quota", "a03_numeric_summary", "a06_split_leakage",
    "a11_union_at_k", "a23_quality_labels", "g02_single_cuts", "g07_wl_fingerprint", "io01_read_msp", "io05_header_scan",
    "k09_coverage_aware_topk", "k10_setcover_teacher", "k11_region_set_cover", "k12_marginal_coverage", "j14_annotation_mass_delta",
    "io04_annotated_library", "io06_library_files", "io15_manifest", "t03_expiring_conditions", "u04_table_function_on_peak_lines",
    "u05_table_function_on_formulas", "u06_table_function_on_spectra", "c20_subset_summaries", "a09_annotation_library", "j12_library_features",
    "g04_recursive_fragments", "a11_candidate_probe",
    "t02_tumbling_means", "t06_stream_stream_join", "u02_sql_functions_on_formulas",
]
ORACLE = entry_module.oracle_sql()
NAMES = list(ORACLE) if os.environ.get("PEAKWISE_ALL") else SELECTION


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    assert compare(duck, entry_module.queries()[name](spark, SF), ORACLE[name]) is None


def test_entry_and_names(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(ORACLE) <= set(entry_module.queries())


@pytest.mark.parametrize("name, cut", [
    ("a09_annotation_library_all", "a09_annotation_library"), ("g04_recursive_fragments_all", "g04_recursive_fragments")])
def test_whole_queries(spark, duck, name, cut):
    whole = entry_module.queries()[name](spark, SF)
    assert compare(duck, whole, ORACLE[name]) is None
    assert whole.count() > entry_module.queries()[cut](spark, SF).count()
