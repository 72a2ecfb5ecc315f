"""Registered queries against their SQL. STRANDFRAME_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_motif_counts", "m1_scan_motifs", "m2_scan_plain", "m3_motif_count_range", "m8_bin_quality", "m13_closest_match", "m16_call_sites",
    "m20_pwm_best", "m21_empirical_p", "m26_kmer_lookup", "p5_translate_codons", "p6_orfs", "p19_mask_vector", "v9_run_lengths", "v15_sliding_similarity",
    "v18_coverage", "v20_fuzzy_join", "v22_nearest_feature", "v25_merge_intervals", "j15_all_pairs", "j18_asof_pair", "a15_regimen_cohorts", "a22_prediction_sets",
    "g2_closure", "g5_informative", "g9_consensus", "e3_enrich_terms", "e4_permutation_enrich", "e6_overlap_matrix", "e8_empirical_overlap", "e12_sam_statistics",
    "e15_gsea", "e21_auc", "c3_value_at", "c5_responder_wnd", "c7_responder_share", "w10_row_pairs", "l1_stratified_splits", "l5_knn", "l6_dlda", "l12_outliers",
    "l15_medoid_partition", "o12_multi_intersect", "s6_s7_fasta_round_trip", "s20_read_expression", "t1_stream_scan", "t2_stream_dedupe", "t3_stream_responder",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("STRANDFRAME_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name]) is None


def test_entry_and_names(spark):
    assert contract.entry(spark).columns == ["seq_id", "motif", "n_hits", "first_start", "last_end"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
