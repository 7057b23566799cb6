"""Registered queries against their SQL on the smallest data.

A spread of queries runs by default; CHECK_ALL=1 runs every one.
"""

import os

import pytest

from checks.compare import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
SPREAD = [
    "harmonise_expression", "project_full_schema", "clean_whole_table", "dedup_rows", "repair_counts", "validate_strict",
    "preprocess_issues", "preservation_check", "column_profile", "numeric_describe", "quick_check", "adjust_by",
    "adjust_in_buckets", "number_tokens", "text_tokens", "tfidf_weights", "text_clean", "file_typing", "build_contexts",
    "parse_responses", "knn_topk_by_blocks", "similarity_pairs", "noise_log", "noise_table", "noise_sweep_counts",
    "library_nearest", "library_stats", "library_versions", "csv_roundtrip", "read_nested_archives", "irregular_rows",
    "incremental_harmonise", "read_quoted_breaks", "ingest_typed", "ingest_two_layouts", "knn_near_ties", "map_properties",
    "similarity_pairs_hashed", "library_update_repeated", "outliers", "text_facts", "issues_rendered", "knn_join_bounded", "profile_merged",
    "noise_exact", "unmatched_columns", "name_mentions_blanks", "fix_udtf", "incremental_irregular", "incremental_issue_state",
    "read_quoted_breaks_split", "read_json_array_split", "lenient_dates_by_column", "library_bundle_errors", "run_with_recipes",
]
NAMES = list(QUERIES) if os.environ.get("CHECK_ALL") else SPREAD


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, words = compare(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR)
    assert ok, words


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_id", "GeneSymbol", "FoldChange", "PValue", "PValue_bh"] and df.count() > 0
