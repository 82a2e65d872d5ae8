"""Registered queries against their SQL on the smallest tables.

A spread of queries by default; all of them with PAIRWRIGHT_ALL=1.
"""

import os

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SPREAD = (
    "scan_jobs_star", "sink_search_requests", "parse_skills", "tokenize_bm25", "filter_location", "filter_fields", "geo_radius_join",
    "company_logo_update", "exclusion_union", "score_distribution", "empirical_cdf", "bm25_search", "build_training_dataset",
    "related_skills", "skill_similarity", "page_window", "fallback_fill", "match_user_jobs", "fuse_scores", "ranking_report",
    "class_separation", "contrastive_losses", "explain_summary", "extract_skills_patterns", "extract_skill_lists", "statsd_rollup", "retain_days",
    "bottleneck_report", "task_latest_status", "page_best_image", "asset_validity",
)
ALL = sorted(oracle_sql())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ALL if os.environ.get("PAIRWRIGHT_ALL") else SPREAD)
def test_query_equals_sql(spark, sql, name):
    message, _, good = check.compare(spark, sql, FOLDER, name, queries()[name], oracle_sql()[name])
    assert good, message


def test_names_and_entry(spark):
    assert set(oracle_sql()) <= set(queries())
    if os.path.isdir(FOLDER):
        assert entry(spark).limit(1).count() == 1
