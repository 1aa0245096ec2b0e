"""Registered queries against their checking SQL on the smallest scale."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from veriframe.plans import catalog as plain_catalog
from veriframe.plans.adapters import TABLES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracles import normal  # noqa: E402

SF = "/root/testdata/sf0.001"
# One query per family; ALL_ORACLES=1 runs every checked query outside the training-data subpackage.
NAMES = [
    "score", "coverage", "display_order", "facts", "audit_integrity", "dedup_url", "url_mentions", "quota_select", "dedup_near",
    "also_found", "cross_source", "nearest_hash", "reuse", "fold_text", "lead_quote", "quote_choice", "mention_join", "provenance", "geo_within", "resolve_decide",
    "profile_chain", "is_stub", "classify_domain", "rejected_items", "cold_latency", "known_pool", "ix_enrich", "hierarchy_walk", "claims_best", "obs_parse", "cand_commons", "moderate", "upload_status", "rate_daily",
    "search_and_or", "resolve_cards", "osa_similarity", "entity_facts", "run_summary", "run_vision", "run_figures", "cand_open",
    "late_sources", "session_timings", "session_timings_live", "late_reject_live", "rate_sliding_live", "resolve_ttl",
]
if os.environ.get("ALL_ORACLES"):
    NAMES = sorted(plain_catalog.ORACLES)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    left = normal(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(entry.oracle_sql()[name])
    right = normal([d[0] for d in result.description], result.fetchall())
    assert left == right


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
