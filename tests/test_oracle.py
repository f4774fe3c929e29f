"""Registered queries against their SQL. NODETIDE_ALL=1 runs every one (some minutes), else one per kind."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = os.environ.get("NODETIDE_SF", "/root/testdata/sf0.001")
SAMPLE = [
    "scan_preagg_usage", "unified_usage", "trace_summary", "log_parse", "filled_grid", "feature_table", "split_summary",
    "train_stats", "scale_features", "cluster_mean_view", "modeling_ready", "scaling_decision", "streaks",
    "window_feed_write", "forecast_series", "feature_table_day", "write_log_text", "zscore_by_provider", "recommend_batch", "transfer_change", "class_report",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("NODETIDE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    assert compare(df, duck, entry.oracle_sql()[name]) is None


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "split" in df.columns


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
