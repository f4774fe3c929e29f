"""Rows of providers that no setting names are kept; figures of too many providers fail."""

import pytest
from pyspark.sql import functions as F

from nodetide.config import TraceConfig
from nodetide.operators import features as X
from nodetide.operators import logs as L
from nodetide.operators import modeling as M
from nodetide.operators import providers as P
from nodetide.operators import scaling as S

CFG = TraceConfig(step=3600, use_day=False)


def metrics(spark):
    rows = [(p, f"{p}_1", i * 3600, (i * 7 % 10) / 10, (i * 3 % 10) / 10, i % 4 + 1) for p in ("alibaba", "google", "third") for i in range(400)]
    return spark.createDataFrame(rows, "cloud_provider string, node_id string, window_ts long, cpu_usage_norm double, mem_usage_norm double, n_records long")


def per_provider(df):
    return {r[0]: r[1] for r in df.groupBy("cloud_provider").count().collect()}


def test_a_third_provider_is_classified_split_and_scaled(spark):
    m = metrics(spark)
    kept = L.classify(m, L.log_thresholds(m))
    counts = per_provider(kept)
    assert set(counts) == {"alibaba", "google", "third"} and counts["third"] >= 0.9 * counts["google"]
    table = X.feature_table(m, None, CFG)
    counts = per_provider(table)
    assert counts["third"] == counts["google"] > 0
    assert per_provider(X.chrono_split(m, X.provider_bounds(m), CFG))["third"] > 0
    scaled = S.scale_features(table, S.train_stats(table))
    assert per_provider(scaled) == counts
    only_two = S.train_stats(table.filter("cloud_provider <> 'third'"))
    without = S.scale_features(table, only_two).filter("cloud_provider = 'third'")
    assert without.count() == counts["third"] and without.filter(F.col("cpu").isNull()).count() == 0
    long = S.provider_stats(table, ["cpu", "mem"])
    assert per_provider(S.zscore_by_provider(table, long, ["cpu", "mem"])) == counts


def test_too_many_providers_fail(spark):
    table = spark.range(20).selectExpr("CAST(id AS STRING) AS cloud_provider", "id AS x")
    assert P.few_rows(table, 20).count() == 20
    with pytest.raises(Exception, match="more than 19 rows"):
        P.few_rows(table, 19).collect()


@pytest.mark.parametrize("chunk_steps", [16, 50, 1000])
def test_lags_are_the_previous_rows_however_old(spark, chunk_steps):
    steps = [0, 1, 2, 40, 41, 120, 300, 301, 302, 303, 700, 701, 990]
    rows = [("google", "n", s * 3600, s / 1000, 1 - s / 1000) for s in steps]
    m = spark.createDataFrame(rows, "cloud_provider string, node_id string, window_ts long, cpu_usage_norm double, mem_usage_norm double")
    none = spark.createDataFrame([], "node_id string, window_ts long, error_count long, task_arrival_count long, instance_arrival_count long")
    got = M.modeling_ready(m, none, CFG.with_(chunk_steps=chunk_steps)).orderBy("timestamp_sec").collect()
    assert [r.timestamp_sec // 3600 for r in got] == steps
    for i, r in enumerate(got):
        assert r.cpu_lag_1 == (steps[i - 1] / 1000 if i else None) and r.cpu_lag_2 == (steps[i - 2] / 1000 if i > 1 else None)
        assert r.time_delta_sec == ((steps[i] - steps[i - 1]) * 3600 if i else None)


def test_impossible_log_times_are_dropped(spark):
    lines = ["2026-13-45 00:00:00 | ERROR | alibaba-node-7 | x", "2026-01-01 01:00:00 | ERROR | alibaba-node-7 | x"]
    got = L.parse(spark.createDataFrame([(x,) for x in lines], "value string"), "alibaba").collect()
    assert [(r.node_id, r.window_ts, r.sev) for r in got] == [("alibaba_7", 3600, 2)]
