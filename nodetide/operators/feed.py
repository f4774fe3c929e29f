"""The replay of a test period as one record set per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.config import TraceConfig

FEED_COLUMNS = ["node_id", "window_ts", "cpu_usage_norm", "mem_usage_norm", "n_records", "sev"]


def metrics_with_logs(metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """Metric rows and log-only rows of one provider; a missing severity is 0."""
    joined = metrics.select("node_id", "window_ts", "cpu_usage_norm", "mem_usage_norm", "n_records").join(
        logs, ["node_id", "window_ts"], "full_outer"
    )
    return joined.withColumn("sev", F.coalesce("sev", F.lit(0)).cast("int")).select(*FEED_COLUMNS)


TEST_SHARE = 0.15


def test_start(metrics: DataFrame) -> int:
    """First window of the test period, the last 15 % of the provider's trace, from the set of its windows."""
    windows = metrics.agg(F.collect_set("window_ts").alias("ws"))  # as many as the trace has steps, however many nodes
    cut = f"array_min(ws) + (array_max(ws) - array_min(ws)) * {1 - TEST_SHARE}D"
    return windows.select(F.expr(f"array_min(filter(ws, w -> w >= {cut}))")).first()[0]


def seed_and_test(rows: DataFrame, start: int, cfg: TraceConfig) -> DataFrame:
    """Marks the rows before the test period that its first windows reach back to, and the test rows."""
    seed_from = start - cfg.history_windows * cfg.step
    part = F.when(F.col("window_ts") >= start, "test").when(F.col("window_ts") >= seed_from, "seed")
    return rows.withColumn("part", part).filter(F.col("part").isNotNull())


def first_windows(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first n windows. The window list is sorted and cut before it is joined back."""
    if n <= 0:
        return rows
    chosen = rows.select("window_ts").distinct().orderBy("window_ts").limit(n)
    return rows.join(F.broadcast(chosen), "window_ts", "left_semi")
