"""Telemetry tables derived from the given `events` and `customer` tables.

A user is an instance, ten users share a machine. Even machines report in percent, odd machines report usage per
instance against a capacity taken from customer balances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.config import PERCENT_COLUMNS, TraceConfig
from nodetide.operators import logs as L
from nodetide.operators import preprocess as P
from nodetide.session import scratch_path
from nodetide.sources.writers import write_partitioned

TRACE_EPOCH_SECONDS = 1704067200  # 2024-01-01 00:00:00, second 0 of the trace
CHECK = TraceConfig(step=3600, use_day=False, chunk_steps=240)


_STAGED: dict[tuple, str] = {}


def staged(spark: SparkSession, key: tuple, build, *partition: str) -> DataFrame:
    """A stage table: built once per session into the shared folder, then read by every later stage.

    Stages hand over written tables, so a lost executor costs a re-read and no stage repeats the work before it.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _STAGED:
        path = scratch_path(spark, str(key[1]))
        if partition:
            write_partitioned(build(), path, *partition)
        else:
            build().write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return rows.select(
        F.expr("user_id div 10").alias("machine"),
        (F.unix_timestamp("ts") - F.lit(TRACE_EPOCH_SECONDS)).alias("s"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def percent_raw(spark: SparkSession, sf: str) -> DataFrame:
    given = {
        "machine_id": F.col("machine").cast("string"),
        "time_stamp": F.col("s").cast("string"),
        "cpu_util_percent": F.col("value").cast("string"),
        "mem_util_percent": F.col("k").cast("string"),
    }
    rows = events(spark, sf).filter("machine % 2 = 0")
    return rows.select(*[given.get(c, F.lit(None).cast("string")).alias(c) for c in PERCENT_COLUMNS])


def instance_raw(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).filter("machine % 2 = 1").select(
        F.col("machine").cast("string").alias("machine_id"),
        (F.col("s") * 1_000_000).alias("start_time"),
        F.struct((F.col("value") / 100).alias("cpus"), (F.col("k") / 100).alias("memory")).alias("average_usage"),
    )


def machine_events(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("c_acctbal") / 5000
    return (
        spark.read.parquet(f"{sf}/customer.parquet")
        .filter("c_custkey % 10 < 2")
        .select(
            F.expr("c_custkey div 10").cast("string").alias("machine_id"),
            F.struct(size.alias("cpus"), size.alias("memory")).alias("capacity"),
        )
    )


def unified(spark: SparkSession, sf: str, cfg: TraceConfig = CHECK) -> DataFrame:
    return P.unified_usage(percent_raw(spark, sf), instance_raw(spark, sf), machine_events(spark, sf), cfg)


def metrics(spark: SparkSession, sf: str, cfg: TraceConfig = CHECK) -> DataFrame:
    """The unified usage as a stage table, partitioned by provider."""
    return staged(spark, ("unified", sf, cfg), lambda: unified(spark, sf, cfg), "cloud_provider")


def classified(spark: SparkSession, sf: str, cfg: TraceConfig = CHECK) -> DataFrame:
    rows = metrics(spark, sf, cfg)
    return L.classify(rows, staged(spark, ("thresholds", sf, cfg), lambda: L.log_thresholds(rows)))


def log_lines(spark: SparkSession, sf: str, cfg: TraceConfig = CHECK) -> DataFrame:
    return L.render(classified(spark, sf, cfg))


def parsed_logs(spark: SparkSession, sf: str, cfg: TraceConfig = CHECK) -> DataFrame:
    lines = log_lines(spark, sf, cfg).select("cloud_provider", F.col("log_line").alias("value"))
    return L.parse_all({
        p: lines.filter(F.col("cloud_provider") == p).select("value") for p in cfg.providers
    })


def severities(spark: SparkSession, sf: str, cfg: TraceConfig = CHECK) -> DataFrame:
    """Worst severity per node and window, from the parsed log lines, as a stage table."""
    return staged(spark, ("severity", sf, cfg), lambda: L.severity_max(parsed_logs(spark, sf, cfg)))


def arrival_rates(spark: SparkSession, sf: str, cfg: TraceConfig = CHECK) -> DataFrame:
    """Events per provider and window."""
    rows = events(spark, sf)
    provider = F.when(F.expr("machine % 2 = 0"), cfg.providers[0]).otherwise(cfg.providers[1])
    window = (F.floor(F.col("s") / cfg.step) * cfg.step).cast("long")
    return rows.groupBy(provider.alias("cloud_provider"), window.alias("window_ts")).agg(
        F.count(F.lit(1)).cast("double").alias("arrival_rate")
    )
