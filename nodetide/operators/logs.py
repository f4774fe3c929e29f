"""Metrics to log lines by percentile rules, and log lines back to severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.config import (
    HEARTBEAT_SHARE, LOG_EPOCH, LOG_EPOCH_SECONDS, LOG_LEVELS, LOG_MESSAGES, LOG_PATTERNS,
    LOG_TIME_FORMAT, PERCENT_PROVIDER, PROVIDERS, SEVERITY_ERROR, SEVERITY_WARN,
)
from nodetide.functions.expressions import node_key, stable_uniform
from nodetide.operators.providers import per_provider
from nodetide.operators.ranks import exact_quantiles

QUANTILE_ACCURACY = 10_000


def provider_quantiles(df: DataFrame, columns: dict[str, str], probs: dict[str, float],
                       accuracy: int = QUANTILE_ACCURACY) -> DataFrame:
    """Percentiles per provider in one pass, from mergeable sketches of bounded size.

    `columns` maps output prefix to column, `probs` output suffix to probability. Fewer rows than `accuracy`
    per provider give exact values; beyond that the rank error is at most 1/accuracy.
    """
    aggs = [
        F.percentile_approx(column, list(probs.values()), F.lit(accuracy)).alias(prefix)
        for prefix, column in columns.items()
    ]
    rows = df.groupBy("cloud_provider").agg(*aggs)
    return rows.select("cloud_provider", *[
        F.col(prefix)[i].alias(f"{prefix}{suffix}")
        for prefix in columns for i, suffix in enumerate(probs)
    ])


def log_thresholds(unified: DataFrame) -> DataFrame:
    """Exact percentiles, however many rows there are: a threshold one rank off gives other log lines.

    A row each for all providers; one whose values are all null has null thresholds.
    """
    found = exact_quantiles(
        unified, {"cpu": "cpu_usage_norm", "mem": "mem_usage_norm"}, {"95": 0.95, "99": 0.99}
    )
    return unified.select("cloud_provider").distinct().join(F.broadcast(found), "cloud_provider", "left")


def classify(unified: DataFrame, thresholds: DataFrame, heartbeat: Column | None = None) -> DataFrame:
    """Reason per row, first rule wins; rows without a reason are dropped."""
    if heartbeat is None:
        heartbeat = stable_uniform(F.col("node_id"), F.col("window_ts").cast("string")) < HEARTBEAT_SHARE
    cpu, mem = F.col("cpu_usage_norm"), F.col("mem_usage_norm")
    reason = (
        F.when(mem >= F.col("mem99"), "MEM_CRIT")
        .when(cpu >= F.col("cpu99"), "CPU_CRIT")
        .when(cpu >= F.col("cpu95"), "CPU_HIGH")
        .when(mem >= F.col("mem95"), "MEM_HIGH")
        .when(heartbeat, "HEARTBEAT")
    )
    return (
        per_provider(unified, thresholds)
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .drop("cpu95", "cpu99", "mem95", "mem99")
    )


def random_heartbeat(seed: int = 42) -> Column:
    """Heartbeats drawn by the seeded generator; depends on how rows are partitioned."""
    return F.rand(seed) < HEARTBEAT_SHARE


def _level(provider: str) -> Column:
    words = LOG_LEVELS[provider]
    return (
        F.when(F.col("reason").endswith("_CRIT"), words["CRIT"])
        .when(F.col("reason").endswith("_HIGH"), words["HIGH"])
        .otherwise(words["OTHER"])
    )


def _message(provider: str) -> Column:
    texts = LOG_MESSAGES[provider]
    known = reduce(
        lambda chain, item: chain.when(F.col("reason") == item[0], item[1]),
        list(texts.items())[1:],
        F.when(F.col("reason") == list(texts)[0], list(texts.values())[0]),
    )
    return known.otherwise(F.concat(F.lit("active_tasks="), F.col("n_records").cast("string")))


def log_time(window_ts: Column) -> Column:
    """Wall-clock text of a trace second; zone-free, so the session time zone has no effect."""
    moment = F.timestamp_add("SECOND", window_ts, F.lit(LOG_EPOCH).cast("timestamp_ntz"))
    return F.date_format(moment, LOG_TIME_FORMAT)


def render(classified: DataFrame) -> DataFrame:
    """Adds the log line, in the provider's own format."""
    ts = log_time(F.col("window_ts"))
    a, b = PERCENT_PROVIDER, [p for p in PROVIDERS if p != PERCENT_PROVIDER][0]
    piped = F.concat_ws(
        " | ", ts, _level(a), F.concat(F.lit("alibaba-node-"), F.col("machine_id")), _message(a)
    )
    bracketed = F.concat(
        ts, F.lit(" ["), _level(b), F.lit("] gcp-host-"), F.col("machine_id"), F.lit(" : "), _message(b)
    )
    line = F.when(F.col("cloud_provider") == a, piped).otherwise(bracketed)
    return classified.withColumn("log_line", line)


def reason_counts(classified: DataFrame) -> DataFrame:
    return (
        classified.groupBy("cloud_provider", "reason")
        .agg(F.count(F.lit(1)).alias("lines"))
        .orderBy("cloud_provider", F.desc("lines"), "reason")
    )


def parse(lines: DataFrame, provider: str) -> DataFrame:
    """Text rows (`value`) of one provider to (node, window, severity); other rows, and those with an impossible time, are dropped."""
    pattern = LOG_PATTERNS[provider]
    fields = lines.select(
        F.regexp_extract("value", pattern, 1).alias("ts"),
        F.regexp_extract("value", pattern, 2).alias("level"),
        F.regexp_extract("value", pattern, 3).alias("machine_id"),
    ).filter(F.col("ts") != "")
    severity = (
        F.when(F.col("level").isin(*SEVERITY_ERROR), 2)
        .when(F.col("level").isin(*SEVERITY_WARN), 1)
        .otherwise(0)
    )
    seconds = F.unix_timestamp(F.expr("try_cast(ts AS TIMESTAMP_NTZ)"))
    return fields.select(
        node_key(F.lit(provider), F.col("machine_id")).alias("node_id"),
        (seconds - F.lit(LOG_EPOCH_SECONDS)).alias("window_ts"),
        severity.alias("sev"),
    ).filter((F.col("sev") > 0) & F.col("window_ts").isNotNull())


def parse_all(lines: dict[str, DataFrame]) -> DataFrame:
    parts = [parse(df, provider) for provider, df in lines.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


def severity_max(parsed: DataFrame) -> DataFrame:
    """Worst severity per node and window; repeated lines shrink before the shuffle."""
    return parsed.groupBy("node_id", "window_ts").agg(F.max("sev").alias("sev"))
