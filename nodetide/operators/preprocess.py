"""Two unlike usage traces to one table of (provider, node, window)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.config import INSTANCE_PROVIDER, PERCENT_PROVIDER, TraceConfig
from nodetide.functions.expressions import bucket, node_key

UNIFIED_COLUMNS = ["cloud_provider", "node_id", "machine_id", "window_ts",
                   "cpu_usage_norm", "mem_usage_norm", "n_records"]


# -------------------------------------------------------------------- sources
@dataclass(frozen=True)
class Source:
    """How a raw trace becomes numbers: output column -> (field, type), the range its values must lie in, and divisors."""

    columns: dict[str, tuple[str, str]]
    valid: dict[str, str]
    units: dict[str, int] = field(default_factory=dict)

    def typed(self, raw: DataFrame) -> DataFrame:
        """The machine and the typed columns; text in a numeric field becomes null instead of failing the job."""
        made = ["CAST(machine_id AS STRING) AS machine_id"]
        for name, (source, kind) in self.columns.items():
            unit = f" / {self.units[name]}" if name in self.units else ""
            made.append(f"try_cast({source} AS {kind}){unit} AS {name}")
        return raw.selectExpr(*made)

    def in_range(self, rows: DataFrame) -> DataFrame:
        """Drops readings outside the valid range, such as the markers -1 and 101."""
        for column, rule in self.valid.items():
            rows = rows.filter(f"{column} {rule}")
        return rows

    def clean(self, raw: DataFrame) -> DataFrame:
        """Typed, complete and valid rows."""
        return self.in_range(drop_incomplete(self.typed(raw)))


PERCENT = Source(
    {"ts": ("time_stamp", "BIGINT"), "cpu": ("cpu_util_percent", "DOUBLE"), "mem": ("mem_util_percent", "DOUBLE")},
    {"cpu": "BETWEEN 0 AND 100", "mem": "BETWEEN 0 AND 100"})
INSTANCES = Source(
    {"ts": ("start_time", "BIGINT"), "cpu": ("average_usage.cpus", "DOUBLE"), "mem": ("average_usage.memory", "DOUBLE")},
    {"cpu": ">= 0", "mem": ">= 0"}, {"ts": 1_000_000})  # microseconds
PREAGGREGATED = Source(
    {"window_ts": ("window_ts", "BIGINT"), "cpu_sum": ("cpu_sum", "DOUBLE"), "mem_sum": ("mem_sum", "DOUBLE"), "n_records": ("n_records", "BIGINT")},
    {"cpu_sum": ">= 0", "mem_sum": ">= 0"})
CAPACITY = Source({"cap_cpu": ("cap_cpu", "DOUBLE"), "cap_mem": ("cap_mem", "DOUBLE")}, {"cap_cpu": "> 0", "cap_mem": "> 0"})
MACHINE_EVENTS = Source({"cap_cpu": ("capacity.cpus", "DOUBLE"), "cap_mem": ("capacity.memory", "DOUBLE")}, CAPACITY.valid)


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


# ---------------------------------------------------------------- aggregations
def rollup_average(samples: DataFrame, step: int) -> DataFrame:
    """Percent samples to mean fractions per machine and window; partial sums run before the shuffle."""
    return (
        samples.groupBy("machine_id", bucket(F.col("ts"), step).alias("window_ts"))
        .agg(
            (F.avg("cpu") / 100.0).alias("cpu_usage_norm"),
            (F.avg("mem") / 100.0).alias("mem_usage_norm"),
            F.count(F.lit(1)).alias("n_records"),
        )
    )


def rollup_sum(samples: DataFrame, step: int) -> DataFrame:
    """Instance usage added up per machine and window."""
    return (
        samples.groupBy("machine_id", bucket(F.col("ts"), step).alias("window_ts"))
        .agg(
            F.sum("cpu").alias("cpu_sum"),
            F.sum("mem").alias("mem_sum"),
            F.count(F.lit(1)).alias("n_records"),
        )
    )


def largest_capacity(capacities: DataFrame) -> DataFrame:
    """Largest capacity of each kind seen per machine; machines without a positive one of both are left out."""
    most = capacities.groupBy("machine_id").agg(*[F.max(c).alias(c) for c in CAPACITY.columns])
    return CAPACITY.in_range(most)


def capacity_from_events(events: DataFrame) -> DataFrame:
    """Capacity per machine, from nested machine events; events without one are nulls, which a maximum ignores."""
    return largest_capacity(MACHINE_EVENTS.typed(events))


def capacity_from_table(raw: DataFrame) -> DataFrame:
    return largest_capacity(CAPACITY.clean(raw))


def with_capacity(usage: DataFrame, capacity: DataFrame) -> DataFrame:
    """Inner join on the machine.

    No broadcast hint: the machine list has no fixed bound, so Spark chooses from the measured size, and splits a
    machine whose windows fill one partition. Usage is already one row per machine and window here.
    """
    return usage.join(capacity, "machine_id")


def normalised(usage: DataFrame) -> DataFrame:
    """Sums as a share of capacity, at most 1."""
    return usage.select(
        "machine_id",
        "window_ts",
        F.least(F.lit(1.0), F.col("cpu_sum") / F.col("cap_cpu")).alias("cpu_usage_norm"),
        F.least(F.lit(1.0), F.col("mem_sum") / F.col("cap_mem")).alias("mem_usage_norm"),
        "n_records",
    )


# ----------------------------------------------------------------- whole stage
def percent_usage(raw: DataFrame, cfg: TraceConfig) -> DataFrame:
    samples = PERCENT.clean(raw)
    return rollup_average(samples, cfg.step)


def instance_usage(raw: DataFrame, capacity: DataFrame, cfg: TraceConfig) -> DataFrame:
    samples = INSTANCES.clean(raw)
    return normalised(with_capacity(rollup_sum(samples, cfg.step), capacity))


def preaggregated_usage(raw: DataFrame, capacity: DataFrame) -> DataFrame:
    rows = PREAGGREGATED.clean(raw)
    return normalised(with_capacity(rows, capacity))


def unify(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of the providers' usage by column name, with the node key."""
    frames = [df.withColumn("cloud_provider", F.lit(name)) for name, df in parts.items()]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole.withColumn(
        "node_id", node_key(F.col("cloud_provider"), F.col("machine_id"))
    ).select(*UNIFIED_COLUMNS)


def unified_usage(percent_raw: DataFrame, instance_raw: DataFrame, machine_events: DataFrame,
                  cfg: TraceConfig) -> DataFrame:
    return unify({
        PERCENT_PROVIDER: percent_usage(percent_raw, cfg),
        INSTANCE_PROVIDER: instance_usage(instance_raw, capacity_from_events(machine_events), cfg),
    })


def trace_summary(unified: DataFrame) -> DataFrame:
    """Sanity figures per provider.

    Rows are first counted per node, so the distinct count is a plain count of groups and no provider's
    rows meet in one task.
    """
    per_node = unified.groupBy("cloud_provider", "node_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("window_ts").alias("min_ts"),
        F.max("window_ts").alias("max_ts"),
        F.sum("cpu_usage_norm").alias("cpu"),
        F.count("cpu_usage_norm").alias("cpu_n"),
        F.sum("mem_usage_norm").alias("mem"),
        F.count("mem_usage_norm").alias("mem_n"),
    )
    return per_node.groupBy("cloud_provider").agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("machines"),
        F.round(F.sum("rows") / F.count(F.lit(1)), 0).alias("windows_per_machine"),
        F.min("min_ts").alias("min_ts"),
        F.max("max_ts").alias("max_ts"),
        F.round(F.sum("cpu") / F.sum("cpu_n"), 3).alias("avg_cpu"),
        F.round(F.sum("mem") / F.sum("mem_n"), 3).alias("avg_mem"),
    )
