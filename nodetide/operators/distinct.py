"""Numbers of distinct nodes from kept sketches: merged over days, and met between periods, without reading metrics again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
#: Relative error of an estimate, two standard deviations; exact while a sketch holds all its hashes (2^14 of them).
ERROR = 2 / (1 << LG_K) ** 0.5


def daily_nodes(metrics: DataFrame, day_seconds: int = 86_400) -> DataFrame:
    """One theta sketch of the node ids for each provider and day: the table that is kept. New days are appended."""
    day = F.floor(F.col("window_ts") / day_seconds).alias("day")
    return metrics.groupBy("cloud_provider", day).agg(F.theta_sketch_agg("node_id", F.lit(LG_K)).alias("nodes"))


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")


def nodes_of_periods(kept: DataFrame, first: tuple[int, int], second: tuple[int, int]) -> DataFrame:
    """Distinct nodes per provider in two periods of days (ends included), in both and in either. A union is one sketch a provider."""
    def union(lo: int, hi: int) -> Column:
        return F.theta_union_agg(F.when(F.col("day").between(lo, hi), F.col("nodes")), F.lit(LG_K))

    merged = kept.groupBy("cloud_provider").agg(union(*first).alias("a"), union(*second).alias("b"))
    return merged.select("cloud_provider", _estimate(F.col("a")).alias("nodes_first"), _estimate(F.col("b")).alias("nodes_second"),
                         _estimate(F.theta_intersection("a", "b")).alias("nodes_both"), _estimate(F.theta_union("a", "b", LG_K)).alias("nodes_either"))
