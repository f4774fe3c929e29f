"""Forecasts ahead of the last window: saved models rolled out step by step, beside the models of the longer horizons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodetide.config import TraceConfig
from nodetide.models.store import Scorer, score
from nodetide.operators import features as X
from nodetide.operators.features import provider_spans
from nodetide.session import written

USAGE = ["cpu_usage_norm", "mem_usage_norm", "n_records"]


def carried_tail(metrics: DataFrame, last: int, cfg: TraceConfig) -> DataFrame:
    """The rows that the window `last` reaches back to; nodes not observed in it get a row there with their newest values."""
    tail = metrics.filter(F.col("window_ts") > last - cfg.history_windows * cfg.step).select("cloud_provider", "node_id", "window_ts", *USAGE)
    newest = Window.partitionBy("node_id").orderBy(F.desc("window_ts"))
    behind = tail.withColumn("age", F.row_number().over(newest)).filter(f"age = 1 AND window_ts < {last}").drop("age")
    return tail.unionByName(behind.withColumn("window_ts", F.lit(last).cast("long")))


def _features_at(rows: DataFrame, logs: DataFrame | None, at: int, cfg: TraceConfig) -> DataFrame:
    return X.compute_features(rows, logs, cfg, True, labels=False).filter((F.col("window_ts") == at) & (F.col("rn") > cfg.warmup)).drop("rn")


def roll_out(metrics: DataFrame, logs: DataFrame | None, scorer: Scorer, provider: str, last: int, steps: int, cfg: TraceConfig) -> DataFrame:
    """One row a node and step ahead: cloud_provider, node_id, window_ts, cpu, mem.

    A forecast becomes the node's value in its window, so features and cluster context of the next step are those of the
    forecasts; record counts are carried on and no log lines are assumed. Nodes without a whole history are left out: as
    in the stream, nothing is forecast from frames that are not filled. Each step is a written table of the history's
    length, so neither plans nor tasks grow with the steps.
    """
    rows = written(carried_tail(metrics.filter(F.col("cloud_provider") == provider), last, cfg), "roll-tail")
    made = []
    for k in range(steps):
        at = last + k * cfg.step
        ahead = written(score(_features_at(rows, logs, at, cfg), scorer, cfg.step).select("node_id", "pred_cpu", "pred_mem"), "roll-step")
        now = rows.filter(F.col("window_ts") == at)
        following = now.join(ahead, "node_id", "left").select(
            "cloud_provider", "node_id", (F.col("window_ts") + cfg.step).alias("window_ts"),
            F.coalesce("pred_cpu", "cpu_usage_norm").alias("cpu_usage_norm"), F.coalesce("pred_mem", "mem_usage_norm").alias("mem_usage_norm"), "n_records")
        made.append(ahead.select(F.lit(provider).alias("cloud_provider"), "node_id", F.lit(at + cfg.step).cast("long").alias("window_ts"),
                                 F.col("pred_cpu").alias("cpu"), F.col("pred_mem").alias("mem")))
        rows = written(rows.filter(F.col("window_ts") > at + cfg.step - cfg.history_windows * cfg.step).unionByName(following), "roll-rows")
    return reduce(DataFrame.unionByName, made)


def direct(metrics: DataFrame, logs: DataFrame | None, scorer: Scorer, provider: str, last: int, horizon: int, cfg: TraceConfig) -> DataFrame:
    """The forecast of a longer horizon's own model from the last window; columns as of `roll_out`."""
    rows = carried_tail(metrics.filter(F.col("cloud_provider") == provider), last, cfg)
    found = score(_features_at(rows, logs, last, cfg), scorer, horizon * cfg.step)
    return found.select(F.lit(provider).alias("cloud_provider"), "node_id", F.col("target_ts").alias("window_ts"), F.col("pred_cpu").alias("cpu"), F.col("pred_mem").alias("mem"))


def ahead(metrics: DataFrame, logs: DataFrame | None, scorers: dict[str, dict[int, Scorer]], steps: int, cfg: TraceConfig) -> DataFrame:
    """Forecasts of all providers: cloud_provider, node_id, window_ts, rolled and direct values, and the one that counts.

    `scorers` has for each provider the saved models by horizon; horizon 1 is rolled out, a longer one gives its own step.
    Where both exist the direct forecast counts.
    """
    spans, parts = provider_spans(metrics, cfg), []
    for provider, models in scorers.items():
        if provider not in spans:
            continue
        last = spans[provider][1]
        rolled = roll_out(metrics, logs, models[1], provider, last, steps, cfg).withColumn("way", F.lit("rolled"))
        parts.append(rolled)
        parts += [direct(metrics, logs, m, provider, last, h, cfg).withColumn("way", F.lit("direct")) for h, m in models.items() if 1 < h <= steps]
    both = reduce(DataFrame.unionByName, parts).groupBy("cloud_provider", "node_id", "window_ts").agg(*[
        F.max(F.when(F.col("way") == way, F.col(m))).alias(f"{way}_{m}") for way in ("rolled", "direct") for m in X.METRICS])
    return both.withColumns({m: F.coalesce(f"direct_{m}", f"rolled_{m}") for m in X.METRICS})


METRIC_NAMES = {"cpu": "cpu", "mem": "memory"}


def cluster_series(forecasts: DataFrame, cpu: str = "cpu", mem: str = "mem", at: str = "window_ts") -> DataFrame:
    """Forecasts of nodes as the report takes them: cloud_provider, metric, t, value (mean over the nodes)."""
    means = forecasts.groupBy("cloud_provider", F.col(at).alias("t")).agg(F.avg(cpu).alias("cpu"), F.avg(mem).alias("memory"))
    return means.select("cloud_provider", "t", F.expr("stack(2, 'cpu', cpu, 'memory', memory) AS (metric, value)"))
