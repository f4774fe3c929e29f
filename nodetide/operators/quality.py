"""Error figures of forecasts and classifiers, each from one aggregation."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(rows: DataFrame, pred: str, actual: str, *keys: str) -> DataFrame:
    """RMSE, MAE and R2 (1 - mse / population variance)."""
    mse = f"avg(pow({pred} - {actual}, 2))"
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"sqrt({mse})").alias("rmse"),
        F.expr(f"avg(abs({pred} - {actual}))").alias("mae"),
        F.expr(f"1 - {mse} / greatest(var_pop({actual}), 1e-12D)").alias("r2"),
    )


def skill_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Model error beside the two baselines (current value, 6-row mean) and the skill against each."""
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("sqrt(avg(pow(pred - tgt_raw, 2)))").alias("rmse"),
        F.expr("avg(abs(pred - tgt_raw))").alias("mae"),
        F.expr("1 - avg(pow(pred - tgt_raw, 2)) / greatest(var_pop(tgt_raw), 1e-12D)").alias("r2"),
        F.expr("sqrt(avg(pow(cur_raw - tgt_raw, 2)))").alias("rmse_persist"),
        F.expr("sqrt(avg(pow(ma6_raw - tgt_raw, 2)))").alias("rmse_ma6"),
    )
    return base.selectExpr(
        "*",
        "1 - rmse / greatest(rmse_persist, 1e-12D) AS skill_persist",
        "1 - rmse / greatest(rmse_ma6, 1e-12D) AS skill_ma6",
    )


def cluster_mean(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean of all nodes per window, so that errors are judged at cluster level."""
    return rows.groupBy(*keys, "window_ts").agg(*[
        F.avg(c).alias(c) for c in ("cur_raw", "tgt_raw", "ma6_raw", "pred")
    ])


def two_views(rows: DataFrame, *keys: str) -> DataFrame:
    """Skill per machine and on the cluster mean."""
    per_machine = skill_metrics(rows, *keys).withColumn("view", F.lit("per_machine"))
    overall = skill_metrics(cluster_mean(rows, *keys), *keys).withColumn("view", F.lit("cluster_mean"))
    return per_machine.unionByName(overall)


def confusion_matrix(rows: DataFrame, actual: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(pred).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(matrix: DataFrame) -> DataFrame:
    """Weighted precision, recall and F1 and the recall of class 1, from a binary confusion matrix."""
    cells = matrix.agg(*[
        F.expr(f"CAST(coalesce(sum(n) FILTER (WHERE actual = {a} AND predicted = {p}), 0) AS DOUBLE) AS n{a}{p}")
        for a in (0, 1) for p in (0, 1)
    ])
    ratios = cells.selectExpr(
        "n00 + n01 + n10 + n11 AS n", "n00 + n01 AS sup0", "n10 + n11 AS sup1",
        "coalesce(try_divide(n00, n00 + n10), 0D) AS p0", "coalesce(try_divide(n11, n01 + n11), 0D) AS p1",
        "coalesce(try_divide(n00, n00 + n01), 0D) AS r0", "coalesce(try_divide(n11, n10 + n11), 0D) AS r1",
    )
    return ratios.selectExpr(
        "CAST(n AS BIGINT) AS n",
        "(sup0 * p0 + sup1 * p1) / n AS weighted_precision",
        "(sup0 * r0 + sup1 * r1) / n AS weighted_recall",
        "(sup0 * coalesce(try_divide(2 * p0 * r0, p0 + r0), 0D)"
        " + sup1 * coalesce(try_divide(2 * p1 * r1, p1 + r1), 0D)) / n AS weighted_f1",
        "r1 AS active_recall",
    )


def auc_roc(rows: DataFrame, actual: str, score: str, buckets: int = 1024) -> DataFrame:
    """Area under the ROC curve by average ranks.

    Equal scores are counted together first. The distinct scores are then cut into ranges of about equal size, so
    neither the global order nor a crowded stretch of scores passes through one task; the cumulative count runs inside
    each range, with the totals of the ranges before it added.
    """
    counted = rows.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(actual).isNotNull()).groupBy(
        F.col(score).cast("double").alias("score")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(actual).cast("long")).alias("pos")
    )
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = counted.agg(F.percentile_approx("score", shares, F.lit(10 * buckets)).alias("cuts")).first()["cuts"]
    edges = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    placed = Bucketizer(splits=edges if len(edges) > 2 else [edges[0], 0.0, edges[1]], inputCol="score",
                        outputCol="bucket").transform(counted)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("bucket").agg(F.sum("n").alias("bucket_n"))  # one row per range
    offsets = totals.select("bucket", F.coalesce(F.sum("bucket_n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(offsets), "bucket").select(
        "n", "pos",
        (F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0)) + (F.col("n") + 1) / 2).alias("avg_rank"),
    )
    sums = ranked.agg(
        F.sum("pos").cast("double").alias("p"), F.sum("n").cast("double").alias("t"),
        F.sum(F.col("pos") * F.col("avg_rank")).alias("rank_sum"),
    )
    return sums.selectExpr(
        "CAST(p AS BIGINT) AS positives", "CAST(t - p AS BIGINT) AS negatives",
        "try_divide(rank_sum - p * (p + 1) / 2, p * (t - p)) AS auc",
    )


def count_errors(rows: DataFrame, pred: str, actual: str) -> DataFrame:
    """Errors of predicted counts: mean Poisson deviance, and RMSE/MAE/R2 on log1p and on the plain scale."""
    y, mu = actual, f"greatest({pred}, 1e-9D)"
    log_mse = f"avg(pow(ln(1 + {y}) - ln(1 + {pred}), 2))"
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"avg(2 * (CASE WHEN {y} > 0 THEN {y} * ln({y} / {mu}) ELSE 0D END - ({y} - {mu})))").alias(
            "poisson_deviance"),
        F.expr(f"sqrt({log_mse})").alias("rmse_log"),
        F.expr(f"avg(abs(ln(1 + {y}) - ln(1 + {pred})))").alias("mae_log"),
        F.expr(f"1 - {log_mse} / greatest(var_pop(ln(1 + {y})), 1e-12D)").alias("r2_log"),
        F.expr(f"sqrt(avg(pow({y} - {pred}, 2)))").alias("rmse"),
        F.expr(f"avg(abs({y} - {pred}))").alias("mae"),
    )


def live_error(previous: DataFrame, actual: DataFrame) -> DataFrame:
    """Error per window of predictions made one window earlier, once their target has arrived; for each provider where
    the predictions name it."""
    by = [c for c in ("cloud_provider",) if c in previous.columns]
    due = previous.select(
        *by, "node_id", F.col("target_ts").alias("window_ts"), "pred_cpu", "pred_mem", "cur_cpu", "cur_mem"
    )
    arrived = actual.filter("cpu_usage_norm IS NOT NULL").select(
        "node_id", "window_ts", "cpu_usage_norm", "mem_usage_norm"
    )
    return due.join(arrived, ["node_id", "window_ts"]).groupBy(*by, "window_ts").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.expr(f"sqrt(avg(pow({who}_{m} - {m}_usage_norm, 2)))").alias(f"rmse_{m}_{label}")
            for m in ("cpu", "mem") for who, label in (("pred", "model"), ("cur", "persist"))
        ],
    )


def running_error(per_window: DataFrame) -> DataFrame:
    """RMSE over all windows so far, of each provider; the input is one row per provider and window, however many nodes."""
    by = [c for c in ("cloud_provider",) if c in per_window.columns]
    so_far = Window.partitionBy(*by).orderBy("window_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [c for c in per_window.columns if c.startswith("rmse_")]
    total = F.sum("n").over(so_far)
    return per_window.select(
        *by, "window_ts", total.alias("n_total"),
        *[F.sqrt(F.sum(F.col("n") * F.col(c) * F.col(c)).over(so_far) / total).alias(f"running_{c}") for c in names],
    )


def parity(stream: DataFrame, batch: DataFrame, features: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Largest absolute difference per feature over the rows both sides have, largest first."""
    key = ["node_id", "window_ts"]
    both = stream.select(*key, *[F.col(f).alias(f"s_{f}") for f in features]).join(
        batch.select(*key, *[F.col(f).alias(f"b_{f}") for f in features]), key
    )
    worst = both.agg(F.count(F.lit(1)).alias("matched"), *[F.expr(f"max(abs(s_{f} - b_{f})) AS {f}") for f in features])
    pairs = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    return worst.selectExpr("matched", f"stack({len(features)}, {pairs}) AS (feature, max_diff)").selectExpr(
        "feature", "matched", "max_diff", f"max_diff IS NULL OR isnan(max_diff) OR max_diff > {tolerance}D AS failed"
    ).orderBy(F.desc("max_diff"), "feature")


def parity_counts(stream: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows on both sides, and rows only one side has."""
    key = ["node_id", "window_ts"]
    sides = stream.select(*key, F.lit(1).alias("s"), F.lit(0).alias("b")).unionByName(
        batch.select(*key, F.lit(0).alias("s"), F.lit(1).alias("b"))
    ).groupBy(*key).agg(F.max("s").alias("s"), F.max("b").alias("b"))
    return sides.agg(
        F.count_if(F.expr("s = 1 AND b = 1")).alias("matched"),
        F.count_if(F.expr("s = 1 AND b = 0")).alias("only_stream"),
        F.count_if(F.expr("s = 0 AND b = 1")).alias("only_batch"),
    )


def best_config(tuning: DataFrame) -> DataFrame:
    """Marks the configuration with the lowest validation loss per provider and target."""
    best = tuning.groupBy("source_cloud", "target").agg(
        F.min(F.struct("val_loss", "config")).getField("config").alias("best")
    )
    return tuning.join(best, ["source_cloud", "target"]).withColumn(
        "is_best", F.col("config") == F.col("best")
    ).drop("best")


def top_features(importance: DataFrame, n: int = 8) -> DataFrame:
    """The n most important features per provider and target."""
    rank = F.row_number().over(
        Window.partitionBy("source_cloud", "target").orderBy(F.desc("importance"), "feature")
    )
    return importance.withColumn("rank", rank).filter(F.col("rank") <= n)
