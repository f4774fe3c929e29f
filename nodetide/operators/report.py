"""Report tables: forecast series, overview, comparison, transfer, cards. All small, all computed from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodetide.functions.expressions import bucket

POINTS, HORIZON, HOUR = 96, 6, 3600
SERIES = ("cloud_provider", "metric")


def forecast_series(actuals: DataFrame, step: int = 1800, predicted: DataFrame | None = None) -> DataFrame:
    """96 points per provider and metric; the last 6 lie ahead and have no actual value.

    actuals and predicted: cloud_provider, metric, t (seconds), value. Both are averaged into points before anything
    else, so what follows has 96 rows per series. Without forecasts, each point repeats the last known value.
    """
    def points(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*SERIES, bucket(F.col("t"), step).alias("t")).agg(F.avg("value").alias(name))

    known = points(actuals, "actual")
    grid = known.groupBy(*SERIES).agg(F.max("t").alias("last")).select(
        *SERIES, F.posexplode(F.sequence(
            F.col("last") - (POINTS - HORIZON - 1) * step, F.col("last") + HORIZON * step, F.lit(step).cast("long")
        )).alias("point", "t"),
    )
    series = grid.join(known, [*SERIES, "t"], "left")
    if predicted is not None:
        return series.join(points(predicted, "predicted"), [*SERIES, "t"], "left")
    before = Window.partitionBy(*SERIES).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumn("predicted", F.last("actual", ignorenulls=True).over(before))


def hour_ahead(step: int) -> int:
    """The point one hour after the end of the last known one, which is the first of those ahead."""
    return POINTS - HORIZON + HOUR // step


def overview(series: DataFrame, step: int = 1800, metrics: tuple[str, ...] = ("cpu", "memory", "taskArrival")) -> DataFrame:
    """Forecast one hour ahead, one row per provider; `step` is that of the series."""
    return series.filter(F.col("point") == hour_ahead(step)).groupBy("cloud_provider").pivot(
        "metric", list(metrics)
    ).agg(F.max("predicted"))


def series_error(series: DataFrame) -> DataFrame:
    """Error per series where the actual value is known."""
    return series.filter("actual IS NOT NULL AND predicted IS NOT NULL").groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("sqrt(avg(pow(predicted - actual, 2)))").alias("rmse"),
        F.expr("avg(abs(predicted - actual))").alias("mae"),
    )


def latest_points(series: DataFrame, n: int = 24) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("t")))
    return series.withColumn("age", newest).filter(F.col("age") <= n).drop("age")


def first_recommendations(records: DataFrame, n: int = 3) -> DataFrame:
    return records.orderBy(F.desc("timestamp"), "node_id").limit(n)


def _ends() -> tuple[Column, Column]:
    return F.split("experiment", "->")[0], F.split("experiment", "->")[1]


def model_comparison(results: DataFrame, models: list[str]) -> DataFrame:
    """Same-provider RMSE by metric and provider, one column per model."""
    source, target = _ends()
    return results.filter((source == target) & (F.col("view") == "per_machine")).groupBy(
        "target", target.alias("cloud_provider")
    ).pivot("model", models).agg(F.max("rmse"))


def transfer_change(results: DataFrame) -> DataFrame:
    """RMSE on a provider by a model from the other one, in percent of the provider's own model's RMSE."""
    source, target = _ends()
    rows = results.filter("view = 'per_machine'").select(
        "model", "target", "rmse", source.alias("source_cloud"), target.alias("target_cloud")
    )
    own = rows.filter("source_cloud = target_cloud").select(
        "model", "target", "target_cloud", F.col("rmse").alias("own_rmse")
    )
    return rows.filter("source_cloud <> target_cloud").join(own, ["model", "target", "target_cloud"]).select(
        "model", "target", F.concat_ws("->", "source_cloud", "target_cloud").alias("direction"),
        ((F.col("rmse") / F.col("own_rmse") - 1) * 100).alias("change_pct"),
    )


def best_run(results: DataFrame) -> DataFrame:
    """Best run per metric, and the mean RMSE on the own and on the other provider."""
    source, target = _ends()
    return results.filter("view = 'per_machine'").groupBy("target").agg(
        F.min(F.struct("rmse", "model", "experiment")).alias("best"),
        F.avg(F.when(source == target, F.col("rmse"))).alias("same_cloud_rmse"),
        F.avg(F.when(source != target, F.col("rmse"))).alias("other_cloud_rmse"),
    ).select(
        "target", "best.model", "best.experiment", F.col("best.rmse").alias("rmse"), "same_cloud_rmse", "other_cloud_rmse"
    )


def model_cards(results: DataFrame, importance: DataFrame, train_rows: DataFrame, n: int = 8) -> DataFrame:
    """Per target: mean same-provider error, training rows and the n most important features (bounded arrays)."""
    source, target = _ends()
    quality = results.filter((source == target) & (F.col("view") == "per_machine")).groupBy("target").agg(
        *[F.avg(c).alias(c) for c in ("rmse", "mae", "r2")]
    )
    mean = importance.groupBy("target", "feature").agg(F.avg("importance").alias("importance"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("importance"), "feature"))
    top = mean.withColumn("rank", rank).filter(F.col("rank") <= n).groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("rank", "feature", "importance"))).alias("features")
    )
    rows = train_rows.groupBy("target").agg(F.sum("n").alias("train_rows"))
    return quality.join(rows, "target").join(top, "target")
