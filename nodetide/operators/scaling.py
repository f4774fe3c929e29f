"""Training statistics per provider and the scaling built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.functions.expressions import change_unit, scaled
from nodetide.operators.features import METRICS, feature_columns
from nodetide.operators.providers import per_provider

STAT_COLUMNS = ("mu_cpu", "sd_cpu", "mu_mem", "sd_mem", "mu_n", "sd_n", "dsd_cpu", "dsd_mem")


def train_stats(features: DataFrame) -> DataFrame:
    """Mean and spread of level and change per provider, from training rows only, with floors."""
    def floor(name: str, agg: str, low: str) -> str:
        return f"greatest(coalesce({agg}, 0D), {low}D) AS {name}"

    made = []
    for m in METRICS:
        made += [
            f"coalesce(avg({m}), 0D) AS mu_{m}",
            floor(f"sd_{m}", f"stddev_samp({m})", "1e-3"),
            floor(f"dsd_{m}", f"stddev_samp({m}_d1)", "1e-4"),
        ]
    made += ["coalesce(avg(n_rec), 0D) AS mu_n", floor("sd_n", "stddev_samp(n_rec)", "1.0")]
    return features.filter("split = 'train'").groupBy("cloud_provider").agg(*[F.expr(e) for e in made])


#: Statistics of a provider without training rows: no centre, the floors of the spreads.
WITHOUT_ROWS = {c: 0.0 if c.startswith("mu_") else 1.0 if c == "sd_n" else 1e-4 if c.startswith("dsd_") else 1e-3 for c in STAT_COLUMNS}


def with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the provider's statistics; rows of a provider without any keep the floors."""
    joined = per_provider(rows, stats.select("cloud_provider", *STAT_COLUMNS), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in WITHOUT_ROWS.items()})


def scale_features(features: DataFrame, stats: DataFrame, mode: str = "delta",
                   names: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """All features on the common scale, beside the kept columns."""
    if mode not in ("delta", "spread"):
        raise ValueError("mode must be delta or spread")
    names = names or feature_columns(features)
    keep = ["cloud_provider", "node_id", "window_ts", "split"] if keep is None else keep
    return with_stats(features, stats).selectExpr(*keep, *[f"{scaled(n, mode)} AS {n}" for n in names])


def target_columns(metric: str, horizon: int, mode: str = "delta") -> list[str]:
    """Current value, target, 6-row mean, unit and label (change in units) of one metric, as SQL text."""
    y, unit = f"y_{metric}_h{horizon}", change_unit(metric, mode)
    return [
        f"{metric} AS cur_raw", f"{y} AS tgt_raw", f"{metric}_mean6 AS ma6_raw", f"{unit} AS sigma_m",
        f"({y} - {metric}) / {unit} AS label",
    ]


def rows_for_target(features: DataFrame, stats: DataFrame, metric: str, horizon: int = 1,
                    mode: str = "delta") -> DataFrame:
    """Rows whose future window was observed, with what a model of that metric needs."""
    labelled = features.filter(F.col(f"y_{metric}_h{horizon}").isNotNull())
    return with_stats(labelled, stats).selectExpr(
        "cloud_provider", "node_id", "window_ts", "split", *target_columns(metric, horizon, mode)
    )


PREDICTION = "greatest(0D, least(1D, cur_raw + {output} * sigma_m))"


def with_prediction(rows: DataFrame, output: str = "prediction") -> DataFrame:
    """Model output (a change in units) back to a value within 0..1."""
    return rows.withColumn("pred", F.expr(PREDICTION.format(output=output)))


def provider_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """Mean and sample deviation of every column per provider, long form; an empty spread counts as 1."""
    aggs = [F.expr(e) for n in names for e in (f"avg({n}) AS {n}__m", f"stddev_samp({n}) AS {n}__s")]
    wide = rows.groupBy("cloud_provider").agg(*aggs)
    pairs = ", ".join(f"'{n}', {n}__m, {n}__s" for n in names)
    return wide.selectExpr("cloud_provider", f"stack({len(names)}, {pairs}) AS (col, mean, std0)").selectExpr(
        "cloud_provider", "col", "mean",
        "CASE WHEN std0 IS NULL OR isnan(std0) OR std0 < 1e-9D THEN 1D ELSE std0 END AS std",
    )


def zscore_by_provider(rows: DataFrame, stats_long: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / std with the row's provider's figures; providers without figures give 0."""
    known = stats_long.filter(F.col("col").isin(*names))
    wide = known.groupBy("cloud_provider").agg(*[
        F.expr(f"max({v}) FILTER (WHERE col = '{n}') AS {n}__{v}") for n in names for v in ("mean", "std")
    ])
    return per_provider(rows, wide, "left").selectExpr(
        *rows.columns, *[f"coalesce(({n} - {n}__mean) / {n}__std, 0D) AS {n}_z" for n in names]
    )


def instance_weight(source_rows: float, target_rows: float, share: float = 0.25, cap: float = 100.0) -> float:
    """Weight of a target row so that the target makes up `share` of the pool."""
    return min(cap, share / (1.0 - share) * source_rows / target_rows)


def with_weights(pool: DataFrame, source: str, target: str, share: float = 0.25) -> DataFrame:
    """Weight column on a pooled training set; only the two row counts reach the driver."""
    counts = pool.agg(
        F.count_if(F.col("cloud_provider") == source).alias("source"),
        F.count_if(F.col("cloud_provider") == target).alias("target"),
    ).first()
    weight = instance_weight(float(counts["source"]), float(max(counts["target"], 1)), share)
    return pool.withColumn("w", F.when(F.col("cloud_provider") == target, F.lit(weight)).otherwise(F.lit(1.0)))
