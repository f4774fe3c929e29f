"""Registered queries: statistics, scaling, error figures, modelling tables, parity and feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from nodetide.config import INSTANCE_PROVIDER, MODELING_COLUMNS, MODELING_DERIVED, PERCENT_PROVIDER
from nodetide.operators import feed as Feed
from nodetide.operators import features as X
from nodetide.operators import logs as L
from nodetide.operators import modeling as M
from nodetide.operators import quality as Q
from nodetide.operators import scaling as S
from nodetide.plans import oracle as O
from nodetide.plans import telemetry as T
from nodetide.plans.feature_queries import feature_stage
from nodetide.plans.oracle import STEP, r6, with_blocks
from nodetide.plans.preprocess_queries import settle_all
from nodetide.plans.registry import query
from nodetide.session import scratch_path
from nodetide.sources import readers as R
from nodetide.sources import writers as W

CFG = T.CHECK
STATS = S.STAT_COLUMNS

BLOCKS = {
    "stats": """
        SELECT cloud_provider, coalesce(avg(cpu), 0) AS mu_cpu, greatest(coalesce(stddev_samp(cpu), 0), 1e-3) AS sd_cpu,
               coalesce(avg(mem), 0) AS mu_mem, greatest(coalesce(stddev_samp(mem), 0), 1e-3) AS sd_mem,
               coalesce(avg(n_rec), 0) AS mu_n, greatest(coalesce(stddev_samp(n_rec), 0), 1.0) AS sd_n,
               greatest(coalesce(stddev_samp(cpu_d1), 0), 1e-4) AS dsd_cpu,
               greatest(coalesce(stddev_samp(mem_d1), 0), 1e-4) AS dsd_mem
        FROM features WHERE split = 'train' GROUP BY 1""",
    "targets": " UNION ALL ".join(f"""
        SELECT '{m}' AS target, cloud_provider, node_id, window_ts, split, {m} AS cur_raw, y_{m}_h1 AS tgt_raw,
               {m}_mean6 AS ma6_raw, dsd_{m} AS sigma_m, (y_{m}_h1 - {m}) / dsd_{m} AS label
        FROM features JOIN stats USING (cloud_provider) WHERE y_{m}_h1 IS NOT NULL""" for m in O.METRICS),
    "scored": "SELECT *, ma6_raw AS pred FROM targets WHERE split = 'test'",
    "arrivals": f"""
        SELECT CASE WHEN machine % 2 = 0 THEN 'alibaba_' ELSE 'google_' END || CAST(machine AS VARCHAR) AS node_id,
               CAST(floor(s / {STEP}) * {STEP} AS BIGINT) AS window_ts,
               count(*) FILTER (WHERE event_type = 'error') AS error_count,
               count(*) FILTER (WHERE event_type = 'purchase') AS task_arrival_count,
               count(*) FILTER (WHERE event_type = 'signup') AS instance_arrival_count
        FROM tele GROUP BY 1, 2""",
}


def _lag(column: str, k: int) -> str:
    return f"lag({column}, {k}) OVER w"


def _mean(c: str, n: int) -> str:
    return (f"avg({c}) OVER (PARTITION BY node_id ORDER BY window_ts "
            f"RANGE BETWEEN {(n - 1) * STEP} PRECEDING AND CURRENT ROW)")


BLOCKS["ready"] = f"""
        SELECT cloud_provider, node_id, window_ts AS timestamp_sec, cpu_usage_norm, mem_usage_norm,
               CAST(window_ts - ({_lag('window_ts', 1)}) AS DOUBLE) AS time_delta_sec,
               {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ('error_count', 'task_arrival_count', 'instance_arrival_count'))},
               {', '.join(f'{_lag(f"{m}_usage_norm", k)} AS {m}_lag_{k}' for m in O.METRICS for k in (1, 2))},
               {', '.join(f'{_mean(f"{m}_usage_norm", n)} AS {m}_avg_{a}' for m in O.METRICS for n, a in ((5, '5m'), (15, '15m')))},
               CAST({_lag('task_arrival_count', 1)} AS DOUBLE) AS task_lag_1,
               CAST({_lag('instance_arrival_count', 1)} AS DOUBLE) AS instance_lag_1,
               {_mean('task_arrival_count', 5)} AS task_avg_5m, {_mean('instance_arrival_count', 5)} AS instance_avg_5m,
               {_mean('task_arrival_count', 15)} AS task_avg_15m,
               CASE WHEN lead(window_ts) OVER w = window_ts + {STEP} THEN lead(cpu_usage_norm) OVER w END AS target_cpu_future,
               CASE WHEN lead(window_ts) OVER w = window_ts + {STEP}
                    THEN CAST(lead(task_arrival_count) OVER w AS DOUBLE) END AS target_task_future
        FROM (SELECT cloud_provider, node_id, window_ts, cpu_usage_norm, mem_usage_norm,
                     coalesce(error_count, 0) AS error_count, coalesce(task_arrival_count, 0) AS task_arrival_count,
                     coalesce(instance_arrival_count, 0) AS instance_arrival_count
              FROM unified LEFT JOIN arrivals USING (node_id, window_ts))
        WINDOW w AS (PARTITION BY node_id ORDER BY window_ts)"""
_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in MODELING_COLUMNS)
BLOCKS["filled_ready"] = f"""
        SELECT cloud_provider, node_id, timestamp_sec, {_FILLED}, target_cpu_future FROM ready
        WHERE target_cpu_future IS NOT NULL"""
BLOCKS["momentum"] = """
        SELECT *, cpu_d1 - cpu_d2 AS cpu_accel FROM (
            SELECT *, CASE WHEN cloud_provider = 'google' THEN 1.0 ELSE 0.0 END AS is_source,
                   cpu_usage_norm - cpu_lag_1 AS cpu_d1, cpu_lag_1 - cpu_lag_2 AS cpu_d2,
                   cpu_usage_norm - cpu_avg_5m AS cpu_dev5, cpu_avg_5m - cpu_avg_15m AS cpu_trend,
                   mem_usage_norm - mem_lag_1 AS mem_d1, mem_lag_1 - mem_lag_2 AS mem_d2,
                   mem_usage_norm - mem_avg_5m AS mem_dev5, mem_avg_5m - mem_avg_15m AS mem_trend,
                   task_arrival_count - task_lag_1 AS task_d1, task_avg_5m - task_avg_15m AS task_trend,
                   instance_arrival_count - instance_lag_1 AS inst_d1, cpu_usage_norm - mem_usage_norm AS cpu_mem_gap,
                   error_count / (task_arrival_count + 1.0) AS err_per_task,
                   target_cpu_future - cpu_usage_norm AS resid_label
            FROM filled_ready)"""
_Z = "CASE WHEN stddev_samp({c}) IS NULL OR stddev_samp({c}) < 1e-9 THEN 1.0 ELSE stddev_samp({c}) END"
_MARKS = f"""(SELECT cloud_provider, quantile_disc(timestamp_sec, 0.06) AS q06, quantile_disc(timestamp_sec, 0.08) AS q08,
        quantile_disc(timestamp_sec, 0.10) AS q10, quantile_disc(timestamp_sec, 0.80) AS q80 FROM filled_ready GROUP BY 1)"""
BLOCKS["parts"] = f"""
        SELECT * FROM (SELECT f.*, CASE
            WHEN cloud_provider = 'google' AND timestamp_sec <= q80 - {STEP} THEN 'train'
            WHEN cloud_provider = 'google' AND timestamp_sec > q80 THEN 'valid'
            WHEN cloud_provider = 'alibaba' AND timestamp_sec <= q06 - {STEP} THEN 'fit'
            WHEN cloud_provider = 'alibaba' AND timestamp_sec > q06 AND timestamp_sec <= q08 - {STEP} THEN 'calibration'
            WHEN cloud_provider = 'alibaba' AND timestamp_sec > q08 AND timestamp_sec <= q10 - {STEP} THEN 'valid'
            WHEN cloud_provider = 'alibaba' AND timestamp_sec > q10 + {STEP} THEN 'test' END AS part
            FROM filled_ready f JOIN {_MARKS} USING (cloud_provider)) WHERE part IS NOT NULL"""
BLOCKS["pooled"] = """
        SELECT m.* FROM momentum m JOIN (SELECT node_id, timestamp_sec FROM parts WHERE part IN ('train', 'fit')) p
             ON p.node_id = m.node_id AND p.timestamp_sec = m.timestamp_sec"""
STAT_NAMES = list(MODELING_COLUMNS) + list(MODELING_DERIVED)
BLOCKS["stats_long"] = " UNION ALL ".join(
    f"SELECT cloud_provider, '{c}' AS col, avg({c}) AS mean, {_Z.format(c=c)} AS std FROM pooled GROUP BY 1"
    for c in STAT_NAMES
)


def sql(body: str) -> str:
    return with_blocks(body, **BLOCKS)


def columns(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


# ---------------------------------------------------------------- shared stages
def stats(spark, sf):
    return S.train_stats(feature_stage(spark, sf))


def targets(spark, sf):
    """Rows of both targets with their current value, target and baselines."""
    table, st = feature_stage(spark, sf), stats(spark, sf)
    parts = [S.rows_for_target(table, st, m).withColumn("target", F.lit(m)) for m in X.METRICS]
    return parts[0].unionByName(parts[1])


def scored(spark, sf):
    """Test rows with the 6-row mean as the forecast."""
    return targets(spark, sf).filter("split = 'test'").withColumn("pred", F.col("ma6_raw"))


def arrivals(spark, sf):
    """Error, task and instance arrivals per node and window."""
    provider = F.when(F.expr("machine % 2 = 0"), PERCENT_PROVIDER).otherwise(INSTANCE_PROVIDER)
    return T.events(spark, sf).groupBy(
        F.concat_ws("_", provider, F.col("machine").cast("string")).alias("node_id"),
        (F.floor(F.col("s") / CFG.step) * CFG.step).alias("window_ts"),
    ).agg(*[
        F.count_if(F.col("event_type") == kind).alias(name)
        for kind, name in (("error", "error_count"), ("purchase", "task_arrival_count"),
                           ("signup", "instance_arrival_count"))
    ])


def ready(spark, sf):
    return T.staged(
        spark, ("modeling_ready", sf, CFG),
        lambda: M.modeling_ready(T.metrics(spark, sf), arrivals(spark, sf), CFG), "cloud_provider",
    )


def momentum(spark, sf):
    return M.momentum_features(M.null_fill(ready(spark, sf).drop("target_task_future")))


# -------------------------------------------------------------- stats and scaling
@query("train_stats", sql(f"SELECT cloud_provider, {columns(*STATS)} FROM stats"))
def train_stats(spark, sf):
    return settle_all(stats(spark, sf).select("cloud_provider", *STATS))


def _scaled_sql(mode: str) -> str:
    unit = {"delta": "dsd_", "spread": "sd_"}[mode]
    out = []
    for f in O.FEATURE_NAMES:
        m = "cpu" if "cpu" in f else "mem"
        level = f in ("cpu", "mem") or f in ("cl_cpu_mean", "cl_mem_mean") or (
            not f.startswith("cl_") and any(k in f for k in ("_lag", "_mean", "_max", "_min")))
        if f.endswith("_z72") or f.startswith(("tod_", "warn_", "err_")):
            e = f"CAST({f} AS DOUBLE)"
        elif f in ("n_rec", "n_rec_lag1", "n_rec_mean12"):
            e = f"({f} - mu_n) / sd_n"
        elif f.startswith("n_rec"):
            e = f"{f} / sd_n"
        elif level:
            e = f"({f} - mu_{m}) / sd_{m}"
        else:
            e = f"{f} / {unit}{m}"
        out.append(r6(e, f))
    return sql(f"SELECT node_id, window_ts, {', '.join(out)} FROM features JOIN stats USING (cloud_provider)")


def _scaled(spark, sf, mode):
    table = feature_stage(spark, sf)
    scaled = S.scale_features(table, stats(spark, sf), mode, keep=["node_id", "window_ts"])
    return settle_all(scaled.selectExpr("node_id", "window_ts", *[
        f"CAST({n} AS DOUBLE) AS {n}" for n in X.feature_columns(table)
    ]))


@query("scale_features", _scaled_sql("delta"))
def scale_features(spark, sf):
    return _scaled(spark, sf, "delta")


@query("scale_features_spread", _scaled_sql("spread"))
def scale_features_spread(spark, sf):
    return _scaled(spark, sf, "spread")


TARGET_COLUMNS = ("cur_raw", "tgt_raw", "ma6_raw", "sigma_m", "label")


@query("rows_for_target", sql(f"""
    SELECT target, cloud_provider, node_id, window_ts, split, {columns(*TARGET_COLUMNS)} FROM targets"""))
def rows_for_target(spark, sf):
    return settle_all(targets(spark, sf))


@query("change_label", sql(f"""
    SELECT target, node_id, window_ts, {r6('label', 'label')},
           {r6('greatest(0.0, least(1.0, cur_raw + label * sigma_m))', 'pred')} FROM targets"""))
def change_label(spark, sf):
    """The label and its inverse: turning the true change back must give the (clamped) target."""
    rows = S.with_prediction(targets(spark, sf), "label")
    return settle_all(rows.select("target", "node_id", "window_ts", "label", "pred"))


# ------------------------------------------------------------------ error figures
@query("regression_metrics", sql(f"""
    SELECT target, cloud_provider, split, count(*) AS n, {r6('sqrt(avg(pow(cur_raw - tgt_raw, 2)))', 'rmse')},
           {r6('avg(abs(cur_raw - tgt_raw))', 'mae')},
           {r6('1 - avg(pow(cur_raw - tgt_raw, 2)) / greatest(var_pop(tgt_raw), 1e-12)', 'r2')}
    FROM targets GROUP BY 1, 2, 3"""))
def regression_metrics(spark, sf):
    return settle_all(Q.regression_metrics(targets(spark, sf), "cur_raw", "tgt_raw", "target", "cloud_provider", "split"))


def skill_sql(source: str, view: str) -> str:
    return f"""
        SELECT target, cloud_provider, '{view}' AS view, count(*) AS n, {r6('sqrt(avg(pow(pred - tgt_raw, 2)))', 'rmse')},
               {r6('avg(abs(pred - tgt_raw))', 'mae')},
               {r6('1 - avg(pow(pred - tgt_raw, 2)) / greatest(var_pop(tgt_raw), 1e-12)', 'r2')},
               {r6('sqrt(avg(pow(cur_raw - tgt_raw, 2)))', 'rmse_persist')},
               {r6('sqrt(avg(pow(ma6_raw - tgt_raw, 2)))', 'rmse_ma6')},
               {r6('1 - sqrt(avg(pow(pred - tgt_raw, 2))) / greatest(sqrt(avg(pow(cur_raw - tgt_raw, 2))), 1e-12)', 'skill_persist')},
               {r6('1 - sqrt(avg(pow(pred - tgt_raw, 2))) / greatest(sqrt(avg(pow(ma6_raw - tgt_raw, 2))), 1e-12)', 'skill_ma6')}
        FROM {source} GROUP BY 1, 2"""


MEAN_SQL = """(SELECT target, cloud_provider, window_ts, avg(cur_raw) AS cur_raw, avg(tgt_raw) AS tgt_raw,
               avg(ma6_raw) AS ma6_raw, avg(pred) AS pred FROM scored GROUP BY 1, 2, 3)"""


@query("baseline_skill", sql(skill_sql("scored", "per_machine")))
def baseline_skill(spark, sf):
    rows = Q.skill_metrics(scored(spark, sf), "target", "cloud_provider")
    return settle_all(rows.withColumn("view", F.lit("per_machine")))


@query("cluster_mean_view", sql(skill_sql(MEAN_SQL, "cluster_mean")))
def cluster_mean_view(spark, sf):
    rows = Q.two_views(scored(spark, sf), "target", "cloud_provider")
    return settle_all(rows.filter("view = 'cluster_mean'"))


@query("ols_1d", sql(f"""
    SELECT target, cloud_provider, {r6('regr_slope(tgt_raw, cur_raw)', 'slope')},
           {r6('regr_intercept(tgt_raw, cur_raw)', 'intercept')} FROM targets WHERE split = 'train' GROUP BY 1, 2"""))
def ols_1d(spark, sf):
    return settle_all(targets(spark, sf).filter("split = 'train'").groupBy("target", "cloud_provider").agg(
        F.regr_slope("tgt_raw", "cur_raw").alias("slope"), F.regr_intercept("tgt_raw", "cur_raw").alias("intercept")
    ))


def predictions(spark, sf):
    """The 6-row mean as the forecast of the next window, in the stream's prediction layout."""
    return feature_stage(spark, sf).selectExpr(
        "cloud_provider", "node_id", "cpu_mean6 AS pred_cpu", "mem_mean6 AS pred_mem", "cpu AS cur_cpu", "mem AS cur_mem",
        "window_ts", f"window_ts + {CFG.step} AS target_ts",
    )


RMSES = ("rmse_cpu_model", "rmse_cpu_persist", "rmse_mem_model", "rmse_mem_persist")
BLOCKS["live"] = f"""
        SELECT u.cloud_provider, u.window_ts, count(*) AS n, sqrt(avg(pow(cpu_mean6 - u.cpu_usage_norm, 2))) AS rmse_cpu_model,
               sqrt(avg(pow(cpu - u.cpu_usage_norm, 2))) AS rmse_cpu_persist,
               sqrt(avg(pow(mem_mean6 - u.mem_usage_norm, 2))) AS rmse_mem_model,
               sqrt(avg(pow(mem - u.mem_usage_norm, 2))) AS rmse_mem_persist
        FROM features f JOIN unified u ON u.node_id = f.node_id AND u.window_ts = f.window_ts + {STEP} GROUP BY 1, 2"""


@query("live_error_join", sql(f"SELECT cloud_provider, window_ts, n, {columns(*RMSES)} FROM live"))
def live_error_join(spark, sf):
    return settle_all(Q.live_error(predictions(spark, sf), T.metrics(spark, sf)))


@query("running_error", sql(f"""
    SELECT cloud_provider, window_ts, CAST(sum(n) OVER w AS BIGINT) AS n_total,
           {', '.join(r6(f'sqrt(sum(n * {c} * {c}) OVER w / sum(n) OVER w)', f'running_{c}') for c in RMSES)}
    FROM live WINDOW w AS (PARTITION BY cloud_provider ORDER BY window_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def running_error(spark, sf):
    return settle_all(Q.running_error(Q.live_error(predictions(spark, sf), T.metrics(spark, sf))))


# ---------------------------------------------------------------- classification
def judged(spark, sf):
    """Documents with a known quality; longer ones are guessed to be good."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "quality AS actual")
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(
        "doc_id", "CAST(n_chars AS DOUBLE) AS score", "CAST(n_chars > 1000 AS INT) AS predicted"
    )
    return labels.join(docs, "doc_id")


JUDGED = {"judged": """
    SELECT quality AS actual, CAST(n_chars AS DOUBLE) AS score, CAST(n_chars > 1000 AS INTEGER) AS predicted
    FROM labels JOIN documents USING (doc_id)"""}


@query("confusion_matrix", with_blocks("SELECT actual, predicted, count(*) AS n FROM judged GROUP BY 1, 2", **JUDGED))
def confusion_matrix(spark, sf):
    return Q.confusion_matrix(judged(spark, sf), "actual", "predicted")


@query("class_report", with_blocks(f"""
    SELECT CAST(n AS BIGINT) AS n, {r6('(s0 * p0 + s1 * p1) / n', 'weighted_precision')},
           {r6('(s0 * r0 + s1 * r1) / n', 'weighted_recall')},
           {r6('(s0 * coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) + s1 * coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0)) / n', 'weighted_f1')},
           {r6('r1', 'active_recall')}
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE actual = 0) AS s0, count(*) FILTER (WHERE actual = 1) AS s1,
                 coalesce(avg(CAST(actual = 0 AS INTEGER)) FILTER (WHERE predicted = 0), 0) AS p0,
                 coalesce(avg(CAST(actual = 1 AS INTEGER)) FILTER (WHERE predicted = 1), 0) AS p1,
                 coalesce(avg(CAST(predicted = 0 AS INTEGER)) FILTER (WHERE actual = 0), 0) AS r0,
                 coalesce(avg(CAST(predicted = 1 AS INTEGER)) FILTER (WHERE actual = 1), 0) AS r1 FROM judged)""", **JUDGED))
def class_report(spark, sf):
    return settle_all(Q.class_report(Q.confusion_matrix(judged(spark, sf), "actual", "predicted")))


@query("auc_roc", with_blocks(f"""
    SELECT CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives,
           {r6('(rank_sum - p * (p + 1) / 2) / (p * q)', 'auc')}
    FROM (SELECT sum(actual) AS p, sum(1 - actual) AS q, sum(actual * avg_rank) AS rank_sum
          FROM (SELECT actual, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS avg_rank
                FROM judged))""", **JUDGED))
def auc_roc(spark, sf):
    return settle_all(Q.auc_roc(judged(spark, sf), "actual", "score"))


@query("poisson_deviance", sql(f"""
    SELECT count(*) AS n,
           {r6('avg(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)))', 'poisson_deviance')},
           {r6('sqrt(avg(pow(ln(1 + y) - ln(1 + mu), 2)))', 'rmse_log')}, {r6('avg(abs(ln(1 + y) - ln(1 + mu)))', 'mae_log')},
           {r6('1 - avg(pow(ln(1 + y) - ln(1 + mu), 2)) / greatest(var_pop(ln(1 + y)), 1e-12)', 'r2_log')},
           {r6('sqrt(avg(pow(y - mu, 2)))', 'rmse')}, {r6('avg(abs(y - mu))', 'mae')}
    FROM (SELECT target_task_future AS y, task_avg_15m + 0.1 AS mu FROM ready WHERE target_task_future IS NOT NULL)"""))
def poisson_deviance(spark, sf):
    rows = ready(spark, sf).filter("target_task_future IS NOT NULL").selectExpr(
        "target_task_future AS y", "task_avg_15m + 0.1D AS mu"
    )
    return settle_all(Q.count_errors(rows, "mu", "y"))


# -------------------------------------------------------------- modelling table
READY_COLUMNS = [*MODELING_COLUMNS, "target_cpu_future", "target_task_future"]


@query("modeling_ready", sql(f"""
    SELECT cloud_provider, node_id, timestamp_sec, {columns(*READY_COLUMNS)} FROM ready"""))
def modeling_ready(spark, sf):
    rows = M.modeling_ready(T.metrics(spark, sf), arrivals(spark, sf), CFG)
    return settle_all(rows.select("cloud_provider", "node_id", "timestamp_sec", *READY_COLUMNS))


@query("null_fill", sql(f"""
    SELECT node_id, timestamp_sec, {columns(*MODELING_COLUMNS, 'target_cpu_future')} FROM filled_ready"""))
def null_fill(spark, sf):
    rows = M.null_fill(ready(spark, sf))
    return settle_all(rows.select("node_id", "timestamp_sec", *MODELING_COLUMNS, "target_cpu_future"))


@query("momentum_features", sql(f"""
    SELECT node_id, timestamp_sec, is_source + 0.0::DOUBLE AS is_source, {columns(*MODELING_DERIVED, 'resid_label')} FROM momentum"""))
def momentum_features(spark, sf):
    return settle_all(momentum(spark, sf).select("node_id", "timestamp_sec", "is_source", *MODELING_DERIVED, "resid_label"))


def training_pool(spark, sf):
    """Rows the statistics may be taken from: the source's training part and the target's fit part."""
    return M.quantile_split(momentum(spark, sf), CFG.step).filter("part IN ('train', 'fit')")


@query("provider_stats", sql(f"SELECT cloud_provider, col, {columns('mean', 'std')} FROM stats_long"))
def provider_stats(spark, sf):
    return settle_all(S.provider_stats(training_pool(spark, sf), STAT_NAMES))


@query("scaling_stats_long", sql(f"SELECT cloud_provider, col, {columns('mean', 'std')} FROM stats_long"))
def scaling_stats_long(spark, sf):
    path = scratch_path(spark, "scaling-stats")
    S.provider_stats(training_pool(spark, sf), STAT_NAMES).write.mode("overwrite").parquet(path)
    return settle_all(spark.read.parquet(path))


_ZSQL = ", ".join(
    r6(f"({c} - (SELECT mean FROM stats_long l WHERE l.col = '{c}' AND l.cloud_provider = m.cloud_provider)) / "
       f"(SELECT std FROM stats_long l WHERE l.col = '{c}' AND l.cloud_provider = m.cloud_provider)", f"{c}_z")
    for c in STAT_NAMES
)


@query("zscore_by_provider", sql(f"SELECT node_id, timestamp_sec, {_ZSQL} FROM momentum m"))
def zscore_by_provider(spark, sf):
    scaled = S.zscore_by_provider(momentum(spark, sf), S.provider_stats(training_pool(spark, sf), STAT_NAMES), STAT_NAMES)
    return settle_all(scaled.select("node_id", "timestamp_sec", *[f"{c}_z" for c in STAT_NAMES]))


@query("embargo_quantile_split", sql("SELECT node_id, timestamp_sec, part FROM parts"))
def embargo_quantile_split(spark, sf):
    return M.quantile_split(M.null_fill(ready(spark, sf)), CFG.step).select("node_id", "timestamp_sec", "part")


@query("instance_weights", sql(f"""
    SELECT cloud_provider, count(*) AS n, {r6('max(w)', 'w')} FROM (
        SELECT p.cloud_provider, CASE WHEN p.cloud_provider = 'google' THEN 1.0
               ELSE least(100.0, 0.25 / 0.75 * (SELECT count(*) FROM parts WHERE part = 'train')
                          / (SELECT count(*) FROM parts WHERE part = 'fit')) END AS w
        FROM parts p WHERE part IN ('train', 'fit')) GROUP BY 1"""))
def instance_weights(spark, sf):
    pool = M.quantile_split(M.null_fill(ready(spark, sf)), CFG.step).filter("part IN ('train', 'fit')")
    weighted = S.with_weights(pool, INSTANCE_PROVIDER, PERCENT_PROVIDER)
    return settle_all(weighted.groupBy("cloud_provider").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")))


F_NAMES = ["cpu_usage_norm", "mem_usage_norm", "error_count", "task_arrival_count", "instance_arrival_count",
           "task_lag_1", "instance_lag_1", "task_avg_5m", "instance_avg_5m", "task_avg_15m", "cpu_avg_5m", "cpu_avg_15m",
           "mem_avg_5m", "mem_avg_15m"]


@query("select_top_features", sql(f"""
    SELECT feature, n, {r6('r2', 'r2')} FROM ({' UNION ALL '.join(
        f"SELECT '{c}' AS feature, count(*) AS n, pow(corr(coalesce({c}, 0), target_task_future), 2) AS r2 FROM ready "
        f"WHERE target_task_future IS NOT NULL" for c in F_NAMES)})
    ORDER BY r2 / (1 - r2) DESC, feature LIMIT 12"""))
def select_top_features(spark, sf):
    rows = ready(spark, sf).na.fill(0.0, F_NAMES)
    best = M.f_scores(rows, F_NAMES, "target_task_future").orderBy(F.desc("f_score"), "feature").limit(12)
    return settle_all(best.select("feature", "n", "r2"))


# -------------------------------------------------------------------- parity, feed
PARITY = ["cpu", "mem", "n_rec"]


def two_frames(spark, sf):
    """The feature table beside the observations it came from; every second hour's count is off by one."""
    batch = feature_stage(spark, sf).select("node_id", "window_ts", *PARITY)
    stream = T.metrics(spark, sf).selectExpr(
        "node_id", "window_ts", "cpu_usage_norm AS cpu", "mem_usage_norm AS mem",
        f"n_records + CAST(window_ts % {2 * CFG.step} = 0 AS INT) AS n_rec",
    )
    return stream, batch


_PAIR = f"""features f JOIN unified u USING (node_id, window_ts)"""
_DIFFS = {"cpu": "cpu - cpu_usage_norm", "mem": "mem - mem_usage_norm",
          "n_rec": f"n_rec - (n_records + CAST(window_ts % {2 * STEP} = 0 AS INTEGER))"}
BLOCKS["diffs"] = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(*) AS matched, CAST(max(abs({e})) AS DOUBLE) AS max_diff FROM {_PAIR}"
    for n, e in _DIFFS.items()
)


@query("parity_join", sql("""
    SELECT count(*) FILTER (WHERE a AND b) AS matched, count(*) FILTER (WHERE a AND b IS NULL) AS only_stream,
           count(*) FILTER (WHERE a IS NULL AND b) AS only_batch
    FROM (SELECT node_id, window_ts, true AS a FROM unified)
         FULL JOIN (SELECT node_id, window_ts, true AS b FROM features) USING (node_id, window_ts)"""))
def parity_join(spark, sf):
    stream, batch = two_frames(spark, sf)
    return Q.parity_counts(stream, batch)


@query("parity_max_diff", sql(f"""
    SELECT feature, matched, {r6('max_diff', 'max_diff')}, max_diff > 1e-9 AS failed FROM diffs"""))
def parity_max_diff(spark, sf):
    return settle_all(Q.parity(*two_frames(spark, sf), PARITY))


@query("worst_parity", sql(f"SELECT feature, {r6('max_diff', 'max_diff')} FROM diffs WHERE max_diff > 1e-9"))
def worst_parity(spark, sf):
    return settle_all(Q.parity(*two_frames(spark, sf), PARITY).filter("failed").select("feature", "max_diff"))


def feed(spark, sf, provider=INSTANCE_PROVIDER):
    metrics = R.read_table(spark, _path(spark, sf), provider)
    logs = T.severities(spark, sf).filter(F.col("node_id").startswith(f"{provider}_"))
    return Feed.metrics_with_logs(metrics, logs), metrics


def _path(spark, sf):
    T.metrics(spark, sf)
    return T._STAGED[(spark.sparkContext.applicationId, "unified", sf, CFG)]


BLOCKS["feed"] = """
        SELECT node_id, window_ts, cpu_usage_norm, mem_usage_norm, n_records, CAST(coalesce(sev, 0) AS INTEGER) AS sev
        FROM (SELECT * FROM unified WHERE cloud_provider = 'google')
             FULL JOIN (SELECT * FROM sev WHERE node_id LIKE 'google%') USING (node_id, window_ts)"""
BLOCKS["start"] = """
        SELECT min(window_ts) AS t0 FROM unified JOIN bounds USING (cloud_provider)
        WHERE cloud_provider = 'google' AND window_ts >= lo + (hi - lo) * 0.85"""
BLOCKS["feeds"] = """
        SELECT split_part(node_id, '_', 1) AS cloud_provider, node_id, window_ts, cpu_usage_norm, mem_usage_norm, n_records,
               CAST(coalesce(sev, 0) AS INTEGER) AS sev
        FROM (SELECT node_id, window_ts, cpu_usage_norm, mem_usage_norm, n_records FROM unified) FULL JOIN sev USING (node_id, window_ts)"""
BLOCKS["starts"] = """
        SELECT cloud_provider, min(window_ts) AS t0 FROM unified JOIN bounds USING (cloud_provider)
        WHERE window_ts >= lo + (hi - lo) * 0.85 GROUP BY 1"""
_FEED = f"cloud_provider, node_id, window_ts, {columns('cpu_usage_norm', 'mem_usage_norm')}, n_records, sev"


def each_feed(spark, sf, make):
    """`make` of every provider's feed and metrics, with the provider as a column."""
    parts = [make(*feed(spark, sf, p)).withColumn("cloud_provider", F.lit(p)) for p in CFG.providers]
    return reduce(lambda x, y: x.unionByName(y), parts)


def cut(rows, metrics):
    return Feed.seed_and_test(rows, Feed.test_start(metrics), CFG)


@query("metrics_logs_full_outer", sql(f"SELECT {_FEED} FROM feeds"))
def metrics_logs_full_outer(spark, sf):
    return settle_all(each_feed(spark, sf, lambda rows, metrics: rows))


@query("seed_and_test_cut", sql(f"""
    SELECT cloud_provider, node_id, window_ts, CASE WHEN window_ts >= t0 THEN 'test' ELSE 'seed' END AS part
    FROM feeds JOIN starts USING (cloud_provider) WHERE window_ts >= t0 - 74 * {STEP}"""))
def seed_and_test_cut(spark, sf):
    return each_feed(spark, sf, cut).select("cloud_provider", "node_id", "window_ts", "part")


@query("first_n_windows", sql("""
    SELECT cloud_provider, node_id, window_ts FROM feeds JOIN starts USING (cloud_provider) WHERE window_ts >= t0
    QUALIFY dense_rank() OVER (PARTITION BY cloud_provider ORDER BY window_ts) <= 20"""))
def first_n_windows(spark, sf):
    return each_feed(spark, sf, lambda rows, metrics: Feed.first_windows(cut(rows, metrics).filter("part = 'test'"), 20)).select(
        "cloud_provider", "node_id", "window_ts")


@query("window_feed_write", sql(f"SELECT {_FEED} FROM feeds JOIN starts USING (cloud_provider) WHERE window_ts >= t0"))
def window_feed_write(spark, sf):
    """Every provider's test windows, a folder each, written and read back."""
    def through(rows, metrics):
        path = scratch_path(spark, "feed")
        W.write_window_feed(cut(rows, metrics).filter("part = 'test'").drop("part"), path)
        return spark.read.schema(R.FEED_SCHEMA).option("recursiveFileLookup", "true").parquet(path)

    return settle_all(each_feed(spark, sf, through))


@query("write_results_csv", sql(skill_sql("scored", "per_machine")))
def write_results_csv(spark, sf):
    path = scratch_path(spark, "results")
    rows = settle_all(Q.skill_metrics(scored(spark, sf), "target", "cloud_provider").withColumn("view", F.lit("per_machine")))
    W.write_report_csv(rows, path)
    return spark.read.option("header", "true").schema(rows.schema).csv(path)
