"""Registered queries: report tables and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from nodetide.functions.expressions import clamp01
from nodetide.models import forecast as Fc
from nodetide.operators import features as X
from nodetide.operators import quality as Q
from nodetide.operators import report as Rep
from nodetide.operators.providers import few_rows
from nodetide.plans import decision_queries as DQ
from nodetide.plans import model_queries as MQ
from nodetide.plans import telemetry as T
from nodetide.plans import training_queries as TQ
from nodetide.plans.oracle import STEP, r6, with_blocks
from nodetide.plans.preprocess_queries import settle_all
from nodetide.plans.registry import query
from nodetide.session import scratch_path, written
from nodetide.sources import writers as W

CFG = T.CHECK

BLOCKS = {
    **MQ.BLOCKS,
    "rates": DQ.BLOCKS["rates"],
    "actuals": """
        SELECT cloud_provider, 'cpu' AS metric, window_ts AS t, cl_cpu_mean AS value FROM context
        UNION ALL SELECT cloud_provider, 'memory', window_ts, cl_mem_mean FROM context
        UNION ALL SELECT cloud_provider, 'taskArrival', window_ts, arrival_rate FROM rates""",
    "series": f"""
        SELECT *, last_value(actual IGNORE NULLS) OVER (PARTITION BY cloud_provider, metric ORDER BY t
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted
        FROM (SELECT g.cloud_provider, g.metric, g.point, g.t, a.value AS actual
              FROM (SELECT cloud_provider, metric, CAST(p AS INTEGER) AS point, top + (p - 89) * {STEP} AS t
                    FROM (SELECT cloud_provider, metric, max(t) AS top FROM actuals GROUP BY 1, 2), range(96) r(p)) g
              LEFT JOIN actuals a ON a.cloud_provider = g.cloud_provider AND a.metric = g.metric AND a.t = g.t)""",
    "lines_fit": """
        SELECT target, cloud_provider AS source, regr_slope(tgt_raw, cur_raw) AS slope,
               regr_intercept(tgt_raw, cur_raw) AS icept FROM targets WHERE split = 'train' GROUP BY 1, 2""",
    "trials": """
        SELECT 'line' AS model, source || '->' || cloud_provider AS experiment, target, cloud_provider, window_ts, tgt_raw,
               greatest(0.0, least(1.0, icept + slope * cur_raw)) AS pred
        FROM targets JOIN lines_fit USING (target) WHERE split = 'test'
        UNION ALL
        SELECT 'ma6', source || '->' || cloud_provider, target, cloud_provider, window_ts, tgt_raw, ma6_raw
        FROM targets JOIN lines_fit USING (target) WHERE split = 'test'""",
    "results": """
        SELECT model, experiment, target, 'per_machine' AS view, sqrt(avg(pow(pred - tgt_raw, 2))) AS rmse
        FROM trials GROUP BY 1, 2, 3""",
    "tuning": " UNION ALL ".join(
        f"SELECT cloud_provider AS source_cloud, '{m}' AS target, 'mean{n}' AS config, "
        f"avg(pow(({m}_mean{n} - y_{m}_h1) / dsd_{m}, 2)) AS val_loss "
        f"FROM features JOIN stats USING (cloud_provider) WHERE split = 'val' AND y_{m}_h1 IS NOT NULL GROUP BY 1"
        for m in ("cpu", "mem") for n in (6, 12, 72)),
}


def sql(body: str) -> str:
    return with_blocks(body, **BLOCKS)


def actuals(spark, sf):
    context = X.cluster_context(T.metrics(spark, sf))
    levels = context.select(
        "cloud_provider", F.col("window_ts").alias("t"),
        F.expr("stack(2, 'cpu', cl_cpu_mean, 'memory', cl_mem_mean) AS (metric, value)"),
    )
    rates = T.arrival_rates(spark, sf).select(
        "cloud_provider", F.col("window_ts").alias("t"), F.lit("taskArrival").alias("metric"),
        F.col("arrival_rate").alias("value"),
    )
    return levels.unionByName(rates)


def series(spark, sf):
    return Rep.forecast_series(actuals(spark, sf), CFG.step)


def results(spark, sf):
    """Two simple models in all four experiments: a straight line fitted on the source, and the 6-row mean."""
    rows = MQ.targets(spark, sf)
    fits = rows.filter("split = 'train'").groupBy("target", F.col("cloud_provider").alias("source")).agg(
        F.regr_slope("tgt_raw", "cur_raw").alias("slope"), F.regr_intercept("tgt_raw", "cur_raw").alias("icept")
    )
    test = rows.filter("split = 'test'").join(F.broadcast(few_rows(fits)), "target")
    both = test.select(
        F.concat_ws("->", "source", "cloud_provider").alias("experiment"), "target", "window_ts", "cur_raw", "tgt_raw", "ma6_raw",
        F.explode(F.create_map(
            F.lit("line"), clamp01(F.expr("icept + slope * cur_raw")), F.lit("ma6"), F.col("ma6_raw")
        )).alias("model", "pred"),
    )
    return Q.two_views(both, "model", "experiment", "target")


@query("forecast_series", sql(f"""
    SELECT cloud_provider, metric, point, CAST(t AS BIGINT) AS t, {r6('actual', 'actual')}, {r6('predicted', 'predicted')} FROM series"""))
def forecast_series(spark, sf):
    return settle_all(series(spark, sf))


OVERVIEW_SQL = sql(f"""
    SELECT cloud_provider, {', '.join(r6(f"max(CASE WHEN metric = '{m}' THEN predicted END)", m) for m in ('cpu', 'memory', 'taskArrival'))}
    FROM series WHERE point = 91 GROUP BY 1""")


@query("overview_next_hour", OVERVIEW_SQL)
def overview_next_hour(spark, sf):
    return settle_all(Rep.overview(series(spark, sf), CFG.step))


@query("dashboard_json", OVERVIEW_SQL)
def dashboard_json(spark, sf):
    """The overview as one JSON document, written, and read back as rows."""
    table = settle_all(Rep.overview(series(spark, sf), CFG.step))
    doc = W.json_document(
        table, window=F.lit("1h"), is_sample=F.lit(False), clusters=F.collect_list(F.struct(*table.columns))
    )
    path = scratch_path(spark, "overview-json")
    W.write_json_document(doc, path)
    schema = "clusters array<struct<cloud_provider:string,cpu:double,memory:double,taskArrival:double>>"
    return spark.read.schema(schema).json(path).select(F.inline("clusters"))


@query("series_error", sql(f"""
    SELECT cloud_provider, metric, count(*) AS n, {r6('sqrt(avg(pow(predicted - actual, 2)))', 'rmse')},
           {r6('avg(abs(predicted - actual))', 'mae')}
    FROM series WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2"""))
def series_error(spark, sf):
    return settle_all(Rep.series_error(series(spark, sf)))


@query("latest_points", sql(f"""
    SELECT cloud_provider, metric, CAST(t AS BIGINT) AS t, {r6('actual', 'actual')}, {r6('predicted', 'predicted')}
    FROM series WHERE point >= 72"""))
def latest_points(spark, sf):
    return settle_all(Rep.latest_points(series(spark, sf)).drop("point"))


@query("latest_recommendations", with_blocks("""
    SELECT cloud_provider, node_id, timestamp, action FROM records ORDER BY timestamp DESC, node_id LIMIT 3""", **DQ.BLOCKS))
def latest_recommendations(spark, sf):
    return Rep.first_recommendations(DQ.records(spark, sf).select("cloud_provider", "node_id", "timestamp", "action"))


@query("model_comparison", sql(f"""
    SELECT target, split_part(experiment, '->', 2) AS cloud_provider,
           {r6("max(CASE WHEN model = 'line' THEN rmse END)", 'line')}, {r6("max(CASE WHEN model = 'ma6' THEN rmse END)", 'ma6')}
    FROM results WHERE split_part(experiment, '->', 1) = split_part(experiment, '->', 2) GROUP BY 1, 2"""))
def model_comparison(spark, sf):
    return settle_all(Rep.model_comparison(results(spark, sf), ["line", "ma6"]))


@query("transfer_change", sql(f"""
    SELECT x.model, x.target, x.experiment AS direction, {r6('(x.rmse / o.rmse - 1) * 100', 'change_pct')}
    FROM results x JOIN results o ON o.model = x.model AND o.target = x.target
         AND o.experiment = split_part(x.experiment, '->', 2) || '->' || split_part(x.experiment, '->', 2)
    WHERE split_part(x.experiment, '->', 1) <> split_part(x.experiment, '->', 2)"""))
def transfer_change(spark, sf):
    return settle_all(Rep.transfer_change(results(spark, sf)))


@query("best_run", sql(f"""
    SELECT target, arg_min(model, (rmse, model, experiment)) AS model, arg_min(experiment, (rmse, model, experiment)) AS experiment,
           {r6('min(rmse)', 'rmse')},
           {r6("avg(CASE WHEN split_part(experiment, '->', 1) = split_part(experiment, '->', 2) THEN rmse END)", 'same_cloud_rmse')},
           {r6("avg(CASE WHEN split_part(experiment, '->', 1) <> split_part(experiment, '->', 2) THEN rmse END)", 'other_cloud_rmse')}
    FROM results GROUP BY 1"""))
def best_run(spark, sf):
    return settle_all(Rep.best_run(results(spark, sf)))


def tuning(spark, sf):
    """Validation loss of three rolling means as competing configurations."""
    from nodetide.operators.scaling import train_stats, with_stats

    table = MQ.feature_stage(spark, sf)
    val = with_stats(table.filter("split = 'val'"), train_stats(table))
    parts = [
        val.filter(f"y_{m}_h1 IS NOT NULL").groupBy(F.col("cloud_provider").alias("source_cloud")).agg(*[
            F.expr(f"avg(pow(({m}_mean{n} - y_{m}_h1) / dsd_{m}, 2))").alias(f"mean{n}") for n in (6, 12, 72)
        ]).select(
            "source_cloud", F.lit(m).alias("target"),
            F.expr("stack(3, 'mean6', mean6, 'mean12', mean12, 'mean72', mean72) AS (config, val_loss)"),
        )
        for m in X.METRICS
    ]
    return parts[0].unionByName(parts[1])


@query("best_config", sql(f"""
    SELECT source_cloud, target, config, {r6('val_loss', 'val_loss')},
           val_loss = min(val_loss) OVER (PARTITION BY source_cloud, target) AS is_best FROM tuning"""))
def best_config(spark, sf):
    return settle_all(Q.best_config(tuning(spark, sf)))


# ------------------------------------------------------------- from the trained models
def model_series(spark, sf):
    """The dashboard series with forecasts of the saved linear models: one step ahead in the past, rolled out beyond it.

    Arrivals have no saved model of that kind and keep the last known value.
    """
    def build():
        past = TQ.scored_rows(spark, sf, "linear_delta", "true").withColumnRenamed("target_ts", "t")
        future = Fc.ahead(T.metrics(spark, sf), T.severities(spark, sf), TQ.linear_scorers(spark, sf), Rep.HORIZON, CFG)
        ends = F.broadcast(few_rows(X.provider_bounds(T.metrics(spark, sf)).select("cloud_provider", "hi")))
        known = past.join(ends, "cloud_provider").filter("t <= hi")
        predicted = Fc.cluster_series(known, "pred_cpu", "pred_mem", "t").unionByName(Fc.cluster_series(future), allowMissingColumns=True)
        points = actuals(spark, sf)
        modelled = Rep.forecast_series(points.filter("metric <> 'taskArrival'"), CFG.step, predicted)
        return modelled.unionByName(Rep.forecast_series(points.filter("metric = 'taskArrival'"), CFG.step).select(*modelled.columns))

    return TQ.once(spark, ("model_series", sf), lambda: written(build(), "model-series"))


@query("model_forecast_series")
def model_forecast_series(spark, sf):
    return model_series(spark, sf)


@query("model_forecast_points", sql(f"""
    SELECT cloud_provider, metric, point, CAST(t AS BIGINT) AS t, {r6('actual', 'actual')}, true AS forecast FROM series WHERE point >= 90"""))
def model_forecast_points(spark, sf):
    """The points ahead, and that each has a forecast within 0 and 1 (arrivals: any)."""
    inside = F.col("predicted").isNotNull() & ((F.col("metric") == "taskArrival") | F.col("predicted").between(0, 1))
    return settle_all(model_series(spark, sf).filter("point >= 90").select("cloud_provider", "metric", "point", "t", "actual", inside.alias("forecast")))


@query("model_series_error")
def model_series_error(spark, sf):
    return Rep.series_error(model_series(spark, sf))


@query("model_overview")
def model_overview(spark, sf):
    return Rep.overview(model_series(spark, sf), CFG.step)


def trained_results(spark, sf):
    runs = [TQ.run_of(spark, sf, f).results for f in ("gbt", "linear")]
    return runs[0].unionByName(runs[1])


@query("trained_comparison")
def trained_comparison(spark, sf):
    return Rep.model_comparison(trained_results(spark, sf), ["gbt_delta", "linear_delta"])


@query("trained_transfer_change")
def trained_transfer_change(spark, sf):
    return Rep.transfer_change(trained_results(spark, sf))


@query("trained_best_run")
def trained_best_run(spark, sf):
    return Rep.best_run(trained_results(spark, sf))


@query("dashboard_documents", """
    SELECT * FROM (VALUES ('comparison', 4::BIGINT), ('forecasts', 6::BIGINT), ('models', 2::BIGINT), ('overview', 2::BIGINT), ('transfer', 8::BIGINT)) AS d(document, entries)""")
def dashboard_documents(spark, sf):
    """All documents of the dashboard from the trained models, written as JSON and read back: entries of each."""
    points = model_series(spark, sf).groupBy("cloud_provider", "metric").agg(F.sort_array(F.collect_list(F.struct("point", "t", "actual", "predicted"))).alias("points"))
    tables = {
        "forecasts": points, "overview": Rep.overview(model_series(spark, sf), CFG.step),
        "comparison": Rep.model_comparison(trained_results(spark, sf), ["gbt_delta", "linear_delta"]),
        "transfer": Rep.transfer_change(trained_results(spark, sf)), "models": TQ.model_cards(spark, sf),
    }
    found = []
    for name, table in tables.items():
        path = scratch_path(spark, name)
        doc = W.json_document(table, is_sample=F.lit(False), entries=F.collect_list(F.struct(*table.columns)))
        W.write_json_document(doc, path)
        found.append(spark.read.json(path).select(F.lit(name).alias("document"), F.size("entries").cast("long").alias("entries")))
    return reduce(lambda x, y: x.unionByName(y), found)


@query("write_tuning_csv", """
    SELECT model, target, source_cloud, configs, best FROM (VALUES ('gbt_delta', 6::BIGINT), ('linear_delta', 13::BIGINT)) AS m(model, configs),
           (VALUES ('cpu'), ('mem')) AS t(target), (VALUES ('alibaba'), ('google')) AS c(source_cloud), (VALUES (1::BIGINT)) AS b(best)""")
def write_tuning_csv(spark, sf):
    """Tuning tables of the runs as CSV, read back: configurations tried and chosen for each model."""
    tables = [TQ.run_of(spark, sf, f).tuning_table(spark) for f in ("gbt", "linear")]
    rows, path = tables[0].unionByName(tables[1]), scratch_path(spark, "tuning")
    W.write_report_csv(rows, path)
    back = spark.read.option("header", "true").schema(rows.schema).csv(path)
    return back.groupBy("model", "target", "source_cloud").agg(F.count("val_loss").alias("configs"), F.count_if("is_best").alias("best"))


@query("write_importance_csv", f"""
    SELECT model, target, source_cloud, feature FROM (VALUES ('gbt_delta'), ('linear_delta')) AS m(model), (VALUES ('cpu'), ('mem')) AS t(target),
           (VALUES ('alibaba'), ('google')) AS c(source_cloud), (SELECT unnest([{', '.join(f"'{n}'" for n in TQ.LINE_NAMES)}]) AS feature)""")
def write_importance_csv(spark, sf):
    """Importance tables of the runs as CSV, read back: a row for every feature of every model."""
    rows, path = TQ.feature_importance(spark, sf), scratch_path(spark, "importance")
    W.write_report_csv(rows, path)
    back = spark.read.option("header", "true").schema(rows.schema).csv(path)
    return back.filter("importance >= 0").select("model", "target", "source_cloud", "feature")
