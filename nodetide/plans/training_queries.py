"""Registered queries: draws, training runs, saved models, transfer and hurdle models.

Grids, trees and depths are the defaults; only the shares drawn from the large traces are whole here.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from nodetide.functions.expressions import scaled, settled
from nodetide.models import linear, store, transfer
from nodetide.models import train as Tr
from nodetide.operators import distinct as N
from nodetide.operators import modeling as M
from nodetide.operators import quality as Q
from nodetide.operators import ranks as R
from nodetide.operators import report as Rep
from nodetide.operators import scaling as S
from nodetide.operators.features import feature_columns
from nodetide.operators.providers import few_rows
from nodetide.plans import model_queries as MQ
from nodetide.plans import oracle as O
from nodetide.plans import telemetry as T
from nodetide.plans.feature_queries import feature_stage
from nodetide.plans.preprocess_queries import settle_all
from nodetide.plans.oracle import with_blocks
from nodetide.plans.registry import query
from nodetide.session import scratch_path
from nodetide.sources import writers as W

CFG = T.CHECK
LINE_NAMES = O.FEATURE_NAMES
FULL = Tr.TrainConfig(train_frac=1.0, tune_frac=1.0, val_frac=1.0, fits_at_once=12)
_RUNS: dict[tuple, object] = {}


def once(spark, key, build):
    """Results of a training run, shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _RUNS:
        _RUNS[key] = build()
    return _RUNS[key]


def run_of(spark, sf, family: str) -> Tr.Run:
    make = {
        "gbt": lambda: Tr.boosted_trees(FULL), "rf": lambda: Tr.random_forest(FULL), "linear": lambda: Tr.linear_family(FULL),
    }
    return once(spark, (family, sf), lambda: Tr.train(feature_stage(spark, sf), make[family](), FULL))


PARTS = [("train", 0.10, 42), ("val", 0.25, 43), ("test", 1.0, 44)]


def _draw_sql(seed: int, *keys: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {" || ':' || ".join(keys)}), 1, {R.DRAW_BITS // 4}))::BIGINT"


@query("sampled_splits", MQ.sql(" UNION ALL ".join(
    f"SELECT cloud_provider, '{split}' AS split, node_id, window_ts FROM features WHERE split = '{split}' AND "
    f"{_draw_sql(seed, 'node_id', 'window_ts')} < {int(share * (1 << R.DRAW_BITS))}" for split, share, seed in PARTS)))
def sampled_splits(spark, sf):
    """The rows that training, validation and test draw, row by row."""
    table = feature_stage(spark, sf)
    frames = [Tr.sampled_split(table, *p) for p in PARTS]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).select("cloud_provider", "split", "node_id", "window_ts")


@query("row_cap", MQ.sql(f"""
    SELECT cloud_provider, node_id, timestamp_sec FROM ready WHERE target_cpu_future IS NOT NULL
    QUALIFY row_number() OVER (ORDER BY {_draw_sql(42, 'node_id', 'timestamp_sec')}) <= 100"""))
def row_cap(spark, sf):
    """The hundred rows that a budget of a hundred rows draws."""
    return M.fit_budget(MQ.momentum(spark, sf), 100).select("cloud_provider", "node_id", "timestamp_sec")


QUANTILES = {"95": 0.95, "99": 0.99}
METRIC_COLUMNS = {"cpu": "cpu_usage_norm", "mem": "mem_usage_norm"}


@query("exact_quantiles", MQ.sql("SELECT * FROM thresholds"))
def exact_quantiles(spark, sf):
    """Log thresholds by counts in ranges: exact for any number of rows."""
    return R.exact_quantiles(T.metrics(spark, sf), METRIC_COLUMNS, QUANTILES)


@query("kept_quantiles", MQ.sql("""
    SELECT cloud_provider, metric, q, true AS within FROM (SELECT DISTINCT cloud_provider FROM unified), (VALUES ('cpu'), ('mem')) AS m(metric), (VALUES ('95'), ('99')) AS p(q)"""))
def kept_quantiles(spark, sf):
    """Thresholds from kept daily sketches, merged in a tree without reading the metrics again: within their bound of the rank?"""
    metrics = T.metrics(spark, sf)
    path = scratch_path(spark, "sketches")
    W.write_partitioned(R.daily_sketches(metrics, METRIC_COLUMNS), path)
    found = R.sketched_quantiles(R.merged_sketches(spark.read.parquet(path), list(METRIC_COLUMNS)), list(METRIC_COLUMNS), QUANTILES)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(q).alias("q"), F.lit(p).alias("p"), F.col(f"{m}{q}").alias("value"))
                               for m in METRIC_COLUMNS for q, p in QUANTILES.items()]))
    marks = found.select("cloud_provider", each.alias("m")).select("cloud_provider", "m.*")
    v = F.when(F.col("metric") == "cpu", F.col("cpu_usage_norm")).otherwise(F.col("mem_usage_norm"))
    ranked = per_provider_marks(metrics, marks).groupBy("cloud_provider", "metric", "q", "p").agg(
        F.count_if(v < F.col("value")).alias("below"), F.count_if(v <= F.col("value")).alias("upto"), F.count(v).alias("n"))
    error = F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"))
    return ranked.select("cloud_provider", "metric", "q", (error <= R.SKETCH_ERROR).alias("within"))


@query("nodes_by_period", MQ.sql("""
    SELECT cloud_provider, count(*) FILTER (WHERE a) AS nodes_first, count(*) FILTER (WHERE b) AS nodes_second, count(*) FILTER (WHERE a AND b) AS nodes_both, count(*) AS nodes_either
    FROM (SELECT cloud_provider, node_id, bool_or(window_ts < 10 * 86400) AS a, bool_or(window_ts >= 10 * 86400) AS b FROM unified GROUP BY 1, 2) GROUP BY 1"""))
def nodes_by_period(spark, sf):
    """Nodes of the first ten days, of the others, of both and of either, from sketches kept by day."""
    path = scratch_path(spark, "node-sketches")
    W.write_partitioned(N.daily_nodes(T.metrics(spark, sf)), path)
    return N.nodes_of_periods(spark.read.parquet(path), (0, 9), (10, 10_000))


def per_provider_marks(metrics, marks):
    """Every row beside its provider's marks, a few for each."""
    return metrics.join(F.broadcast(few_rows(marks)), "cloud_provider")


_CELLS = f"""
    SELECT cloud_provider, split, target, node_id, window_ts, unnest(['1', {', '.join(f"'{n}'" for n in LINE_NAMES)}, 'label']) AS name,
           unnest(range({len(LINE_NAMES) + 2})) AS place, unnest(list_append(inputs, CASE target WHEN 'cpu' THEN label_cpu ELSE label_mem END)) AS value
    FROM (SELECT cloud_provider, split, node_id, window_ts, [1.0, {', '.join(scaled(n, 'delta') for n in LINE_NAMES)}] AS inputs,
                 (y_cpu_h1 - cpu) / dsd_cpu AS label_cpu, (y_mem_h1 - mem) / dsd_mem AS label_mem
          FROM features JOIN stats USING (cloud_provider) WHERE split IN ('train', 'val')), (VALUES ('cpu'), ('mem')) AS each(target)
    WHERE CASE target WHEN 'cpu' THEN label_cpu ELSE label_mem END IS NOT NULL"""


@query("linear_moments", with_blocks("""
    SELECT x.cloud_provider, x.split, x.target, x.name AS a, y.name AS b, round(avg(x.value * y.value) + 1.3e-9, 6) + 0.0 AS mean_product
    FROM cells x JOIN cells y USING (cloud_provider, split, target, node_id, window_ts) WHERE x.place <= y.place GROUP BY 1, 2, 3, 4, 5""", **MQ.BLOCKS, cells=_CELLS))
def linear_moments(spark, sf):
    """Mean products of every two of intercept, features and label: all that the linear models are made of."""
    table = feature_stage(spark, sf)
    found = Tr.line_moments(table, S.train_stats(table), FULL, LINE_NAMES)
    rows = linear.mean_products(found, LINE_NAMES)
    return rows.select("cloud_provider", "split", "target", "a", "b", settled(F.col("mean_product")).alias("mean_product"))


@query("skip_invalid_vectors", MQ.sql("""
    SELECT cloud_provider, count(*) FILTER (WHERE y_cpu_h1 IS NOT NULL AND y_mem_h12 IS NOT NULL) AS kept, count(*) AS total
    FROM features GROUP BY 1"""))
def skip_invalid_vectors(spark, sf):
    """Rows whose vector would hold a null are left out; counted with two labels among the inputs."""
    table = feature_stage(spark, sf)
    names = [*feature_columns(table), "y_cpu_h1", "y_mem_h12"]
    kept = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(table)
    both = kept.select("cloud_provider", F.lit(1).alias("k"), F.lit(0).alias("t")).unionByName(
        table.select("cloud_provider", F.lit(0).alias("k"), F.lit(1).alias("t"))
    )
    return both.groupBy("cloud_provider").agg(F.sum("k").alias("kept"), F.sum("t").alias("total"))


@query("gbt_tuning")
def gbt_tuning(spark, sf):
    return run_of(spark, sf, "gbt").tuning_table(spark)


@query("gbt_experiments")
def gbt_experiments(spark, sf):
    return run_of(spark, sf, "gbt").results


@query("forest_experiments")
def forest_experiments(spark, sf):
    return run_of(spark, sf, "rf").results


HORIZONS = (1, 6, 12)


def horizon_run(spark, sf, h: int, mode: str) -> Tr.Run:
    """The linear family for a stored horizon and a scale of change; its models are saved. All read the statistics once."""
    def build():
        table, cfg = feature_stage(spark, sf), replace(FULL, horizon=h, mode=mode)
        figures = once(spark, ("figures", sf), lambda: few_rows(S.train_stats(table)).collect())
        run = Tr.train(table, Tr.linear_family(cfg), cfg, figures)
        store.save_run(run, horizon_models(spark, sf), cfg, spark)
        return run

    return once(spark, ("horizon", sf, h, mode), build)


def horizon_models(spark, sf) -> str:
    """The folder of the saved models of all horizons."""
    return once(spark, ("horizon-models", sf), lambda: scratch_path(spark, "horizon-models"))


def linear_runs(spark, sf, modes=("delta", "spread")):
    return reduce(lambda x, y: x.unionByName(y), [horizon_run(spark, sf, h, mode).results for h in HORIZONS for mode in modes])


def linear_scorers(spark, sf) -> dict:
    """The saved linear models of every provider by horizon."""
    for h in HORIZONS:
        horizon_run(spark, sf, h, "delta")
    root = horizon_models(spark, sf)
    return {p: {h: store.load_scorer(spark, root, p, h, "linear_delta") for h in HORIZONS} for p in FULL.providers}


@query("linear_horizons")
def linear_horizons(spark, sf):
    return linear_runs(spark, sf)


@query("experiment_baselines", with_blocks(f"""
    SELECT experiment, target, h_min, view, n, round(sqrt(persist) + 1.3e-9, 6) + 0.0 AS rmse_persist, round(sqrt(ma6) + 1.3e-9, 6) + 0.0 AS rmse_ma6 FROM (
        SELECT target, cloud_provider, h_min, 'per_machine' AS view, count(*) AS n, avg(pow(cur - y, 2)) AS persist, avg(pow(m6 - y, 2)) AS ma6 FROM judged GROUP BY 1, 2, 3
        UNION ALL
        SELECT target, cloud_provider, h_min, 'cluster_mean', count(*), avg(pow(cur - y, 2)), avg(pow(m6 - y, 2)) FROM (
            SELECT target, cloud_provider, h_min, window_ts, avg(cur) AS cur, avg(y) AS y, avg(m6) AS m6 FROM judged GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
        (SELECT 'alibaba' AS source UNION ALL SELECT 'google'), LATERAL (SELECT source || '->' || cloud_provider AS experiment)""", **MQ.BLOCKS, judged=" UNION ALL ".join(
        f"SELECT '{m}' AS target, cloud_provider, {h * FULL.step_minutes} AS h_min, window_ts, {m} AS cur, y_{m}_h{h} AS y, {m}_mean6 AS m6 FROM features "
        f"WHERE split = 'test' AND y_{m}_h{h} IS NOT NULL" for m in O.METRICS for h in (1, 6, 12))))
def experiment_baselines(spark, sf):
    """What the experiments of every horizon say of the last value and the mean of six: rows and errors, the same for any model."""
    return settle_all(linear_runs(spark, sf, ("delta",)).select("experiment", "target", "h_min", "view", "n", "rmse_persist", "rmse_ma6"))


@query("linear_tuning")
def linear_tuning(spark, sf):
    return run_of(spark, sf, "linear").tuning_table(spark)


@query("linear_experiments")
def linear_experiments(spark, sf):
    return run_of(spark, sf, "linear").results


@query("feature_importance")
def feature_importance(spark, sf):
    parts = [run_of(spark, sf, f).importance_table(spark) for f in ("gbt", "linear")]
    return parts[0].unionByName(parts[1])


@query("top_features")
def top_features(spark, sf):
    return Q.top_features(run_of(spark, sf, "gbt").importance_table(spark))


@query("model_cards")
def model_cards(spark, sf):
    run = run_of(spark, sf, "gbt")
    return Rep.model_cards(run.results, run.importance_table(spark), run.train_rows_table(spark))


def saved(spark, sf, name: str) -> str:
    """Folder with the saved models of this session, of the family that is read: the other one is not trained for it."""
    family = name.split("_")[0]

    def build():
        root = scratch_path(spark, f"{family}-models")
        store.save_run(run_of(spark, sf, family), root, FULL, spark)
        return root

    return once(spark, ("saved", sf, family), build)


@query("model_metadata")
def model_metadata(spark, sf):
    root = saved(spark, sf, "gbt_delta")
    paths = [
        store.model_path(root, c, t, FULL.horizon, "gbt_delta") + "_meta" for c in FULL.providers for t in FULL.targets
    ]
    return spark.read.schema(store.META_SCHEMA).parquet(*paths)


def scored_rows(spark, sf, name: str, where: str):
    """Saved cpu and mem models of every provider over its rows, with the provider as a column."""
    table, parts = feature_stage(spark, sf).filter(where), []
    for p in FULL.providers:
        scorer = store.load_scorer(spark, saved(spark, sf, name), p, FULL.horizon, name)
        parts.append(store.score(table.filter(F.col("cloud_provider") == p), scorer, CFG.step).withColumn("cloud_provider", F.lit(p)))
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("batch_scoring")
def batch_scoring(spark, sf):
    """Saved tree models over all test rows of their providers."""
    return scored_rows(spark, sf, "gbt_delta", "split = 'test'")


@query("join_predictions")
def join_predictions(spark, sf):
    """Both predictions of a node side by side, for the linear models."""
    return scored_rows(spark, sf, "linear_delta", "true").select("cloud_provider", "node_id", "window_ts", "pred_cpu", "pred_mem")


@query("scored_rows", MQ.sql("SELECT cloud_provider, node_id, window_ts, window_ts + 3600 AS target_ts, round(cpu + 1.3e-9, 6) + 0.0 AS cur_cpu, "
                             "round(mem + 1.3e-9, 6) + 0.0 AS cur_mem FROM features WHERE split = 'test'"))
def scored_rows_query(spark, sf):
    """Which rows the saved models score, and for when."""
    return settle_all(batch_scoring(spark, sf).select("cloud_provider", "node_id", "window_ts", "target_ts", "cur_cpu", "cur_mem"))


@query("transfer_two_stage")
def transfer_two_stage(spark, sf):
    cfg = transfer.TransferConfig(horizon=CFG.step)
    return once(spark, ("transfer", sf), lambda: transfer.two_stage(MQ.momentum(spark, sf), cfg))


def hurdle_tables(spark, sf):
    cfg = transfer.HurdleConfig(horizon=CFG.step)
    return once(spark, ("hurdle", sf), lambda: transfer.hurdle(M.momentum_features(M.null_fill(MQ.ready(spark, sf))), cfg))


@query("hurdle_report")
def hurdle_report(spark, sf):
    tables = hurdle_tables(spark, sf)
    one = F.lit(1).alias("one")  # both have one row
    return tables["report"].select("*", one).join(F.broadcast(tables["auc"].select("*", one)), "one").drop("one")


@query("hurdle_confusion")
def hurdle_confusion(spark, sf):
    return hurdle_tables(spark, sf)["matrix"]


@query("hurdle_magnitude")
def hurdle_magnitude(spark, sf):
    return hurdle_tables(spark, sf)["size"]


_HURDLE = "ready WHERE target_cpu_future IS NOT NULL AND target_task_future IS NOT NULL"


@query("hurdle_parts", with_blocks(f"""
    SELECT cloud_provider, part, count(*) AS rows, count(*) FILTER (WHERE target_task_future > 0) AS active FROM (
        SELECT r.*, CASE WHEN cloud_provider = 'google' AND timestamp_sec <= q80 - {CFG.step} THEN 'pool' WHEN cloud_provider = 'google' AND timestamp_sec > q80 THEN 'valid'
                         WHEN cloud_provider = 'alibaba' AND timestamp_sec <= q10 - {CFG.step} THEN 'pool' WHEN cloud_provider = 'alibaba' AND timestamp_sec > q10 THEN 'test' END AS part
        FROM (SELECT * FROM {_HURDLE}) r JOIN hurdle_marks USING (cloud_provider)) WHERE part IS NOT NULL GROUP BY 1, 2""", **MQ.BLOCKS, hurdle_marks=f"""
    SELECT cloud_provider, quantile_disc(timestamp_sec, 0.1) AS q10, quantile_disc(timestamp_sec, 0.8) AS q80 FROM {_HURDLE} GROUP BY 1"""))
def hurdle_parts(spark, sf):
    """Rows and active rows of each part."""
    return hurdle_tables(spark, sf)["parts"]


@query("hurdle_features")
def hurdle_features(spark, sf):
    return hurdle_tables(spark, sf)["features"]
