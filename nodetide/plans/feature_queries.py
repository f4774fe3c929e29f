"""Registered queries: grid, windows, features, context and split."""

from __future__ import annotations

from pyspark.sql import functions as F

from nodetide.operators import features as X
from nodetide.operators import grid as G
from nodetide.operators import logs as L
from nodetide.operators.providers import per_provider
from nodetide.plans import oracle as O
from nodetide.plans import telemetry as T
from nodetide.plans.oracle import r6, with_blocks
from nodetide.plans.preprocess_queries import settle_all
from nodetide.plans.registry import query

CFG = T.CHECK
KEY = ["cloud_provider", "node_id", "window_ts"]


def sql_columns(names) -> str:
    return ", ".join(
        f"CAST({n} AS BIGINT) AS {n}" if n in O.COUNT_NAMES else r6(n, n) for n in names
    )


def window_rows(spark, sf):
    """All grid rows with their window features and labels."""
    grid = G.chunked_grid(T.metrics(spark, sf), T.severities(spark, sf), CFG, back=CFG.lookback, ahead=CFG.lookahead)
    return X.window_features(grid, CFG).filter("own")


def select_windows(spark, sf, names):
    return settle_all(window_rows(spark, sf).select("node_id", "window_ts", *names))


def base_sql(names) -> str:
    return with_blocks(f"SELECT node_id, window_ts, {sql_columns(names)} FROM base")


# ------------------------------------------------------------------- grid, joins
@query("node_bounds", with_blocks("""
    SELECT cloud_provider, node_id, min(window_ts) AS t_lo, max(window_ts) AS t_hi FROM unified GROUP BY 1, 2"""))
def node_bounds(spark, sf):
    return G.node_bounds(T.metrics(spark, sf))


@query("dense_grid", with_blocks("SELECT * FROM grid"))
def dense_grid(spark, sf):
    return G.dense_grid(T.metrics(spark, sf), CFG)


@query("grid_left_join", with_blocks(f"""
    SELECT node_id, window_ts, {r6('cpu_usage_norm', 'cpu_usage_norm')}, {r6('mem_usage_norm', 'mem_usage_norm')},
           n_records, observed FROM filled"""))
def grid_left_join(spark, sf):
    return settle_all(G.filled_grid(T.metrics(spark, sf), None, CFG).select(
        "node_id", "window_ts", "cpu_usage_norm", "mem_usage_norm", "n_records", "observed"
    ))


@query("log_left_join", with_blocks("SELECT node_id, window_ts, sev FROM filled"))
def log_left_join(spark, sf):
    return G.filled_grid(T.metrics(spark, sf), T.severities(spark, sf), CFG).select("node_id", "window_ts", "sev")


@query("locf", with_blocks(f"""
    SELECT node_id, window_ts, {r6('cpu', 'cpu')}, {r6('mem', 'mem')}, n_rec FROM filled"""))
def locf(spark, sf):
    return settle_all(G.filled_grid(T.metrics(spark, sf), None, CFG).select(
        "node_id", "window_ts", "cpu", "mem", "n_rec"
    ))


@query("grid_row_number", with_blocks("SELECT node_id, window_ts, CAST(rn AS BIGINT) AS rn FROM filled"))
def grid_row_number(spark, sf):
    return G.filled_grid(T.metrics(spark, sf), None, CFG).select("node_id", "window_ts", "rn")


@query("filled_grid", with_blocks(f"""
    SELECT cloud_provider, node_id, window_ts, observed, {r6('cpu', 'cpu')}, {r6('mem', 'mem')}, n_rec, sev,
           CAST(rn AS BIGINT) AS rn FROM filled"""))
def filled_grid(spark, sf):
    return settle_all(G.filled_grid(T.metrics(spark, sf), T.severities(spark, sf), CFG).select(
        "cloud_provider", "node_id", "window_ts", "observed", "cpu", "mem", "n_rec", "sev", "rn"
    ))


# ----------------------------------------------------------------------- context
@query("cluster_context", with_blocks(f"""
    SELECT cloud_provider, window_ts, {', '.join(r6(c, c) for c in O.CONTEXT_NAMES[:6] if not c.endswith('d1'))}
    FROM context"""))
def cluster_context(spark, sf):
    return settle_all(X.cluster_context(T.metrics(spark, sf)))


@query("context_delta", with_blocks(f"""
    SELECT cloud_provider, window_ts, {r6('cl_cpu_d1', 'cl_cpu_d1')}, {r6('cl_mem_d1', 'cl_mem_d1')} FROM context"""))
def context_delta(spark, sf):
    context = X.context_delta(X.cluster_context(T.metrics(spark, sf)), CFG)
    return settle_all(context.select("cloud_provider", "window_ts", "cl_cpu_d1", "cl_mem_d1"))


@query("context_broadcast_join", with_blocks(f"""
    SELECT cloud_provider, node_id, window_ts, {', '.join(r6(c, c) for c in O.CONTEXT_NAMES[:6])}
    FROM unified JOIN context USING (cloud_provider, window_ts)"""))
def context_broadcast_join(spark, sf):
    metrics = T.metrics(spark, sf)
    small = X.context_fits(X.provider_spans(metrics, CFG), CFG)
    context = X.context_delta(X.cluster_context(metrics), CFG)
    return settle_all(X.join_context(metrics.select(*KEY), context, small))


# ----------------------------------------------------------------------- windows
@query("lags", base_sql([n for n in O.BASE_NAMES if "_lag" in n]))
def lags(spark, sf):
    return select_windows(spark, sf, [n for n in O.BASE_NAMES if "_lag" in n])


@query("rolling_mean", base_sql([n for n in O.BASE_NAMES if "_mean" in n]))
def rolling_mean(spark, sf):
    return select_windows(spark, sf, [n for n in O.BASE_NAMES if "_mean" in n])


@query("rolling_std", base_sql([n for n in O.BASE_NAMES if "_std" in n]))
def rolling_std(spark, sf):
    return select_windows(spark, sf, [n for n in O.BASE_NAMES if "_std" in n])


@query("rolling_extrema", base_sql([n for n in O.BASE_NAMES if "_max" in n or "_min" in n]))
def rolling_extrema(spark, sf):
    return select_windows(spark, sf, [n for n in O.BASE_NAMES if "_max" in n or "_min" in n])


@query("log_counts", base_sql([n for n in O.BASE_NAMES if "_cnt" in n]))
def log_counts(spark, sf):
    return select_windows(spark, sf, [n for n in O.BASE_NAMES if "_cnt" in n])


@query("future_labels", base_sql(O.LABEL_NAMES))
def future_labels(spark, sf):
    return select_windows(spark, sf, O.LABEL_NAMES)


@query("time_of_day", base_sql(["tod_sin", "tod_cos"]))
def time_of_day(spark, sf):
    return select_windows(spark, sf, ["tod_sin", "tod_cos"])


# ---------------------------------------------------------------------- features
def feature_rows(spark, sf):
    metrics = T.metrics(spark, sf)
    small = X.context_fits(X.provider_spans(metrics, CFG), CFG)
    return X.compute_features(metrics, T.severities(spark, sf), CFG, small)


def features(spark, sf, cfg=CFG):
    return X.feature_table(T.metrics(spark, sf, cfg), T.severities(spark, sf, cfg), cfg)


def feature_stage(spark, sf, cfg=CFG):
    """The feature table as a stage table, partitioned by provider."""
    return T.staged(spark, ("features", sf, cfg), lambda: features(spark, sf, cfg), "cloud_provider")


@query("base_features", with_blocks(f"""
    SELECT node_id, window_ts, CAST(rn AS BIGINT) AS rn, {sql_columns(['cpu', 'mem', 'n_rec'] + O.BASE_NAMES)}
    FROM base WHERE observed"""))
def base_features(spark, sf):
    rows = window_rows(spark, sf).filter("observed")
    return settle_all(rows.select("node_id", "window_ts", "rn", "cpu", "mem", "n_rec", *O.BASE_NAMES))


@query("derived_features", with_blocks(f"""
    SELECT node_id, window_ts, {sql_columns(O.DERIVED_NAMES)} FROM observed_rows"""))
def derived_features(spark, sf):
    rows = X.observed_after_warmup(feature_rows(spark, sf), CFG)
    return settle_all(rows.select("node_id", "window_ts", *O.DERIVED_NAMES))


@query("clip_zscore", with_blocks(f"""
    SELECT node_id, window_ts, {sql_columns(['cpu_z72', 'mem_z72'])} FROM observed_rows"""))
def clip_zscore(spark, sf):
    rows = X.observed_after_warmup(feature_rows(spark, sf), CFG)
    return settle_all(rows.select("node_id", "window_ts", "cpu_z72", "mem_z72"))


@query("observed_after_warmup", with_blocks("SELECT node_id, window_ts, CAST(rn AS BIGINT) AS rn FROM observed_rows"))
def observed_after_warmup(spark, sf):
    grid = G.filled_grid(T.metrics(spark, sf), None, CFG)
    return X.observed_after_warmup(grid.filter("observed"), CFG).select("node_id", "window_ts", "rn")


@query("bounds_join", with_blocks("""
    SELECT node_id, window_ts, lo, hi FROM unified JOIN bounds USING (cloud_provider)"""))
def bounds_join(spark, sf):
    metrics = T.metrics(spark, sf)
    return per_provider(metrics, X.provider_bounds(metrics)).select("node_id", "window_ts", "lo", "hi")


SPLIT_SQL = with_blocks(f"""
    SELECT * FROM (SELECT node_id, window_ts, {O.SPLIT_CASE} AS split FROM unified JOIN bounds USING (cloud_provider))
    WHERE split IS NOT NULL""")


@query("split_condition_lookup", SPLIT_SQL)
def split_condition_lookup(spark, sf):
    metrics = T.metrics(spark, sf)
    return X.chrono_split(metrics, X.provider_bounds(metrics), CFG).select("node_id", "window_ts", "split")


@query("chrono_split", SPLIT_SQL)
def chrono_split(spark, sf):
    metrics = T.metrics(spark, sf)
    return X.literal_split(metrics, X.provider_spans(metrics, CFG), CFG).select("node_id", "window_ts", "split")


@query("feature_table", with_blocks(f"""
    SELECT cloud_provider, node_id, window_ts, split, {sql_columns(O.FEATURE_NAMES + O.LABEL_NAMES)} FROM features"""))
def feature_table(spark, sf):
    return settle_all(features(spark, sf))


DAY = CFG.with_(use_day=True, chunk_steps=480)


@query("feature_table_day", with_blocks(f"""
    SELECT cloud_provider, node_id, window_ts, split, {sql_columns(O.FEATURE_NAMES + O.DAY_NAMES + O.LABEL_NAMES)} FROM day_features"""))
def feature_table_day(spark, sf):
    """All 80 features, those of a whole day included."""
    return settle_all(X.feature_table(T.metrics(spark, sf), T.severities(spark, sf), DAY))


@query("feature_columns", with_blocks(f"""
    SELECT node_id, window_ts, {sql_columns([n for n in O.FEATURE_NAMES if not n.startswith('n_rec')])} FROM features"""))
def feature_columns(spark, sf):
    table = feature_stage(spark, sf)
    return settle_all(table.select("node_id", "window_ts", *X.feature_columns(table, use_counts=False)))


@query("feature_null_count", with_blocks(f"""
    SELECT count(*) AS rows, count(*) FILTER (WHERE {' OR '.join(f'{n} IS NULL' for n in O.FEATURE_NAMES)}) AS rows_with_null
    FROM features"""))
def feature_null_count(spark, sf):
    return X.null_feature_rows(feature_stage(spark, sf))


@query("split_summary", with_blocks("""
    SELECT cloud_provider, split, count(*) AS rows, count(DISTINCT node_id) AS nodes,
           round(avg(CASE WHEN y_cpu_h1 IS NULL THEN 1 ELSE 0 END), 3) AS y_cpu_null,
           round(sqrt(avg(pow(y_cpu_h1 - cpu, 2))), 4) AS base_rmse_cpu,
           round(sqrt(avg(pow(y_mem_h1 - mem, 2))), 4) AS base_rmse_mem
    FROM features GROUP BY 1, 2 ORDER BY 1, 2"""))
def split_summary(spark, sf):
    return X.split_summary(feature_stage(spark, sf))
