"""The older per-row modelling table: lags, time-range means, arrivals, quantile splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nodetide.config import INSTANCE_PROVIDER, MODELING_COLUMNS, PERCENT_PROVIDER, TraceConfig
from nodetide.operators.grid import _with_neighbours, chunk_id
from nodetide.operators.providers import per_provider
from nodetide.operators.ranks import counted_quantiles, draw_rows

SHORT_STEPS, LONG_STEPS = 5, 15
LABEL = "target_cpu_future"


def _earlier_rows(rows: DataFrame, cfg: TraceConfig, reach: int) -> DataFrame:
    """For every chunk with rows, the last two rows of its node that are older than `reach` seconds before it.

    Per chunk at most four rows are kept; the chunks of a node are then chained, a row each.
    """
    width, ts = cfg.chunk_steps * cfg.step, F.col("window_ts")
    whole = F.struct("window_ts", *[c for c in rows.columns if c not in ("window_ts", "cloud_provider", "node_id")])
    own = rows.withColumn("chunk", chunk_id(ts, cfg))

    def last_two(where=None):
        kept = whole if where is None else F.when(where, whole)
        return F.slice(F.sort_array(F.collect_list(kept), asc=False), 1, 2)

    ends = own.groupBy("cloud_provider", "node_id", "chunk").agg(
        last_two().alias("last"), last_two(ts < (F.col("chunk") + 1) * width - reach).alias("cut"))
    chain = Window.partitionBy("node_id").orderBy("chunk")
    before = [F.coalesce(F.lag("last", k).over(chain), F.slice("last", 1, 0)) for k in (1, 2, 3)]
    nearest = F.when(F.lag("chunk").over(chain) == F.col("chunk") - 1, F.lag("cut").over(chain)).otherwise(before[0])
    found = ends.select("cloud_provider", "node_id", "chunk", F.slice(F.concat(nearest, before[1], before[2]), 1, 2).alias("found"))
    return found.select("cloud_provider", "node_id", "chunk", F.inline("found"))


def modeling_ready(metrics: DataFrame, arrivals: DataFrame, cfg: TraceConfig) -> DataFrame:
    """Observed rows with lags, means over the last 5 and 15 steps, event counts and the next window's cpu.

    arrivals: node_id, window_ts, error_count, task_arrival_count, instance_arrival_count. Lags are the previous rows
    however old: a chunk gets the rows its means reach back to and the last two before those.
    """
    joined = metrics.select("cloud_provider", "node_id", "window_ts", "cpu_usage_norm", "mem_usage_norm").join(
        arrivals, ["node_id", "window_ts"], "left"
    ).na.fill(0, ["error_count", "task_arrival_count", "instance_arrival_count"])
    rows = _with_neighbours(joined, cfg, LONG_STEPS, 1).unionByName(_earlier_rows(joined, cfg, LONG_STEPS * cfg.step))
    series = "PARTITION BY node_id, chunk ORDER BY window_ts"

    def lag(column: str, k: int) -> str:
        return f"lag({column}, {k}) OVER ({series})"

    def mean(column: str, steps: int) -> str:
        return f"avg({column}) OVER ({series} RANGE BETWEEN {(steps - 1) * cfg.step} PRECEDING AND CURRENT ROW)"

    made = rows.selectExpr(
        "cloud_provider", "node_id", "chunk", "window_ts AS timestamp_sec", "cpu_usage_norm", "mem_usage_norm",
        f"CAST(window_ts - ({lag('window_ts', 1)}) AS DOUBLE) AS time_delta_sec",
        *[f"CAST({c} AS DOUBLE) AS {c}" for c in ("error_count", "task_arrival_count", "instance_arrival_count")],
        *[f"{lag(f'{m}_usage_norm', k)} AS {m}_lag_{k}" for m in ("cpu", "mem") for k in (1, 2)],
        *[
            f"{mean(f'{m}_usage_norm', n)} AS {m}_avg_{name}"
            for m in ("cpu", "mem") for n, name in ((SHORT_STEPS, "5m"), (LONG_STEPS, "15m"))
        ],
        f"CAST({lag('task_arrival_count', 1)} AS DOUBLE) AS task_lag_1",
        f"CAST({lag('instance_arrival_count', 1)} AS DOUBLE) AS instance_lag_1",
        f"{mean('task_arrival_count', SHORT_STEPS)} AS task_avg_5m",
        f"{mean('instance_arrival_count', SHORT_STEPS)} AS instance_avg_5m",
        f"{mean('task_arrival_count', LONG_STEPS)} AS task_avg_15m",
        f"CASE WHEN lead(window_ts) OVER ({series}) = window_ts + {cfg.step} "
        f"THEN lead(cpu_usage_norm) OVER ({series}) END AS {LABEL}",
        f"CASE WHEN lead(window_ts) OVER ({series}) = window_ts + {cfg.step} "
        f"THEN CAST(lead(task_arrival_count) OVER ({series}) AS DOUBLE) END AS target_task_future",
    )
    return made.filter(chunk_id(F.col("timestamp_sec"), cfg) == F.col("chunk")).drop("chunk")


def null_fill(rows: DataFrame, label: str = LABEL) -> DataFrame:
    """Missing inputs become 0, rows without a target go."""
    return rows.na.fill(0.0, list(MODELING_COLUMNS)).filter(F.col(label).isNotNull())


#: Derived columns that are a difference, by name: (minuend, subtrahend). The names are part of the table's format.
DIFFERENCES = {
    **{f"{m}_{name}": (left.format(m=m), right.format(m=m)) for m in ("cpu", "mem") for name, left, right in (
        ("d1", "{m}_usage_norm", "{m}_lag_1"), ("d2", "{m}_lag_1", "{m}_lag_2"),
        ("dev5", "{m}_usage_norm", "{m}_avg_5m"), ("trend", "{m}_avg_5m", "{m}_avg_15m"))},
    **{f"{short}_d1": (f"{kind}_arrival_count", f"{kind}_lag_1") for kind, short in (("task", "task"), ("instance", "inst"))},
    "task_trend": ("task_avg_5m", "task_avg_15m"), "cpu_mem_gap": ("cpu_usage_norm", "mem_usage_norm"), "resid_label": (LABEL, "cpu_usage_norm"),
}


def momentum_features(rows: DataFrame, source: str = INSTANCE_PROVIDER) -> DataFrame:
    """Changes, deviations and trends, the label as a change from the current value, and which rows are the source's."""
    derived = {name: f"{left} - {right}" for name, (left, right) in DIFFERENCES.items()}
    derived["err_per_task"] = "error_count / (1 + CAST(task_arrival_count AS DOUBLE))"
    derived["cpu_accel"] = f"({derived['cpu_d1']}) - ({derived['cpu_d2']})"
    derived["is_source"] = f"CAST(cloud_provider = '{source}' AS DOUBLE)"
    return rows.selectExpr("*", *[f"{text} AS {name}" for name, text in derived.items()])


def quantile_split(rows: DataFrame, horizon: int, source: str = INSTANCE_PROVIDER,
                   target: str = PERCENT_PROVIDER) -> DataFrame:
    """Splits at time quantiles, each ending one horizon before the next begins; rows in between belong to none.

    Rows of further providers are kept as part `other`, which no model reads.
    """
    t = "timestamp_sec"
    marks = counted_quantiles(rows.withColumnRenamed(t, "q"), "q", {"06": 0.06, "08": 0.08, "10": 0.10, "80": 0.80})
    rule = f"""CASE
        WHEN cloud_provider NOT IN ('{source}', '{target}') THEN 'other'
        WHEN cloud_provider = '{source}' AND {t} <= q80 - {horizon} THEN 'train'
        WHEN cloud_provider = '{source}' AND {t} > q80 THEN 'valid'
        WHEN cloud_provider = '{target}' AND {t} <= q06 - {horizon} THEN 'fit'
        WHEN cloud_provider = '{target}' AND {t} > q06 AND {t} <= q08 - {horizon} THEN 'calibration'
        WHEN cloud_provider = '{target}' AND {t} > q08 AND {t} <= q10 - {horizon} THEN 'valid'
        WHEN cloud_provider = '{target}' AND {t} > q10 + {horizon} THEN 'test' END"""
    return per_provider(rows, marks).withColumn("part", F.expr(rule)).filter("part IS NOT NULL").drop(
        "q06", "q08", "q10", "q80"
    )


def fit_budget(rows: DataFrame, limit: int, seed: int = 42, keys: tuple[str, ...] = ("node_id", "timestamp_sec")) -> DataFrame:
    """The rows a model is fitted on: exactly `limit` of them, drawn by a digest of their keys, if there are more.

    Not for anything that is judged.
    """
    return draw_rows(rows, limit, seed, list(keys))


def f_scores(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """Univariate F statistic of each column against the label, strongest first, in one pass."""
    r = rows.filter(F.col(label).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"corr({c}, {label}) AS {c}") for c in names]
    )
    pairs = ", ".join(f"'{c}', {c}" for c in names)
    return r.selectExpr("n", f"stack({len(names)}, {pairs}) AS (feature, r)").selectExpr(
        "feature", "n", "r * r AS r2", "r * r / greatest(1 - r * r, 1e-12D) * (n - 2) AS f_score"
    ).filter("NOT isnan(f_score)")
