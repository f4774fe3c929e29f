"""Window features, labels, cluster context and the chronological split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodetide.config import TraceConfig
from nodetide.operators.providers import few_rows, per_provider
from nodetide.operators.grid import chunked_grid

METRICS = ("cpu", "mem")
ID_COLUMNS = ("node_id", "window_ts", "split", "cloud_provider")
CONTEXT = ("cl_cpu_mean", "cl_cpu_std", "cl_cpu_d1", "cl_mem_mean", "cl_mem_std", "cl_mem_d1")


def feature_columns(df: DataFrame, use_counts: bool = True) -> list[str]:
    """Everything that is neither an id nor a label; optionally without the record counts."""
    return [
        c for c in df.columns
        if c not in ID_COLUMNS and not c.startswith("y_") and (use_counts or not c.startswith("n_rec"))
    ]


# -------------------------------------------------------------- cluster context
def cluster_context(metrics: DataFrame) -> DataFrame:
    """Mean and spread of all nodes per provider and window; a single node has spread 0."""
    return metrics.groupBy("cloud_provider", "window_ts").agg(*[
        agg
        for m in METRICS
        for agg in (
            F.avg(f"{m}_usage_norm").alias(f"cl_{m}_mean"),
            F.coalesce(F.stddev_samp(f"{m}_usage_norm"), F.lit(0.0)).alias(f"cl_{m}_std"),
        )
    ])


def context_delta(context: DataFrame, cfg: TraceConfig) -> DataFrame:
    """Change of the cluster mean since the previous window, 0 where that window is missing.

    Only the window exactly one step earlier counts, so each row of the context is laid out twice, for its own window
    and for the next one, and the two meet by key: the metrics are aggregated once, and no window function puts a
    provider's whole trace in one task.
    """
    means = [f"cl_{m}_mean" for m in METRICS]
    kept = [c for c in context.columns if c not in ("cloud_provider", "window_ts")]
    here = F.struct("window_ts", F.lit(True).alias("own"), *kept, *[F.lit(None).cast("double").alias(f"prev_{c}") for c in means])
    ahead = F.struct(
        (F.col("window_ts") + cfg.step).alias("window_ts"), F.lit(False).alias("own"),
        *[F.lit(None).cast("double").alias(c) for c in kept], *[F.col(c).alias(f"prev_{c}") for c in means])
    met = (
        context.select("cloud_provider", F.inline(F.array(here, ahead)))
        .groupBy("cloud_provider", "window_ts")
        .agg(
            F.max("own").alias("own"),
            *[F.max(c).alias(c) for c in kept],
            *[F.max(f"prev_{c}").alias(f"prev_{c}") for c in means],
        )
        .filter("own")
    )
    return met.select(
        "cloud_provider", "window_ts", *kept,
        *[
            F.coalesce(F.col(f"cl_{m}_mean") - F.col(f"prev_cl_{m}_mean"), F.lit(0.0)).alias(f"cl_{m}_d1")
            for m in METRICS
        ],
    )


def context_fits(spans: dict[str, tuple[int, int]] | None, cfg: TraceConfig) -> bool:
    """Whether the context table is small enough to broadcast: it has at most one row per provider and step."""
    if spans is None:
        return False
    rows = sum((hi - lo) // cfg.step + 1 for lo, hi in spans.values())
    return rows <= cfg.context_broadcast_rows


def join_context(rows: DataFrame, context: DataFrame, small: bool) -> DataFrame:
    return rows.join(F.broadcast(context) if small else context, ["cloud_provider", "window_ts"], "left")


# --------------------------------------------------------------- window features
# The wide column lists below are SQL text: one call to Spark per column keeps building the plan cheap.
SERIES = "PARTITION BY node_id, chunk ORDER BY window_ts"


def _rolling(n: int) -> str:
    return f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _join_blocks(df: DataFrame, short: int, size: int, spread: bool, extrema: tuple[str, ...]) -> DataFrame:
    """Frames of `size` rows from those of `short` rows; blocks cut off by the series start count fewer rows."""
    offsets = range(0, size, short)
    stats = ("mean",) + (("var",) if spread else ()) + extrema

    def block(m: str, stat: str, offset: int) -> str:
        return f"{m}_{stat}{short}" if offset == 0 else f"_{m}_{stat}{size}_{offset}"

    def weighted(terms: dict[int, str]) -> str:
        total = " + ".join(f"coalesce(_n{size}_{o} * ({t}), 0D)" for o, t in terms.items())
        return f"({total}) / ({' + '.join(f'_n{size}_{o}' for o in terms)})"

    lagged = df.selectExpr(
        "*",
        *[f"CAST(greatest(least(pos - {o}, {short}), 0) AS DOUBLE) AS _n{size}_{o}" for o in offsets],
        *[
            f"lag({m}_{s}{short}, {o}) OVER ({SERIES}) AS _{m}_{s}{size}_{o}"
            for m in METRICS for s in stats for o in offsets if o
        ],
    )
    means = lagged.selectExpr(
        "*", *[f"{weighted({o: block(m, 'mean', o) for o in offsets})} AS {m}_mean{size}" for m in METRICS]
    )
    made = []
    for m in METRICS:
        if spread:
            off = {o: f"{block(m, 'mean', o)} - {m}_mean{size}" for o in offsets}
            var = {o: f"{block(m, 'var', o)} + ({off[o]}) * ({off[o]})" for o in offsets}
            made.append(f"{weighted(var)} AS {m}_var{size}")
        for s, pick in (("max", "greatest"), ("min", "least")):
            if s in extrema:
                made.append(f"{pick}({', '.join(block(m, s, o) for o in offsets)}) AS {m}_{s}{size}")
    return means.selectExpr("*", *made)


def window_features(grid: DataFrame, cfg: TraceConfig, labels: bool = True) -> DataFrame:
    """Lags, rolling statistics, log counts and labels on the chunked grid.

    Long frames are put together from shorter ones: 12 rows from two frames of 6, 72 from six of 12, 288 from four
    of 72. Each level is a handful of lags, so the cost per row does not grow with the frame, and a value
    depends only on the rows in its frame, not on where the series was cut.
    """
    base = ["cloud_provider", "node_id", "chunk", "window_ts", "own", "observed", "rn", "cpu", "mem", "n_rec"]
    y = [f"y_{m}_h{h}" for m in METRICS for h in cfg.horizons] if labels else []
    level = grid.selectExpr(
        *base,
        f"row_number() OVER ({SERIES}) AS pos",
        *[f"lag({m}, {k}) OVER ({SERIES}) AS {m}_lag{k}" for m in METRICS for k in cfg.lags],
        *[
            f"{fn}({m}) OVER {_rolling(6)} AS {m}_{stat}6"
            for m in METRICS
            for fn, stat in (("avg", "mean"), ("var_pop", "var"), ("max", "max"), ("min", "min"))
        ],
        f"lag(n_rec, 1) OVER ({SERIES}) AS n_rec_lag1",
        f"avg(n_rec) OVER {_rolling(12)} AS n_rec_mean12",
        *[
            f"sum(CAST(sev = {code} AS INT)) OVER {_rolling(n)} AS {name}_cnt{n}"
            for n in (6, 12) for code, name in ((1, "warn"), (2, "err"))
        ],
        *([
            f"lead({m}_usage_norm, {h}) OVER ({SERIES}) AS y_{m}_h{h}"
            for m in METRICS for h in cfg.horizons
        ] if labels else []),
    )
    level = _join_blocks(level, 6, 12, True, ("max", "min"))
    level = _join_blocks(level, 12, 72, True, ("max",))
    if cfg.use_day:
        level = _join_blocks(level, 72, 288, False, ())

    return level.selectExpr(
        *base,
        *CLOCK,
        *[
            c
            for m in METRICS
            for c in (
                *[f"{m}_lag{k}" for k in cfg.lags],
                *[f"{m}_mean{n}" for n in cfg.means],
                *[f"sqrt({m}_var{n}) AS {m}_std{n}" for n in cfg.spreads],
                *[f"{m}_max{n}" for n in cfg.spreads],
                f"{m}_min12",
            )
        ],
        "n_rec_lag1", "n_rec_mean12", "warn_cnt6", "err_cnt6", "warn_cnt12", "err_cnt12", *y,
    )


def derived_columns(cfg: TraceConfig) -> list[str]:
    """Changes, deviations, slopes, range and z-score from the window features."""
    made = []
    for m in METRICS:
        made += [f"{m} - {m}_lag{k} AS {m}_d{k}" for k in (1, 3, 12)]
        made.append(f"({m} - {m}_lag1) - ({m}_lag1 - {m}_lag2) AS {m}_accel")
        made += [f"{m} - {m}_mean{n} AS {m}_dev{n}" for n in cfg.means]
        made += [
            f"{m}_mean6 - {m}_mean12 AS {m}_slope_short",
            f"{m}_mean12 - {m}_mean72 AS {m}_slope_long",
            f"{m}_max12 - {m}_min12 AS {m}_range12",
            f"greatest(-5D, least(5D, ({m} - {m}_mean72) / ({m}_std72 + 1e-6D))) AS {m}_z72",
        ]
        if cfg.use_day:
            made.append(f"{m} - {m}_lag288 AS {m}_dday")
    made.append("n_rec - n_rec_lag1 AS n_rec_d1")
    return made


def compute_features(metrics: DataFrame, logs: DataFrame | None, cfg: TraceConfig, small_context: bool,
                     labels: bool = True) -> DataFrame:
    """All features of the observed rows: the one function that batch and stream share.

    A small context table is joined to the finished rows by broadcast. A large one is joined to the narrow
    metric rows instead, before they grow to full width.
    """
    context = context_delta(cluster_context(metrics), cfg)
    grid = chunked_grid(
        metrics, logs, cfg, back=cfg.lookback, ahead=cfg.lookahead if labels else 0, every_chunk=False
    )
    rows = window_features(grid, cfg, labels).filter("own AND observed").drop("own", "observed", "chunk")
    if small_context:
        rows = join_context(rows, context, True)
    else:
        at_samples = metrics.select("cloud_provider", "node_id", "window_ts").join(
            context, ["cloud_provider", "window_ts"]
        )
        rows = rows.join(at_samples, ["cloud_provider", "node_id", "window_ts"])
    return with_derived(rows, cfg)


def with_derived(rows: DataFrame, cfg: TraceConfig) -> DataFrame:
    """Window features with the columns made from them and from the cluster context."""
    relative = [f"{m} - cl_{m}_mean AS {m}_vs_cl" for m in METRICS]
    return rows.selectExpr("*", *relative, *derived_columns(cfg))


DAY_ANGLE = "(window_ts % 86400) / 86400D * (2 * pi())"
CLOCK = (f"sin({DAY_ANGLE}) AS tod_sin", f"cos({DAY_ANGLE}) AS tod_cos")


def with_clock(rows: DataFrame) -> DataFrame:
    """Rows with their window's place in the day."""
    return rows.selectExpr("*", *CLOCK)


# ------------------------------------------------------------------------ splits
def provider_bounds(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("cloud_provider").agg(
        F.min("window_ts").alias("lo"), F.max("window_ts").alias("hi")
    )


def provider_spans(metrics: DataFrame, cfg: TraceConfig) -> dict[str, tuple[int, int]]:
    """First and last window of every provider there is; a row for each reaches the driver."""
    rows = few_rows(provider_bounds(metrics)).collect()
    return {r["cloud_provider"]: (r["lo"], r["hi"]) for r in rows}


def split_rule(ts: Column, lo: Column, hi: Column, cfg: TraceConfig) -> Column:
    """70/15/15 by time; rows within one label horizon of a boundary belong to no split."""
    t70, t85 = lo + (hi - lo) * 0.70, lo + (hi - lo) * 0.85
    return (
        F.when(ts < t70 - cfg.gap, "train")
        .when((ts >= t70) & (ts < t85 - cfg.gap), "val")
        .when(ts >= t85, "test")
    )


def chrono_split(rows: DataFrame, bounds: DataFrame, cfg: TraceConfig) -> DataFrame:
    """Attach the provider's bounds and keep rows in a split."""
    return (
        per_provider(rows, bounds)
        .withColumn("split", split_rule(F.col("window_ts"), F.col("lo"), F.col("hi"), cfg))
        .filter(F.col("split").isNotNull())
        .drop("lo", "hi")
    )


def literal_split(rows: DataFrame, spans: dict[str, tuple[int, int]], cfg: TraceConfig) -> DataFrame:
    """The same split with bounds already known: constants in the plan, no join."""
    split = F.lit(None).cast("string")
    for provider, (lo, hi) in spans.items():
        rule = split_rule(F.col("window_ts"), F.lit(lo), F.lit(hi), cfg)
        split = F.when(F.col("cloud_provider") == provider, rule).otherwise(split)
    return rows.withColumn("split", split).filter(F.col("split").isNotNull())


def observed_after_warmup(rows: DataFrame, cfg: TraceConfig) -> DataFrame:
    return rows.filter(F.col("rn") > cfg.warmup)


def feature_table(metrics: DataFrame, logs: DataFrame | None, cfg: TraceConfig,
                  spans: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The modelling table: ids, features, labels, split."""
    spans = spans or provider_spans(metrics, cfg)
    rows = compute_features(metrics, logs, cfg, context_fits(spans, cfg))
    return literal_split(observed_after_warmup(rows, cfg).drop("rn"), spans, cfg)


def null_feature_rows(features: DataFrame) -> DataFrame:
    """How many rows have a null in any feature (should be none)."""
    missing = F.lit(False)
    for c in feature_columns(features):
        missing = missing | F.col(c).isNull()
    return features.agg(F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("rows_with_null"))


def split_summary(features: DataFrame) -> DataFrame:
    """Rows, nodes, missing labels and last-value error per provider and split.

    Two steps, nodes first: the distinct node count needs no expansion and the second step is tiny.
    """
    y, e = F.col("y_cpu_h1"), lambda m: F.pow(F.col(f"y_{m}_h1") - F.col(m), 2)
    per_node = features.groupBy("cloud_provider", "split", "node_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y.isNull().cast("long")).alias("missing"),
        *[F.sum(e(m)).alias(f"se_{m}") for m in METRICS],
        *[F.count(e(m)).alias(f"n_{m}") for m in METRICS],
    )
    return per_node.groupBy("cloud_provider", "split").agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("nodes"),
        F.round(F.sum("missing") / F.sum("rows"), 3).alias("y_cpu_null"),
        *[F.round(F.sqrt(F.sum(f"se_{m}") / F.sum(f"n_{m}")), 4).alias(f"base_rmse_{m}") for m in METRICS],
    ).orderBy("cloud_provider", "split")
