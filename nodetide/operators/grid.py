"""Dense per-node time grid, gap fill, and the cutting of long series into chunks.

A node's series is cut into chunks of `cfg.chunk_steps` grid steps, and every chunk is given the rows its windows
reach into: `back` steps before it, `ahead` steps after it, and one edge row with the last values seen before that.
Each (node, chunk) is then computed on its own, so no task ever holds more than one chunk of a node however long or
dominant the node's series is, and one shuffle serves the grid, the fill and all per-node windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodetide.config import TraceConfig

VALUES = {"cpu_usage_norm": "cpu", "mem_usage_norm": "mem", "n_records": "n_rec"}


def chunk_id(ts: Column, cfg: TraceConfig) -> Column:
    return F.floor(ts / (cfg.chunk_steps * cfg.step))


def node_bounds(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("cloud_provider", "node_id").agg(
        F.min("window_ts").alias("t_lo"), F.max("window_ts").alias("t_hi")
    )


def dense_grid(metrics: DataFrame, cfg: TraceConfig) -> DataFrame:
    """One row per node and step between the node's own first and last window."""
    return node_bounds(metrics).select(
        "cloud_provider",
        "node_id",
        F.explode(F.sequence("t_lo", "t_hi", F.lit(cfg.step).cast("long"))).alias("window_ts"),
    )


def _ascending(start: Column, stop: Column, step: int = 1) -> Column:
    """sequence(start, stop), or null when it would be empty."""
    return F.when(start <= stop, F.sequence(start, stop, F.lit(step).cast("long")))


def _with_neighbours(rows: DataFrame, cfg: TraceConfig, back: int, ahead: int) -> DataFrame:
    """Each row once per chunk that needs it."""
    ts = F.col("window_ts")
    first = chunk_id(ts - ahead * cfg.step, cfg)
    last = chunk_id(ts + back * cfg.step, cfg)
    return rows.withColumn("chunk", F.explode(F.sequence(first, last)))


def _edges(metrics: DataFrame, cfg: TraceConfig, back: int, every_chunk: bool) -> DataFrame:
    """One row per (node, chunk): node bounds, and the values to carry into the chunk.

    Built from per-chunk aggregates, so the per-node window below sees one row per chunk, not per window.
    """
    width, reach = cfg.chunk_steps * cfg.step, back * cfg.step
    ts = F.col("window_ts")
    before_cut = ts < (F.col("chunk") + 1) * width - reach
    ends = [
        F.max_by(v, F.when(F.col(v).isNotNull(), ts)).alias(f"end_{v}") for v in VALUES
    ] + [
        F.max_by(v, F.when(F.col(v).isNotNull() & before_cut, ts)).alias(f"cut_{v}") for v in VALUES
    ]
    per_chunk = (
        metrics.withColumn("chunk", chunk_id(ts, cfg))
        .groupBy("cloud_provider", "node_id", "chunk")
        .agg(
            F.min("window_ts").alias("first_ts"),
            F.max("window_ts").alias("last_ts"),
            F.max(F.when(before_cut, ts)).alias("cut_ts"),
            *ends,
        )
    )
    order = Window.partitionBy("node_id").orderBy("chunk")
    all_chunks = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    chained = per_chunk.select(
        "cloud_provider", "node_id", "chunk", "cut_ts",
        *[f"cut_{v}" for v in VALUES],
        F.min("first_ts").over(all_chunks).alias("lo"),
        F.max("last_ts").over(all_chunks).alias("hi"),
        F.lag("chunk").over(order).alias("prev_chunk"),
        F.lead("chunk").over(order).alias("next_chunk"),
        *[F.last(f"end_{v}", ignorenulls=True).over(past).alias(f"past_{v}") for v in VALUES],
        *[F.last(f"end_{v}", ignorenulls=True).over(so_far).alias(f"now_{v}") for v in VALUES],
    )
    own_first = F.when(F.col("prev_chunk").isNull(), F.array("chunk"))
    if every_chunk:
        later = _ascending(F.col("chunk") + 1, F.col("next_chunk"))
    else:
        later = F.when(F.col("next_chunk").isNotNull(), F.array("next_chunk"))
    empty = F.array().cast("array<bigint>")
    targets = F.concat(F.coalesce(own_first, empty), F.coalesce(later, empty))
    spread = chained.withColumn("target", F.explode(targets))

    adjacent = F.col("target") == F.col("chunk") + 1
    own = F.col("target") == F.col("chunk")
    carried = F.when(own, F.lit(False)).when(
        adjacent, F.col("cut_ts").isNotNull() | F.col("prev_chunk").isNotNull()
    ).otherwise(True)

    def carry(v: str) -> Column:
        near = F.coalesce(F.col(f"cut_{v}"), F.col(f"past_{v}"))
        return F.when(own, None).when(adjacent, near).otherwise(F.col(f"now_{v}")).alias(v)

    return spread.select(
        "cloud_provider", "node_id",
        F.col("target").alias("chunk"),
        (F.col("target") * width - reach - cfg.step).alias("window_ts"),
        *[carry(v) for v in VALUES],
        F.lit(0).alias("sev"),
        "lo", "hi",
        carried.alias("edge"),
    )


def chunked_grid(metrics: DataFrame, logs: DataFrame | None, cfg: TraceConfig, back: int = 0, ahead: int = 0,
                 every_chunk: bool = True) -> DataFrame:
    """Gap-filled grid rows, partitioned by (node, chunk) and carrying the neighbouring rows of each chunk.

    metrics: cloud_provider, node_id, window_ts (a multiple of the step, unique per node), cpu_usage_norm,
    mem_usage_norm, n_records. logs: node_id, window_ts, sev, at most one row per key, or None.
    `own` marks the rows that belong to the chunk; the others are there for its windows. With `every_chunk`
    false, chunks without any metric row are left out.
    """
    if back > cfg.chunk_steps:
        raise ValueError("chunk_steps must not be smaller than the look-back")
    width, reach = cfg.chunk_steps * cfg.step, back * cfg.step
    step = F.lit(cfg.step).cast("long")

    samples = _with_neighbours(
        metrics.select("cloud_provider", "node_id", "window_ts", *VALUES), cfg, back, ahead
    )
    edges = _edges(metrics, cfg, back, every_chunk)
    rows = samples.withColumn("sev", F.lit(None).cast("int")).unionByName(edges, allowMissingColumns=True)
    if logs is not None:
        marks = _with_neighbours(
            logs.select("node_id", "window_ts", F.col("sev").cast("int").alias("sev"))
            .filter(F.pmod("window_ts", step) == 0),
            cfg, back, ahead,
        )
        # Explicit repartition on the chunk key: the merge and all windows below reuse this one exchange.
        rows = (
            rows.unionByName(marks, allowMissingColumns=True)
            .repartition("node_id", "chunk")
            .groupBy("node_id", "chunk", "window_ts")
            .agg(*[F.max(c).alias(c) for c in ("cloud_provider", *VALUES, "sev", "lo", "hi", "edge")])
        )

    series = Window.partitionBy("node_id", "chunk").orderBy("window_ts")
    so_far = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def latest(name: str) -> Column:
        return F.last(name, ignorenulls=True).over(so_far)

    sparse = rows.select(
        "node_id", "chunk", "window_ts", "edge",
        F.coalesce("sev", F.lit(0)).alias("sev"),
        "cpu_usage_norm", "mem_usage_norm", "n_records",
        latest("cloud_provider").alias("cloud_provider"),
        *[latest(v).alias(short) for v, short in VALUES.items()],
        latest("lo").alias("lo"),
        latest("hi").alias("hi"),
        F.lead("window_ts").over(series).alias("next_ts"),
    ).filter("lo IS NOT NULL")

    is_edge = F.col("edge").isNotNull()
    limit = (F.col("chunk") + 1) * width - step + ahead * cfg.step
    start = F.when(~is_edge, F.when(F.col("window_ts") >= F.col("lo"), F.col("window_ts"))).when(
        F.col("edge"), F.col("chunk") * width - reach
    )
    stop = F.least(F.coalesce(F.col("next_ts") - step, limit), F.col("hi"), limit)
    filled = sparse.withColumn("grid_ts", F.explode(_ascending(start, stop, cfg.step)))

    here = ~is_edge & (F.col("grid_ts") == F.col("window_ts"))

    def only_here(name: str) -> Column:
        return F.when(here, F.col(name)).alias(name)

    return filled.select(
        "cloud_provider", "node_id", "chunk",
        F.col("grid_ts").alias("window_ts"),
        ((F.col("grid_ts") >= F.col("chunk") * width) & (F.col("grid_ts") < (F.col("chunk") + 1) * width)).alias("own"),
        (here & F.col("cpu_usage_norm").isNotNull()).alias("observed"),
        *[only_here(v) for v in VALUES],
        "cpu", "mem", "n_rec",
        F.when(here, F.col("sev")).otherwise(0).alias("sev"),
        (((F.col("grid_ts") - F.col("lo")) / step).cast("long") + 1).alias("rn"),
    )


def filled_grid(metrics: DataFrame, logs: DataFrame | None, cfg: TraceConfig) -> DataFrame:
    """Every grid row once, with the last seen values, the severity and the observed flag."""
    return chunked_grid(metrics, logs, cfg).drop("chunk", "own")
