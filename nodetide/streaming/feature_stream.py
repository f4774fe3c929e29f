"""Scoring of new windows as they arrive, with the same feature code as the batch table.

All state lives in tables below one folder, partitioned by window: a batch that is run again overwrites exactly the
partitions it wrote before, and a restarted query finds its whole history. Partitions sit in coarse blocks of one
history length, so a batch only lists the few blocks it needs however long the stream has run. A batch's last write is a
manifest of its windows; tables are read by it, so all of a batch's tables come into sight together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nodetide.config import TraceConfig
from nodetide.models.store import Scorer, score
from nodetide.operators import features as X
from nodetide.operators import quality as Q
from nodetide.operators.feed import FEED_COLUMNS
from nodetide.sources.readers import FEED_SCHEMA
from nodetide.sources.writers import replace_partitions


PLACE = "block bigint, w bigint"
HISTORY_SCHEMA = (
    "node_id string, window_ts bigint, cpu_usage_norm double, mem_usage_norm double, n_records bigint, sev int, "
    + PLACE + ", batch bigint")
PREDICTION_SCHEMA = (
    "node_id string, pred_cpu double, pred_mem double, cur_cpu double, cur_mem double, window_ts bigint, "
    "target_ts bigint, " + PLACE)
LIVE_SCHEMA = (
    "window_ts bigint, n bigint, rmse_cpu_model double, rmse_cpu_persist double, rmse_mem_model double, "
    "rmse_mem_persist double, " + PLACE)
MANIFEST_SCHEMA = "window_ts bigint, batch bigint"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@dataclass(frozen=True)
class StreamJob:
    """One provider's scoring stream below `root`."""

    root: str
    cloud: str
    cfg: TraceConfig
    scorer: Scorer
    first_window: int
    feature_log_windows: int = 20

    @property
    def block_seconds(self) -> int:
        return self.cfg.history_windows * self.cfg.step

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            "block": F.floor(F.col("window_ts") / self.block_seconds), "w": F.col("window_ts")
        })

    def table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        """A whole state table; empty before the first write."""
        path = self.path(name)
        rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        return rows.drop("block", "w")

    def committed(self, spark: SparkSession, rows: DataFrame) -> DataFrame:
        """The rows of windows whose batch has written all its tables."""
        return rows.join(self.table(spark, "manifest", MANIFEST_SCHEMA).select("window_ts"), "window_ts", "left_semi")

    def between(self, spark: SparkSession, name: str, schema: str, lo: int, hi: int) -> DataFrame:
        """Rows of a state table from window lo to hi; only their blocks are listed, only their partitions read."""
        wanted = [f"{self.path(name)}/block={b}" for b in range(lo // self.block_seconds, hi // self.block_seconds + 1)]
        there = [p for p in wanted if exists(spark, p)]
        if not there:  # nothing was scored yet, or the windows begin a block
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).option("basePath", self.path(name)).parquet(*there)
        return rows.filter(F.col("w").between(lo, hi))


def seed_history(job: StreamJob, seed: DataFrame) -> None:
    """Put the windows before the stream into its history."""
    rows = job.placed(seed.select(*FEED_COLUMNS)).withColumn("batch", F.lit(-1).cast("bigint"))
    replace_partitions(rows, job.path("history"), "block", "w", "batch")


def stream_features(job: StreamJob, rows: DataFrame, windows: list[int]) -> DataFrame:
    """Features of the given windows' observed rows, from them and their history.

    A node is scored once the history holds an observation of it old enough to fill every frame: in the
    two windows at the far end of what one window's history keeps. The rule looks at each window alone, so the
    result does not depend on how windows were grouped into batches.
    """
    cfg = job.cfg
    metrics = rows.filter("cpu_usage_norm IS NOT NULL").withColumn("cloud_provider", F.lit(job.cloud))
    logs = rows.filter("sev > 0").groupBy("node_id", "window_ts").agg(F.max("sev").alias("sev"))
    small = X.context_fits({job.cloud: (windows[0] - cfg.history_windows * cfg.step, windows[-1])}, cfg)
    computed = X.compute_features(metrics, logs, cfg, small, labels=False).drop("rn")
    far = F.explode(F.array(*[
        F.col("window_ts") + (cfg.history_windows - 1 - i) * cfg.step
        for i in range(cfg.history_windows - cfg.warmup)
    ]))
    ready = metrics.select("node_id", far.alias("window_ts")).distinct()
    return computed.filter(F.col("window_ts").isin(windows)).join(ready, ["node_id", "window_ts"], "left_semi")


def process_batch(job: StreamJob, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch of one or more whole windows."""
    spark, cfg = batch.sparkSession, job.cfg
    batch = batch.select(*FEED_COLUMNS).persist()
    try:
        # One value per window of the trigger, so the list is bounded by the files of one trigger.
        windows = sorted(r[0] for r in batch.select("window_ts").distinct().collect())
        if not windows:
            return
        lo, hi = windows[0], windows[-1]
        rows = job.placed(batch).withColumn("batch", F.lit(batch_id).cast("bigint"))
        replace_partitions(rows, job.path("history"), "block", "w", "batch")
    finally:
        batch.unpersist()

    since = lo - (cfg.history_windows - 1) * cfg.step
    history = job.between(spark, "history", HISTORY_SCHEMA, since, hi).select(*FEED_COLUMNS)
    write_scores(job, stream_features(job, history, windows), history.filter(F.col("window_ts").isin(windows)), windows, batch_id)


def write_scores(job: StreamJob, features: DataFrame, arrived: DataFrame, windows: list[int], batch_id: int) -> None:
    """Predictions, the feature log of the first windows, and the error of the predictions that the windows settle.

    The manifest comes last: it names the batch's windows, and readers see none of its tables' rows before.
    """
    spark, step = features.sparkSession, job.cfg.step
    lo, hi = windows[0], windows[-1]
    features = features.persist()
    try:
        replace_partitions(job.placed(score(features, job.scorer, step)), job.path("predictions"), "block", "w")
        log_until = job.first_window + job.feature_log_windows * step
        if lo < log_until:
            logged = job.placed(features.filter(F.col("window_ts") < log_until))
            replace_partitions(logged, job.path("features_log"), "block", "w")
    finally:
        features.unpersist()

    due = job.between(spark, "predictions", PREDICTION_SCHEMA, lo - step, hi - step).drop("block", "w")
    replace_partitions(job.placed(Q.live_error(due, arrived)), job.path("live_error"), "block", "w")
    done = spark.createDataFrame([(w, batch_id) for w in windows], MANIFEST_SCHEMA)
    replace_partitions(done, job.path("manifest"), "batch")


def read_feed(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The window feed as a stream: fixed schema, a bounded number of files per trigger."""
    return (
        spark.readStream.schema(FEED_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def start(job: StreamJob, feed: DataFrame, seconds: int | None = 5, name: str = "resource-predictions") -> StreamingQuery:
    """Run the stream: every `seconds`, or once over all that is there when None."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return (
        feed.writeStream.queryName(name)
        .option("checkpointLocation", job.path("checkpoint"))
        .trigger(**trigger)
        .foreachBatch(lambda df, batch_id: process_batch(job, df, batch_id))
        .start()
    )


def predictions_table(spark: SparkSession, job: StreamJob) -> DataFrame:
    return job.committed(spark, job.table(spark, "predictions", PREDICTION_SCHEMA))


def live_error_table(spark: SparkSession, job: StreamJob) -> DataFrame:
    return job.committed(spark, job.table(spark, "live_error", LIVE_SCHEMA))


def feature_log(spark: SparkSession, job: StreamJob) -> DataFrame:
    return job.committed(spark, spark.read.parquet(job.path("features_log")).drop("block", "w"))
