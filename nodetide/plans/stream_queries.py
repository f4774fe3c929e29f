"""Registered queries: the scoring stream, its tables, parity with the batch features, and streamed decisions.

The feed arrives in three instalments, and the query is stopped and started again after each, so state has to survive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from nodetide.models import store
from nodetide.operators import feed as Feed
from nodetide.operators import quality as Q
from nodetide.operators.features import feature_columns
from nodetide.plans import decision_queries as DQ
from nodetide.plans import model_queries as MQ
from nodetide.plans import oracle as O
from nodetide.plans import telemetry as T
from nodetide.plans.feature_queries import feature_stage, sql_columns
from nodetide.plans.oracle import with_blocks
from nodetide.plans.preprocess_queries import settle_all
from nodetide.plans.registry import query
from nodetide.plans.training_queries import FULL, once, saved
from nodetide.session import scratch_path
from nodetide.sources import readers as R
from nodetide.sources import writers as W
from nodetide.streaming import decision_stream as DS
from nodetide.streaming import feature_stream as FS
from nodetide.streaming import incremental as IS

CFG = T.CHECK
INSTALMENTS = 3


def _run(query) -> None:
    query.awaitTermination()


def _thirds(rows, column: str):
    """The rows in three runs of consecutive windows."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    width = (hi - lo) // INSTALMENTS + 1
    return [rows.filter(F.col(column).between(lo + i * width, lo + (i + 1) * width - 1)) for i in range(INSTALMENTS)]


def _append_feed(rows, path: str) -> None:
    rows.repartition("window_ts").withColumn("w", F.col("window_ts")).write.mode("append").partitionBy("w").parquet(path)


def stream_job(spark, sf, provider: str, engine: str = "tables") -> FS.StreamJob:
    """The finished stream over a provider's whole test period: over kept tables, or over state (`incremental`)."""
    def build():
        rows, metrics = MQ.feed(spark, sf, provider)
        first = Feed.test_start(metrics)
        parts = Feed.seed_and_test(rows, first, CFG)
        scorer = store.load_scorer(spark, saved(spark, sf, "gbt_delta"), provider, FULL.horizon, "gbt_delta")
        root, incoming = scratch_path(spark, "stream"), scratch_path(spark, "incoming")
        job = FS.StreamJob(root, provider, CFG, scorer, first, feature_log_windows=10_000)
        seed = parts.filter("part = 'seed'").drop("part")
        if engine == "tables":
            FS.seed_history(job, seed)
        else:
            _append_feed(seed, incoming)
        start = FS.start if engine == "tables" else IS.start
        for piece in _thirds(parts.filter("part = 'test'").drop("part"), "window_ts"):
            _append_feed(piece, incoming)
            _run(start(job, FS.read_feed(spark, incoming, files_per_trigger=1000), seconds=None))
        return job

    return once(spark, ("stream", engine, sf, provider), build)


def each_stream(spark, sf, read, engine: str = "tables"):
    """`read` of every provider's finished stream, with the provider as a column."""
    parts = [read(spark, stream_job(spark, sf, p, engine)).withColumn("cloud_provider", F.lit(p)) for p in CFG.providers]
    return reduce(lambda x, y: x.unionByName(y), parts)


BLOCKS = {
    **MQ.BLOCKS,
    "due": f"""
        SELECT f.* FROM features f JOIN starts USING (cloud_provider) WHERE window_ts >= t0 AND EXISTS (
            SELECT 1 FROM unified u WHERE u.node_id = f.node_id
                   AND u.window_ts IN (f.window_ts - 72 * {CFG.step}, f.window_ts - 73 * {CFG.step}))""",
}


@query("stream_feed_source", with_blocks("""
    SELECT cloud_provider, node_id, window_ts, round(cpu_usage_norm + 1.3e-9, 6) + 0.0 AS cpu_usage_norm,
           round(mem_usage_norm + 1.3e-9, 6) + 0.0 AS mem_usage_norm, n_records, sev
    FROM feeds JOIN starts USING (cloud_provider) WHERE window_ts >= t0""", **MQ.BLOCKS))
def stream_feed_source(spark, sf):
    """What the streaming source delivers, collected from its micro-batches."""
    def through(rows, metrics):
        test = MQ.cut(rows, metrics).filter("part = 'test'").drop("part")
        incoming, out, checkpoint = (scratch_path(spark, n) for n in ("source-feed", "source-out", "source-checkpoint"))
        W.write_window_feed(test, incoming)

        def write(df, batch_id):
            W.replace_partitions(df.withColumn("batch", F.lit(batch_id)), out, "batch")

        _run(FS.read_feed(spark, incoming, 40).writeStream.option("checkpointLocation", checkpoint).trigger(
            availableNow=True).foreachBatch(write).start())
        return spark.read.parquet(out).select(*R.FEED_SCHEMA.names)

    return settle_all(MQ.each_feed(spark, sf, through))


@query("stream_predictions")
def stream_predictions(spark, sf):
    return each_stream(spark, sf, FS.predictions_table)


def _against_batch(spark, sf, engine):
    """Streamed predictions beside those of the saved models over the batch table."""
    from nodetide.plans.training_queries import scored_rows

    key, names = ["cloud_provider", "node_id", "window_ts"], ["pred_cpu", "pred_mem", "cur_cpu", "cur_mem"]
    batch = scored_rows(spark, sf, "gbt_delta", "split = 'test'").select(*key, *[F.col(n).alias(f"batch_{n}") for n in names])
    both = each_stream(spark, sf, FS.predictions_table, engine).select(*key, *names).join(batch, key, "left")
    off = F.greatest(*[F.abs(F.col(n) - F.col(f"batch_{n}")) for n in names])
    return both.groupBy("cloud_provider").agg(F.count(off).alias("matched"), F.count_if(off.isNull() | (off > 1e-9)).alias("differing"))


PREDICTIONS_SQL = with_blocks("SELECT cloud_provider, count(*) AS matched, 0::BIGINT AS differing FROM due GROUP BY 1", **BLOCKS)


@query("stream_prediction_parity", PREDICTIONS_SQL)
def stream_prediction_parity(spark, sf):
    return _against_batch(spark, sf, "tables")


@query("incremental_prediction_parity", PREDICTIONS_SQL)
def incremental_prediction_parity(spark, sf):
    return _against_batch(spark, sf, "incremental")


@query("stream_scored_rows", with_blocks("SELECT cloud_provider, node_id, window_ts FROM due", **BLOCKS))
def stream_scored_rows(spark, sf):
    """Which nodes the stream scored in which window."""
    return each_stream(spark, sf, FS.predictions_table).select("cloud_provider", "node_id", "window_ts")


FEATURES_SQL = with_blocks(f"SELECT cloud_provider, node_id, window_ts, {sql_columns(O.FEATURE_NAMES)} FROM due", **BLOCKS)


@query("stream_features", FEATURES_SQL)
def stream_features(spark, sf):
    return settle_all(each_stream(spark, sf, FS.feature_log).select("cloud_provider", "node_id", "window_ts", *O.FEATURE_NAMES))


@query("incremental_features", FEATURES_SQL)
def incremental_features(spark, sf):
    """The same from the stream that keeps its windows in state."""
    return settle_all(each_stream(spark, sf, FS.feature_log, "incremental").select("cloud_provider", "node_id", "window_ts", *O.FEATURE_NAMES))


PARITY_SQL = with_blocks(f"""
    SELECT feature, matched, 0::BIGINT AS only_stream, total - matched AS only_batch, false AS failed
    FROM (SELECT count(*) AS matched FROM due), (SELECT count(*) AS total FROM features), (SELECT unnest([{', '.join(f"'{n}'" for n in O.FEATURE_NAMES)}]) AS feature)""", **BLOCKS)


def _parity(spark, sf, engine):
    """A row a feature: rows on both sides and on one only, and whether any value differs by more than 1e-9."""
    log, batch = each_stream(spark, sf, FS.feature_log, engine), feature_stage(spark, sf)
    one = F.lit(1).alias("one")
    counts = Q.parity_counts(log, batch).select("only_stream", "only_batch", one)  # one row
    return Q.parity(log, batch, feature_columns(batch)).select("feature", "matched", "failed", one).join(F.broadcast(counts), "one").drop("one")


@query("stream_parity", PARITY_SQL)
def stream_parity(spark, sf):
    return _parity(spark, sf, "tables")


@query("incremental_parity", PARITY_SQL)
def incremental_parity(spark, sf):
    return _parity(spark, sf, "incremental")


LIVE_SQL = with_blocks(f"""
    SELECT cloud_provider, u.window_ts, count(*) AS n, round(sqrt(avg(pow(cpu - u.cpu_usage_norm, 2))) + 1.3e-9, 6) + 0.0 AS rmse_cpu_persist,
           round(sqrt(avg(pow(mem - u.mem_usage_norm, 2))) + 1.3e-9, 6) + 0.0 AS rmse_mem_persist
    FROM due d JOIN (SELECT node_id, window_ts, cpu_usage_norm, mem_usage_norm FROM unified) u ON u.node_id = d.node_id AND u.window_ts = d.window_ts + {CFG.step}
    GROUP BY 1, 2""", **BLOCKS)


def _live(spark, sf, engine):
    live = each_stream(spark, sf, FS.live_error_table, engine)
    return settle_all(live.select("cloud_provider", "window_ts", "n", "rmse_cpu_persist", "rmse_mem_persist"))


@query("stream_live_error", LIVE_SQL)
def stream_live_error(spark, sf):
    """Error of the last-value forecast as the stream recorded it."""
    return _live(spark, sf, "tables")


@query("incremental_live_error", LIVE_SQL)
def incremental_live_error(spark, sf):
    return _live(spark, sf, "incremental")


@query("stream_running_error")
def stream_running_error(spark, sf):
    return Q.running_error(each_stream(spark, sf, FS.live_error_table))


STREAM_RECORD = DQ.RECORD


@query("stream_decisions", with_blocks(f"SELECT {', '.join(STREAM_RECORD)} FROM records", **DQ.BLOCKS))
def stream_decisions(spark, sf):
    """The state machine on a stream, restarted twice; equal to the batch decisions."""
    rows = T.staged(spark, ("decision_feed", sf, CFG), lambda: DQ.predictions(spark, sf))
    incoming, out, checkpoint = (scratch_path(spark, n) for n in ("decision-feed", "decisions", "decision-checkpoint"))
    for piece in _thirds(rows, "timestamp"):
        piece.write.mode("append").parquet(incoming)
        stream = DS.decisions(DS.read_predictions(spark, incoming, files_per_trigger=1000))
        _run(DS.start(stream, out, checkpoint, seconds=None))
    return spark.read.parquet(out).select(*STREAM_RECORD)
