"""The scoring stream: grouping into batches, repeated batches and restarts must not change what it writes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodetide.config import TraceConfig
from nodetide.models.store import Scorer
from nodetide.operators import decide as D
from nodetide.operators import features as X
from nodetide.operators import quality as Q
from nodetide.operators.scaling import STAT_COLUMNS
from nodetide.sources.readers import FEED_SCHEMA
from nodetide.streaming import decision_stream as DS
from nodetide.streaming import feature_stream as FS
from test_decisions import SCHEMA, walk

CFG = TraceConfig(use_day=False, chunk_steps=80)
FIRST = 100 * 300


class NoChange:
    """Stands in for a fitted model: forecasts no change."""

    def setPredictionCol(self, name):  # noqa: N802 (the name Spark's models use)
        self.column = name
        return self

    def transform(self, df):
        return df.withColumn(self.column, F.lit(0.0))


def scorer():
    return Scorer({"cpu": NoChange(), "mem": NoChange()}, ["cpu", "mem_mean72", "err_cnt6"], {c: 1.0 for c in STAT_COLUMNS}, "delta")


def rows(spark):
    made = [
        (f"google_{n}", t * 300, ((7 * t + 3 * n) % 50) / 50, ((5 * t + n) % 40) / 40, 1 + (t + n) % 3, 2 if (t + n) % 9 == 0 else 0)
        for n in range(3) for t in range(106) if (t * (n + 2)) % 5 != 4
    ]
    made.append(("google_0", 101 * 300, None, None, None, 1))  # a window with log lines only
    keyed = {r[:2]: r for r in made}
    return spark.createDataFrame(list(keyed.values()), FEED_SCHEMA).cache()


def job_at(path):
    return FS.StreamJob(str(path), "google", CFG, scorer(), FIRST, feature_log_windows=100)


def run_batches(spark, path, groups):
    job, feed = job_at(path), rows(spark)
    FS.seed_history(job, feed.filter(F.col("window_ts") < FIRST))
    for i, steps in groups:
        FS.process_batch(job, feed.filter(F.col("window_ts").isin([s * 300 for s in steps])), i)
    return job


def table(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("seeded", [True, False])
def test_first_windows_without_predictions(spark, tmp_path, seeded):
    """The first scored window begins a block, or no node has a history yet: nothing is due, nothing fails."""
    first = job_at("x").block_seconds * 2
    job = FS.StreamJob(str(tmp_path / "s"), "google", CFG, scorer(), first, feature_log_windows=100)
    feed = rows(spark).withColumn("window_ts", F.col("window_ts") + first - FIRST)
    if seeded:
        FS.seed_history(job, feed.filter(F.col("window_ts") < first))
    for i in range(3):
        FS.process_batch(job, feed.filter(F.col("window_ts") == first + i * 300), i)
    scored = FS.predictions_table(spark, job)
    assert (scored.count() > 0) == seeded and (FS.live_error_table(spark, job).count() > 0) == seeded


def test_batches_repeats_and_parity(spark, tmp_path):
    one = run_batches(spark, tmp_path / "one", [(i, [100 + i]) for i in range(4)])
    many = run_batches(spark, tmp_path / "many", [(0, [100, 101]), (0, [100, 101]), (1, [102, 103]), (1, [102, 103])])
    for read in (FS.predictions_table, FS.live_error_table, FS.feature_log):
        a, b = table(read(spark, one)), table(read(spark, many))
        assert a and a == b, read.__name__
    # the last-value model has the baseline's error
    live = FS.live_error_table(spark, one).collect()
    assert all(r.rmse_cpu_model == pytest.approx(r.rmse_cpu_persist) for r in live)

    feed = rows(spark)
    metrics = feed.filter("cpu_usage_norm IS NOT NULL").withColumn("cloud_provider", F.lit("google"))
    logs = feed.filter("sev > 0").select("node_id", "window_ts", "sev")
    batch = X.compute_features(metrics, logs, CFG.with_(chunk_steps=500), True, labels=False)
    names = [c for c in X.feature_columns(batch) if c != "rn"]
    worst = Q.parity(FS.feature_log(spark, one), batch, names).collect()
    assert len(worst) == len(names) == 72
    assert not any(r.failed for r in worst)


def test_a_batch_that_ends_between_two_writes_shows_nothing(spark, tmp_path, monkeypatch):
    job, feed = job_at(tmp_path / "s"), rows(spark)
    FS.seed_history(job, feed.filter(F.col("window_ts") < FIRST))
    batches = [feed.filter(F.col("window_ts") == FIRST + i * 300) for i in range(2)]
    FS.process_batch(job, batches[0], 0)
    seen = [table(read(spark, job)) for read in (FS.predictions_table, FS.feature_log)]
    monkeypatch.setattr(Q, "live_error", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        FS.process_batch(job, batches[1], 1)
    assert [table(read(spark, job)) for read in (FS.predictions_table, FS.feature_log)] == seen
    assert job.table(spark, "predictions", FS.PREDICTION_SCHEMA).count() > len(seen[0])
    monkeypatch.undo()
    FS.process_batch(job, batches[1], 1)
    assert FS.predictions_table(spark, job).count() == job.table(spark, "predictions", FS.PREDICTION_SCHEMA).count() > len(seen[0])


def test_query_restarts_from_its_checkpoint(spark, tmp_path):
    job, feed, incoming = job_at(tmp_path / "s"), rows(spark), str(tmp_path / "in")
    FS.seed_history(job, feed.filter(F.col("window_ts") < FIRST))
    for steps in ([100, 101], [102], []):
        if steps:
            feed.filter(F.col("window_ts").isin([s * 300 for s in steps])).coalesce(1).write.mode("append").parquet(incoming)
        FS.start(job, FS.read_feed(spark, incoming, 10), seconds=None).awaitTermination()
    got = FS.predictions_table(spark, job)
    assert sorted(r[0] for r in got.select("window_ts").distinct().collect()) == [100 * 300, 101 * 300, 102 * 300]
    assert got.count() == got.select("node_id", "window_ts").distinct().count()


def test_streamed_decisions_survive_restarts(spark, tmp_path):
    codes = [D.CRITICAL] * 9 + [D.LOW] * 9
    value = {D.CRITICAL: 0.95, D.LOW: 0.1}
    made = [("google", "n", t * 300, (t - 1) * 300, value[c], 0.1, None, None, False) for t, c in enumerate(codes)]
    incoming, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for piece in (made[:5], made[5:11], made[11:]):
        spark.createDataFrame(piece, SCHEMA).coalesce(1).write.mode("append").parquet(incoming)
        DS.start(DS.decisions(DS.read_predictions(spark, incoming, 10)), out, ckpt, seconds=None).awaitTermination()
    got = [r.action for r in spark.read.parquet(out).orderBy("timestamp").collect()]
    assert got == [a for a, _ in walk(codes)]


def test_streamed_records_equal_those_of_the_batch(spark, tmp_path, monkeypatch):
    """Rows out of order, gaps, restarts; only the predictions themselves go through the machine."""
    passed, made = [], DS.stepper
    monkeypatch.setattr(DS, "stepper", lambda policy, columns: passed.append(columns) or made(policy, columns))
    rng = np.random.default_rng(3)
    rows = [("google", f"n{i}", t * 300, (t - 1) * 300, (.95, .1, float(rng.choice([.95, .1, .5])))[i], .1, None if t % 5 == 0 else .2, .3, bool(t % 2))
            for i in range(3) for t in rng.permutation(40).tolist() if t % 11]
    feed = spark.createDataFrame(rows, SCHEMA)
    incoming, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for lo, hi in ((0, 9), (10, 12), (13, 39)):
        feed.filter(F.col("timestamp").between(lo * 300, hi * 300)).write.mode("append").parquet(incoming)
        DS.start(DS.decisions(DS.read_predictions(spark, incoming, 100)), out, ckpt, seconds=None).awaitTermination()
    want = D.decide(feed, TraceConfig(chunk_steps=7))
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.action for r in want.collect()} == set(D.ACTIONS)
    assert passed == [feed.columns] * 3
