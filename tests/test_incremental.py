"""The stream that keeps its windows in state gives what the stream over tables and the batch table give."""

import random

import pytest
from pyspark.sql import functions as F

from nodetide.operators import features as X
from nodetide.operators import quality as Q
from nodetide.streaming import feature_stream as FS
from nodetide.streaming import incremental as I
from test_stream import CFG, FIRST, job_at, rows, run_batches, table


def put(feed, steps, incoming):
    feed.filter(F.col("window_ts").isin([s * 300 for s in steps])).coalesce(1).write.mode("append").parquet(incoming)


def run(spark, job, incoming):
    I.start(job, FS.read_feed(spark, incoming, 100), seconds=None).awaitTermination()


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """Seed and first windows, then two restarts, the last with a late row."""
    where = tmp_path_factory.mktemp("incremental")
    job, feed, incoming = job_at(where / "s"), rows(spark), str(where / "in")
    for steps in (range(0, 102), [102], [103]):
        put(feed, steps, incoming)
        run(spark, job, incoming)
    late = spark.createDataFrame([("google_1", 90 * 300, 0.5, 0.5, 1, 0)], FS.FEED_SCHEMA)
    late.coalesce(1).write.mode("append").parquet(incoming)
    run(spark, job, incoming)
    return job


def test_same_tables_as_the_stream_over_history(spark, streamed, tmp_path):
    other = run_batches(spark, tmp_path / "tables", [(i, [100 + i]) for i in range(4)])
    for read in (FS.predictions_table, FS.live_error_table, FS.feature_log):
        a, b = (read(spark, job) for job in (streamed, other))
        assert sorted(a.columns) == sorted(b.columns) and table(a) == table(b), read.__name__


def test_parity_with_the_batch_table(spark, streamed):
    feed = rows(spark)
    metrics = feed.filter("cpu_usage_norm IS NOT NULL").withColumn("cloud_provider", F.lit("google"))
    logs = feed.filter("sev > 0").select("node_id", "window_ts", "sev")
    batch = X.compute_features(metrics, logs, CFG.with_(chunk_steps=500), True, labels=False)
    names = [c for c in X.feature_columns(batch) if c != "rn"]
    worst = Q.parity(FS.feature_log(spark, streamed), batch, names).collect()
    assert len(worst) == 72 and not any(r.failed for r in worst) and worst[0].matched > 0


def test_late_rows_are_set_aside(spark, streamed):
    assert [tuple(r)[:2] for r in I.late_rows(spark, streamed).collect()] == [("google_1", 90 * 300)]


@pytest.mark.parametrize("day", [False, True])
def test_series_against_plain_windows(day):
    cfg = CFG.with_(use_day=day, chunk_steps=400)
    rng = random.Random(5)
    series, filled, last = I.Series(cfg), [], None
    for at in range(1200):
        if rng.random() < 0.3 and filled:
            filled.append((*filled[-1][:3], 0, False))
            continue
        cpu, mem = (0.375, 0.2) if 500 < at < 700 else (rng.random(), round(rng.random(), 2))
        row = (cpu, mem, rng.randrange(9), rng.randrange(3), True)
        filled.append(row)
        assert series.add(at * 300, *row[:4])
        if not series.ready(cfg.warmup):
            continue
        got = series.features(cfg)
        for i, m in enumerate(("cpu", "mem")):
            v = [r[i] for r in filled]
            for n in cfg.means:
                assert got[f"{m}_mean{n}"] == pytest.approx(sum(v[-n:]) / n, abs=1e-12)
            for n in cfg.spreads:
                mean = sum(v[-n:]) / n
                assert got[f"{m}_std{n}"] == pytest.approx((sum((x - mean) ** 2 for x in v[-n:]) / n) ** .5, abs=1e-9)
                assert got[f"{m}_max{n}"] == max(v[-n:])
            assert got[f"{m}_min12"] == min(v[-12:]) and all(got[f"{m}_lag{k}"] == v[-1 - k] for k in cfg.lags)
        if 580 < at < 700:
            assert got["cpu_std72"] == 0.0
        assert got["err_cnt12"] == sum(r[3] == 2 for r in filled[-12:]) and got["n_rec_mean12"] == sum(r[2] for r in filled[-12:]) / 12
    assert not series.add(5 * 300, 0.1, 0.1, 1, 0)
    assert series.add(9000 * 300, None, None, None, 1) and series.add(9001 * 300, 0.5, 0.5, 1, 0) and not series.ready(cfg.warmup)


def test_state_does_not_grow():
    import pickle

    series, rng, sizes = I.Series(CFG), random.Random(6), []
    for at in range(4000):
        series.add(at * 300, rng.random(), rng.random(), 1, 0)
        if at in (500, 3999):
            sizes.append(len(pickle.dumps(series)))
    assert sizes[1] < 1.3 * sizes[0] and FIRST
