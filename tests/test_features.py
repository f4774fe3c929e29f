"""The chunked grid and the built-up windows against plain pandas, and the edge cases of the time series stage."""

import math

import numpy as np
import pandas as pd
import pytest

from nodetide.config import TraceConfig
from nodetide.operators import features as X
from nodetide.operators import grid as G

METRIC_SCHEMA = ("cloud_provider string, node_id string, window_ts long, cpu_usage_norm double, mem_usage_norm double, "
                 "n_records long")


def metrics_frame(spark, rows):
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def sparse_rows(seed=3, nodes=3, steps=700, share=0.6, step=300):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(nodes):
        start = int(rng.integers(0, 200))
        for i in range(start, steps):
            gap = n == 1 and 250 <= i < 560  # longer than a chunk
            if not gap and rng.random() < share:
                rows.append(("google", f"google_{n}", i * step, float(rng.random()), float(rng.random()), int(rng.integers(1, 9))))
    return rows


def brute(rows, logs, cfg):
    """Reference by pandas on the whole dense series of each node."""
    frame = pd.DataFrame(rows, columns=["cloud", "node_id", "window_ts", "raw_cpu", "raw_mem", "raw_n"])
    sev = {(n, t): s for n, t, s in logs}
    out = []
    for node, g in frame.groupby("node_id"):
        ts = np.arange(g.window_ts.min(), g.window_ts.max() + 1, cfg.step)
        d = g.set_index("window_ts").reindex(ts)
        d["node_id"], d["observed"] = node, d.raw_cpu.notna()
        d["sev"] = [sev.get((node, t), 0) for t in ts]
        for m in ("cpu", "mem"):
            x = d[f"raw_{m}"].ffill()
            d[m] = x
            for k in cfg.lags:
                d[f"{m}_lag{k}"] = x.shift(k)
            for n in cfg.means:
                d[f"{m}_mean{n}"] = x.rolling(n, min_periods=1).mean()
            for n in cfg.spreads:
                d[f"{m}_std{n}"] = x.rolling(n, min_periods=1).std(ddof=0)
                d[f"{m}_max{n}"] = x.rolling(n, min_periods=1).max()
            d[f"{m}_min12"] = x.rolling(12, min_periods=1).min()
            for h in cfg.horizons:
                d[f"y_{m}_h{h}"] = d[f"raw_{m}"].shift(-h)
        for n in (6, 12):
            d[f"warn_cnt{n}"] = (d.sev == 1).rolling(n, min_periods=1).sum()
            d[f"err_cnt{n}"] = (d.sev == 2).rolling(n, min_periods=1).sum()
        d["rn"] = np.arange(1, len(d) + 1)
        out.append(d.reset_index(names="window_ts"))
    return pd.concat(out)


@pytest.mark.parametrize("use_day,chunk", [(False, 80), (False, 5000), (True, 300)])
def test_windows_do_not_depend_on_chunks(spark, use_day, chunk):
    cfg = TraceConfig(use_day=use_day, chunk_steps=chunk)
    rows = sparse_rows()
    rng = np.random.default_rng(1)
    logs = [(r[1], r[2], int(rng.integers(1, 3))) for r in rows if rng.random() < 0.2]
    logs += [("google_1", 300 * 300, 2), ("google_0", 10**9, 1), ("nobody_1", 3000, 1), ("google_0", 90001, 2)]
    log_df = spark.createDataFrame(logs, "node_id string, window_ts long, sev int")
    grid = G.chunked_grid(metrics_frame(spark, rows), log_df, cfg, back=cfg.lookback, ahead=cfg.lookahead)
    got = X.window_features(grid, cfg).filter("own").toPandas().sort_values(["node_id", "window_ts"]).reset_index(drop=True)
    want = brute(rows, logs, cfg).sort_values(["node_id", "window_ts"]).reset_index(drop=True)
    assert len(got) == len(want)
    assert (got.observed == want.observed).all() and (got.rn == want.rn).all()
    shared = [c for c in got.columns if c in want.columns and c not in ("node_id", "observed", "cloud_provider")]
    assert len(shared) > 35
    for c in shared:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)


def test_gap_is_filled_but_labels_stay_raw(spark):
    cfg = TraceConfig(use_day=False)
    rows = [("google", "google_1", t * 300, 0.1 * (t + 1), 0.5, 1) for t in (0, 1, 3)]
    grid = G.chunked_grid(metrics_frame(spark, rows), None, cfg, back=72, ahead=12)
    got = {r.window_ts: r for r in X.window_features(grid, cfg).filter("own").collect()}
    assert sorted(got) == [0, 300, 600, 900]
    assert not got[600].observed and got[600].cpu == pytest.approx(0.2)
    assert got[300].y_cpu_h1 is None and got[600].y_cpu_h1 == pytest.approx(0.4)


def test_context_of_single_node_and_after_gap(spark):
    cfg = TraceConfig()
    rows = [("google", "google_1", 0, 0.2, 0.1, 1), ("google", "google_1", 300, 0.5, 0.1, 1), ("google", "google_1", 900, 0.9, 0.1, 1)]
    got = {r.window_ts: r for r in X.context_delta(X.cluster_context(metrics_frame(spark, rows)), cfg).collect()}
    assert got[0].cl_cpu_std == 0.0 and got[0].cl_cpu_d1 == 0.0
    assert got[300].cl_cpu_d1 == pytest.approx(0.3)
    assert got[900].cl_cpu_d1 == 0.0


def test_flat_series_and_jump(spark):
    cfg = TraceConfig(use_day=False)
    rows = [("google", "google_1", t * 300, 0.4 if t < 100 else 1.0, 0.4, 2) for t in range(101)]
    got = X.compute_features(metrics_frame(spark, rows), None, cfg, True, labels=False)
    last = got.filter("window_ts = 30000").first()
    assert last.mem_std72 < 1e-12 and abs(last.mem_z72) < 1e-9
    assert last.cpu_z72 == 5.0


def test_split_boundaries(spark):
    cfg = TraceConfig(step=100)
    spans = {"google": (0, 10_000)}
    edges = {5799: "train", 5800: None, 6999: None, 7000: "val", 7299: "val", 7300: None, 8499: None, 8500: "test"}
    rows = spark.createDataFrame([("google", t) for t in edges], "cloud_provider string, window_ts long")
    got = {r.window_ts: r.split for r in X.literal_split(rows, spans, cfg).collect()}
    assert got == {t: s for t, s in edges.items() if s}


def test_both_ways_of_joining_context_agree(spark):
    cfg = TraceConfig(use_day=False, chunk_steps=100)
    metrics = metrics_frame(spark, sparse_rows(steps=260))
    small = X.compute_features(metrics, None, cfg, True).toPandas()
    large = X.compute_features(metrics, None, cfg, False).toPandas()
    key = ["node_id", "window_ts"]
    small, large = small.sort_values(key).reset_index(drop=True), large.sort_values(key).reset_index(drop=True)
    assert set(small.columns) == set(large.columns) and len(small) == len(large)
    for c in X.feature_columns(spark.createDataFrame(small.head(1).drop(columns=[c for c in small if c.startswith("y_")]))):
        np.testing.assert_allclose(small[c].astype(float), large[c].astype(float), atol=1e-12, err_msg=c)


def test_context_is_only_broadcast_when_it_fits():
    cfg = TraceConfig(context_broadcast_rows=100)
    assert X.context_fits({"google": (0, 99 * 300)}, cfg)
    assert not X.context_fits({"google": (0, 100 * 300)}, cfg)
    assert not X.context_fits(None, cfg)


def test_one_exchange_of_the_rows(spark):
    """Merge, fill and all windows reuse one exchange by (node, chunk)."""
    cfg = TraceConfig(use_day=False, chunk_steps=100)
    logs = spark.createDataFrame([("google_1", 300, 1)], "node_id string, window_ts long, sev int")
    grid = G.chunked_grid(metrics_frame(spark, sparse_rows(steps=50)), logs, cfg, 72, 12)
    plan = X.window_features(grid, cfg)._jdf.queryExecution().executedPlan().toString()
    by_chunk = [l for l in plan.splitlines() if "Exchange hashpartitioning(node_id" in l and "chunk" in l.split("hashpartitioning(")[1].split(")")[0]]
    assert len(by_chunk) == 1, by_chunk
    assert plan.count("Window [") + plan.count("Window(") >= 4


def test_feature_count_with_day_features():
    cfg = TraceConfig()
    per_metric = len(cfg.lags) + len(cfg.means) + 2 * len(cfg.spreads) + 1
    total = 3 + 6 + 2 + 2 + 2 * per_metric + 2 + 4 + len(X.derived_columns(cfg))
    assert total == 80
    assert math.isclose(cfg.gap, 3600)
