"""The chunked state machine against a plain walk, and the rules around it."""

import numpy as np
import pytest

from nodetide.config import TraceConfig
from nodetide.operators import decide as D

SCHEMA = ("cloud_provider string, node_id string, timestamp long, observed_timestamp long, pred_cpu_util double, "
          "pred_mem_util double, cur_cpu_util double, cur_mem_util double, spike boolean")
VALUES = {D.CALM: 0.5, D.CRITICAL: 0.97, D.LOW: 0.1}


def predictions(spark, series, cloud="google", spikes=()):
    rows = [
        (cloud, node, t * 300, (t - 1) * 300, VALUES[c], 0.1 if c == D.LOW else 0.5, 0.5, 0.5, t in spikes)
        for node, codes in series.items() for t, c in enumerate(codes)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def walk(codes):
    state, out = (0, 0, 0), []
    for c in codes:
        state, act, streak = D.advance(state, c, D.Policy())
        out.append((D.ACTIONS[act], streak))
    return out


@pytest.mark.parametrize("chunk", [7, 64, 2016])
def test_chunks_equal_a_plain_walk(spark, chunk):
    rng = np.random.default_rng(5)
    series = {f"n{i}": rng.choice(3, size=150, p=p).tolist() for i, p in enumerate(([.2, .6, .2], [.1, .1, .8], [.4, .3, .3]))}
    series["hot"] = [D.CRITICAL] * 150
    series["idle"] = [D.LOW] * 150
    got = D.decide(predictions(spark, series), TraceConfig(chunk_steps=chunk)).collect()
    by_node = {n: sorted((r for r in got if r.node_id == n), key=lambda r: r.timestamp) for n in series}
    for node, codes in series.items():
        want, last, when = walk(codes), None, None
        assert len(by_node[node]) == len(codes)
        for i, (r, (action, _)) in enumerate(zip(by_node[node], want)):
            if action != "MAINTAIN":
                last, when = action, r.timestamp
            assert (r.action, r.last_action, r.last_action_timestamp) == (action, last, when), (node, i)
            assert (r.previous is None) == (i == 0)
            if i:
                assert r.previous.timestamp == r.timestamp - 300
                assert r.previous.actual_cpu_util == 0.5


def test_policy_steps(spark):
    up = [D.CALM, D.CRITICAL, D.CRITICAL, D.CRITICAL, D.CRITICAL, D.CRITICAL, D.CRITICAL, D.CALM]
    down = [D.LOW] * 8
    got = D.decide(predictions(spark, {"up": up, "down": down}, spikes=(6,)), TraceConfig()).collect()
    rows = {(r.node_id, r.timestamp // 300): r for r in got}
    assert rows["up", 2].action == "SCALE_UP" and rows["up", 2].cpu_change_pct == 25 and rows["up", 2].mem_change_pct == 0
    assert all(rows["up", t].action == "MAINTAIN" for t in (3, 4, 5))
    assert "Cooling down" in rows["up", 3].reason
    assert rows["up", 6].action == "SCALE_UP" and rows["up", 6].cpu_change_pct == 50
    assert "Sustained for 4 windows. Task arrivals spiking." in rows["up", 6].reason
    assert rows["down", 5].action == "SCALE_DOWN" and rows["down", 5].cpu_change_pct == -10
    assert rows["down", 5].reason == "CPU and memory <= 30% for 6 windows."


def test_unknown_provider_uses_default_thresholds(spark):
    row = D.alert_levels(predictions(spark, {"x": [D.CALM]}, cloud="other")).first()
    assert (row.crit_cpu, row.warn_mem) == (0.85, 0.775)


def test_closed_loop_needs_matching_time(spark):
    rows = [("google", "n", 300, 0, 0.5, 0.5, 0.4, 0.4, False), ("google", "n", 900, 600, 0.5, 0.5, 0.4, 0.4, False)]
    got = D.decide(spark.createDataFrame(rows, SCHEMA), TraceConfig()).orderBy("timestamp").collect()
    assert got[1].previous.timestamp == 300 and got[1].previous.actual_cpu_util is None


@pytest.mark.parametrize("chunk", [5, 40, 1000])
def test_run_length(spark, chunk):
    rng = np.random.default_rng(9)
    flags = {f"n{i}": (rng.random(90) < p).tolist() for i, p in enumerate((.3, .8, 1.0))}
    rows = [(n, t * 300, bool(f)) for n, fs in flags.items() for t, f in enumerate(fs)]
    df = spark.createDataFrame(rows, "node_id string, timestamp long, f boolean")
    got = {(r.node_id, r.timestamp): r.run for r in D.run_lengths(df, {"f": "run"}, TraceConfig(chunk_steps=chunk)).collect()}
    for n, fs in flags.items():
        run = 0
        for t, f in enumerate(fs):
            run = run + 1 if f else 0
            assert got[n, t * 300] == run


def test_spike_needs_three_earlier_values(spark):
    rows = [("google", t * 300, v) for t, v in enumerate([10.0, 100.0, 10.0, 90.0, 10.0, 80.0])]
    got = D.arrival_spike(spark.createDataFrame(rows, "cloud_provider string, window_ts long, arrival_rate double"))
    assert [r.arrival_spike for r in got.orderBy("window_ts").collect()] == [False, False, False, True, False, True]
