"""Roll-out against a plain loop over the series of each node."""

import pytest
from pyspark.sql import functions as F

from nodetide.models import forecast
from nodetide.models.store import Scorer
from nodetide.operators.scaling import STAT_COLUMNS
from nodetide.streaming.incremental import Series
from test_stream import CFG, rows


class Line:
    """Stands in for a fitted model: a fixed line over the assembled inputs."""

    def __init__(self, weights):
        self.weights = weights

    def setPredictionCol(self, name):  # noqa: N802 (the name Spark's models use)
        self.column = name
        return self

    def transform(self, df):
        from pyspark.ml.functions import vector_to_array
        v = vector_to_array("features")
        return df.withColumn(self.column, sum((F.lit(w) * v[i] for i, w in enumerate(self.weights)), F.lit(0.0)))


INPUTS = ["cpu", "mem_mean72", "cl_cpu_mean"]
WEIGHTS = {"cpu": (-0.3, 0.2, 0.15), "mem": (0.1, -0.4, 0.05)}


def scorer(scale=1.0):
    constants = {c: 0.0 if c.startswith("mu_") else 1.0 for c in STAT_COLUMNS}
    return Scorer({m: Line([scale * w for w in ws]) for m, ws in WEIGHTS.items()}, INPUTS, constants, "delta")


def plain(feed, steps, scale=1.0):
    """Node by node in Python; forecasts of one step feed the next."""
    nodes = {}
    for r in sorted(feed, key=lambda r: r.window_ts):
        if r.cpu_usage_norm is not None:
            nodes.setdefault(r.node_id, []).append(r)
    last = max(r.window_ts for rs in nodes.values() for r in rs)
    series = {}
    for n, rs in nodes.items():
        s = Series(CFG)
        for r in rs:
            s.add(r.window_ts, r.cpu_usage_norm, r.mem_usage_norm, r.n_records, 0)
        if rs[-1].window_ts < last:
            s.add(last, *s.ring[-1][:3], 0)
        series[n] = s
    out = {}
    for k in range(1, steps + 1):
        mean = sum(s.ring[-1][0] for s in series.values()) / len(series)
        for n, s in series.items():
            f = s.features(CFG)
            v = [f["cpu"], f["mem_mean72"], mean]
            new = [min(1.0, max(0.0, f[m] + scale * sum(w * x for w, x in zip(WEIGHTS[m], v)))) for m in ("cpu", "mem")]
            out[n, last + k * 300] = tuple(new)
        for n, s in series.items():
            s.add(last + k * 300, *out[n, last + k * 300], s.ring[-1][2], 0)
    return out


def test_roll_out_and_direct_horizon(spark):
    feed = rows(spark)
    metrics = feed.filter("cpu_usage_norm IS NOT NULL").withColumn("cloud_provider", F.lit("google")).drop("sev")
    got = forecast.ahead(metrics, None, {"google": {1: scorer(), 6: scorer(0.5), 12: scorer()}, "nobody": {1: scorer()}}, 7, CFG).collect()
    want, six = plain(feed.collect(), 7), plain(feed.collect(), 1, 0.5)
    assert len(got) == len(want) == 21
    last = max(t for _, t in want) - 7 * 300
    for r in got:
        assert (r.rolled_cpu, r.rolled_mem) == pytest.approx(want[r.node_id, r.window_ts], abs=1e-9)
        if r.window_ts == last + 6 * 300:
            assert (r.cpu, r.mem) == pytest.approx(six[r.node_id, last + 300], abs=1e-9) and r.direct_cpu == r.cpu
        else:
            assert r.direct_cpu is None and r.cpu == r.rolled_cpu
    series = forecast.cluster_series(spark.createDataFrame(got)).collect()
    assert len(series) == 14 and {r.metric for r in series} == {"cpu", "memory"}
