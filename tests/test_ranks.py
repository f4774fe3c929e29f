"""Order statistics, percentiles, draws and sketches against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodetide.operators import distinct as N
from nodetide.operators import logs as L
from nodetide.operators import ranks as R


def hard_values(rng, n):
    """Ties, tiny and huge numbers, and one value in a third of all rows."""
    kinds = [lambda: rng.random(), lambda: 0.25, lambda: rng.random() * 1e-12, lambda: -rng.random() * 1e9, lambda: float(rng.randrange(5))]
    return [kinds[rng.randrange(5)]() for _ in range(n)]


@pytest.mark.parametrize("few", [10_000, 3])
def test_order_statistics(spark, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "RANGES", 16)
    rng = random.Random(1)
    groups = {"a": hard_values(rng, 3000), "b": [7.0] * 50, "c": [1.0], "d": []}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)], "g string, v double")
    asked = [(g, f"r{r}", r) for g, vs in groups.items() for r in {1, 2, len(vs) // 3, len(vs) // 2, len(vs), len(vs) + 5} if r]
    got = {(r.g, r.name): r.v for r in R.order_statistics(rows, ["g"], "v", spark.createDataFrame(asked, "g string, name string, rank long")).collect()}
    assert got == {(g, name): sorted(groups[g])[r - 1] for g, name, r in asked if r <= len(groups[g])}


def test_exact_quantiles_equal_the_sketch_of_few_rows(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(p, v, abs(v) % 1) for p in ("x", "y", "z") for v in hard_values(rng, 700)], "cloud_provider string, cpu double, mem double")
    probs = {"00": 0.0, "06": 0.06, "95": 0.95, "99": 0.99, "100": 1.0}
    ask = {"c": "cpu", "m": "mem"}
    got, want = (sorted(map(tuple, df.collect())) for df in (R.exact_quantiles(rows, ask, probs), L.provider_quantiles(rows, ask, probs)))
    assert got == want and len(got) == 3


def test_log_thresholds_are_exact_beyond_the_sketch(spark):
    """More rows than the sketch holds, all of different values: every rank counts."""
    values = np.random.default_rng(4).permutation(60_000) / 60_000
    rows = spark.createDataFrame([("x", float(v), float(1 - v)) for v in values] + [("null", None, None)],
                                 "cloud_provider string, cpu_usage_norm double, mem_usage_norm double")
    cpu, mem = np.sort(values), np.sort(1 - values)
    got = {r.cloud_provider: r for r in L.log_thresholds(rows).collect()}
    assert [got["x"][f"{m}{q}"] for m in ("cpu", "mem") for q in (95, 99)] == [float(v[n]) for v in (cpu, mem) for n in (56_999, 59_399)]
    assert set(got) == {"x", "null"} and got["null"].cpu95 is None


@pytest.mark.parametrize("n", [1, 7, 100, 40_000])
def test_counted_quantiles(spark, n):
    values = np.random.default_rng(n).integers(0, 1 + n // 3, n) * 3600
    rows = spark.createDataFrame([("x", int(v)) for v in values] + [("x", None), ("y", 5)], "cloud_provider string, q long")
    got = {r.cloud_provider: r for r in R.counted_quantiles(rows, "q", {"00": 0.0, "06": 0.06, "80": 0.80, "100": 1.0}).collect()}
    assert [got["x"][f"q{s}"] for s in ("00", "06", "80", "100")] == [int(np.sort(values)[max(1, -(-n * p // 100)) - 1]) for p in (0, 6, 80, 100)]
    assert got["y"].q06 == 5


def digest(seed, *keys):
    return int(hashlib.md5(f"{seed}:{':'.join(map(str, keys))}".encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("n", [0, 1, 37, 399, 400, 1000])
def test_draws_are_exact_and_repeatable(spark, n):
    rows = [(f"n{i % 40}", i // 40) for i in range(400)]
    df = spark.createDataFrame(rows, "node_id string, window_ts long")
    want = sorted(rows, key=lambda r: digest(5, *r))[:n]
    for frame in (df, df.repartition(7)):
        assert sorted(map(tuple, R.draw_rows(frame, n, 5, ["node_id", "window_ts"]).collect())) == sorted(want)


def test_equal_keys_fill_the_draw(spark):
    df = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(50)], "k int, v int")
    assert R.draw_rows(df, 70, 3, ["k"]).count() == 70 and "_draw" not in R.draw_rows(df, 70, 3, ["k"]).columns


def test_shares(spark):
    df = spark.range(4000).select("id", F.lit(None).cast("string").alias("none"))
    got = {r.id for r in R.draw_share(df, 0.25, 9, ["id", "none"]).collect()}
    assert got == {i for i in range(4000) if digest(9, i, "") < 0.25 * 2**52} and 850 < len(got) < 1150


def test_kept_sketches(spark):
    rng = np.random.default_rng(3)
    values = rng.beta(2, 5, 30_000)
    rows = [("p", int(i) * 120 - 500_000, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "cloud_provider string, window_ts long, cpu double")
    daily = R.daily_sketches(df, {"cpu": "cpu"})
    assert daily.count() > 32 and daily.agg(F.sum("rows")).first()[0] == len(values)
    merged = R.merged_sketches(daily, ["cpu"], days_at_once=4)
    r = R.sketched_quantiles(merged, ["cpu"], {"50": 0.5, "99": 0.99}).first()
    for got, p in ((r.cpu50, 0.5), (r.cpu99, 0.99)):
        assert abs((values <= got).mean() - p) <= R.SKETCH_ERROR
    assert merged.first()["rows"] == len(values)


def test_distinct_nodes_of_periods(spark):
    """Far more nodes than a sketch holds; each provider sees some of them in both periods."""
    rows = spark.range(120_000).selectExpr("IF(id % 3 = 0, 'x', 'y') AS cloud_provider", "concat('n', id % 60000) AS node_id", "(id DIV 40000) * 86400 AS window_ts")
    got = {r.cloud_provider: r for r in N.nodes_of_periods(N.daily_nodes(rows), (0, 0), (1, 2)).collect()}
    exact = rows.groupBy("cloud_provider", "node_id").agg(F.max(F.expr("window_ts = 0")).alias("a"), F.max(F.expr("window_ts > 0")).alias("b")).groupBy("cloud_provider").agg(
        F.count_if(F.col("a")).alias("nodes_first"), F.count_if(F.col("b")).alias("nodes_second"), F.count_if(F.expr("a AND b")).alias("nodes_both"), F.count("*").alias("nodes_either")).collect()
    for r in exact:
        for c in ("nodes_first", "nodes_second", "nodes_both", "nodes_either"):
            assert abs(got[r.cloud_provider][c] - r[c]) <= 1.5 * N.ERROR * r["nodes_either"], c
    one = N.nodes_of_periods(N.daily_nodes(rows), (0, 0), (7, 9)).first()
    assert one.nodes_second == one.nodes_both == 0 and one.nodes_first == one.nodes_either
