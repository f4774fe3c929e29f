"""Linear models from moments against Spark MLlib and plain least squares."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from nodetide.models import linear

NAMES = [f"f{i}" for i in range(8)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, [1, 2, .1, 5, 1, 1, .5, 3], (900, 8)) + rng.normal(0, 1, 8)
    x[:, 5] = x[:, 0] + 0.5 * rng.normal(size=900)
    y = x @ np.array([1, -.5, 8, 0, 0, .3, 0, .05]) + 2 + rng.normal(0, .5, 900)
    split = np.where(np.arange(900) % 3 == 0, "val", "train")
    rows = [("p", str(s), *map(float, r), float(t)) for s, r, t in zip(split, x, y)]
    df = spark.createDataFrame(rows, "cloud_provider string, split string, " + ", ".join(f"{n} double" for n in NAMES) + ", label_y double").repartition(5).cache()
    return df, x, y, split


def found(df):
    return {(r.split, r.target): linear.Moments.of(r.gram) for r in linear.moments(df, NAMES, ["y"]).collect()}


def test_moments(data):
    df, x, y, split = data
    got = found(df)
    for s in ("train", "val"):
        m, own = got[s, "y"], split == s
        both = np.column_stack([x, y])[own]
        assert m.n == own.sum()
        np.testing.assert_allclose(m.means, both.mean(0), atol=1e-12)
        np.testing.assert_allclose(m.cov, np.cov(both.T, bias=True), atol=1e-10)


@pytest.mark.parametrize("penalty, mix", [(0.0, 0.0), (1e-1, 0.0), (1e-1, 1.0), (1e-2, 0.5), (1.0, 0.5)])
def test_coefficients_equal_those_of_mllib(spark, data, penalty, mix):
    df, x, y, split = data
    b, b0 = linear.fit(found(df)["train", "y"], penalty, mix)
    vec = VectorAssembler(inputCols=NAMES, outputCol="features").transform(df.filter("split = 'train'"))
    model = LinearRegression(labelCol="label_y", regParam=penalty, elasticNetParam=mix, maxIter=5000, tol=1e-14, solver="normal").fit(vec)
    np.testing.assert_allclose(b, model.coefficients.toArray(), atol=1e-6)
    assert b0 == pytest.approx(model.intercept, abs=1e-6)
    own = split == "val"
    assert found(df)["val", "y"].squared_error(b, b0) == pytest.approx(float(((y - x @ b - b0)[own] ** 2).mean()), rel=1e-9)


@pytest.mark.parametrize("l1, l2", [(1e-5, 0.0), (1e-3, 1e-3), (0.05, 0.0), (0.3, 0.3), (5.0, 0.0)])
def test_search_meets_the_conditions_of_a_minimum(l1, l2):
    """Eighty columns made of twelve, some of them twice."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 80)) + 1e-4 * rng.normal(size=(400, 80))
    x[:, 70:] = x[:, :10]
    x = (x - x.mean(0)) / x.std(0)
    y = x[:, 3] - x[:, 40] + rng.normal(size=400)
    r, q = x.T @ x / 400, x.T @ ((y - y.mean()) / y.std()) / 400
    b = linear._signed(r, q, l1, l2)
    slope = q - r @ b - l2 * b
    assert (np.abs(slope) <= l1 + 1e-7).all() and np.abs(slope[b != 0] - l1 * np.sign(b[b != 0])).max(initial=0) < 1e-7


def test_edges(spark, tmp_path):
    one = [("p", "train", 1.0, float(i), float(2 * i), float("nan") if i == 3 else 3.0 + i, None if i == 4 else 5.0 + i) for i in range(9)]
    df = spark.createDataFrame(one, "cloud_provider string, split string, f0 double, f1 double, f2 double, f3 double, label_y double")
    r = linear.moments(df, ["f0", "f1", "f2", "f3"], ["y"]).first()
    assert r.n == 7
    b, b0 = linear.fit(linear.Moments.of(r.gram), 0.0, 0.0)
    assert b[0] == 0 and np.isfinite(b).all() and linear.Moments.of(r.gram).squared_error(b, b0) < 1e-12
    assert linear.moments(df.limit(0), ["f0"], ["y"]).count() == 0
    constant = linear.Moments.of(np.array([[4., 8, 12], [8, 20, 24], [12, 24, 36]]).ravel())
    assert linear.fit(constant, 0.1, 1.0) == (pytest.approx([0.0]), pytest.approx(3.0))
    model = linear.mllib_model(spark, b, b0)
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml.regression import LinearRegressionModel
    again = LinearRegressionModel.load(str(tmp_path / "m"))
    assert again.intercept == b0 and list(again.coefficients) == list(b)


def test_horizons_share_their_statistics_and_baselines_need_one_scale(spark, monkeypatch):
    from types import SimpleNamespace

    from nodetide.plans import training_queries as TQ

    runs, stats = [], []
    row = ("linear_delta", "a->b", "cpu", 5, "per_machine", 1, 1.0, 1.0)
    schema = "model string, experiment string, target string, h_min int, view string, n long, rmse_persist double, rmse_ma6 double"

    def train(table, family, cfg, *figures):
        runs.append((cfg.horizon, cfg.mode))
        return SimpleNamespace(results=spark.createDataFrame([row], schema))

    monkeypatch.setattr(TQ, "feature_stage", lambda spark, sf: spark.range(1))
    monkeypatch.setattr(TQ.S, "train_stats", lambda table: stats.append(1) or table)
    monkeypatch.setattr(TQ.Tr, "train", train)
    monkeypatch.setattr(TQ.store, "save_run", lambda *given: None)
    assert TQ.experiment_baselines(spark, "made up").count() == 3
    assert runs == [(h, "delta") for h in (1, 6, 12)]
    assert TQ.linear_runs(spark, "made up").count() == 6
    assert sorted(runs) == sorted((h, m) for h in (1, 6, 12) for m in ("delta", "spread")) and len(stats) == 1
