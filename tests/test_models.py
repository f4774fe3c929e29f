"""Small training runs: bounds, determinism, saved figures, and the error measures on known numbers."""

import numpy as np
import pytest

from nodetide.models import store
from nodetide.models import train as Tr
from nodetide.operators import modeling as M
from nodetide.operators import quality as Q
from nodetide.operators import scaling as S
from nodetide.plans import training_queries as TQ

TINY = Tr.TrainConfig(train_frac=1.0, tune_frac=1.0, val_frac=1.0, max_iter=2, min_refit_trees=2, min_inst=1)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = []
    for cloud in ("alibaba", "google"):
        for i in range(300):
            cpu, mem, d = float(rng.random()), float(rng.random()), float(rng.normal(0, .1))
            split = "train" if i < 200 else "val" if i < 250 else "test"
            rows.append((cloud, f"{cloud}_1", i * 300, split, cpu, mem, 3, d, d / 2, cpu, mem, min(1.0, max(0.0, cpu + d)), mem))
    return spark.createDataFrame(rows, "cloud_provider string, node_id string, window_ts long, split string, cpu double, "
                                       "mem double, n_rec long, cpu_d1 double, mem_d1 double, cpu_mean6 double, "
                                       "mem_mean6 double, y_cpu_h1 double, y_mem_h1 double").cache()


def test_linear_run_learns_and_is_repeatable(spark, table):
    family = Tr.linear_family(TINY, penalties=(1e-3,))
    one, two = Tr.train(table, family, TINY), Tr.train(table, family, TINY)
    a = {(r.experiment, r.target, r.view): r.rmse for r in one.results.collect()}
    b = {(r.experiment, r.target, r.view): r.rmse for r in two.results.collect()}
    assert a == b and len(a) == 16
    skill = {(r.experiment, r.target): r.skill_persist for r in one.results.filter("view = 'per_machine'").collect()}
    assert skill["google->google", "cpu"] > 0.5
    assert sum(r[-1] for r in one.tuning) == 4  # one best configuration per target and provider


def test_saved_model_scores_and_refuses_other_scale(spark, table, tmp_path):
    run = Tr.train(table, Tr.boosted_trees(TINY, depths=(2,), steps=(0.1,)), TINY)
    store.save_run(run, str(tmp_path), TINY, spark)
    scorer = store.load_scorer(spark, str(tmp_path), "google", 1, "gbt_delta")
    out = store.score(table.filter("cloud_provider = 'google'"), scorer, 300).collect()
    assert len(out) == 300
    assert all(0 <= r.pred_cpu <= 1 and 0 <= r.pred_mem <= 1 and r.target_ts == r.window_ts + 300 for r in out)
    with pytest.raises(ValueError):
        store.read_metadata(spark, store.model_path(str(tmp_path), "google", "cpu", 1, "gbt_delta"), mode="spread")


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_models_tried_on_all_rows_are_not_fitted_again(spark, table, monkeypatch, kind):
    """The chosen model is the one a fit with its number of trees gives, without that fit."""
    cfg = Tr.TrainConfig(train_frac=1.0, tune_frac=1.0, val_frac=1.0, max_iter=5, min_refit_trees=2, min_inst=1, targets=("cpu",), providers=("google",))
    family = Tr.boosted_trees(cfg, depths=(2,), steps=(0.1, 0.9)) if kind == "gbt" else Tr.random_forest(cfg, depths=(2,), trees=(3, 4))
    fits = []
    for cls in (Tr.GBTRegressor, Tr.RandomForestRegressor):
        fit = cls.fit
        monkeypatch.setattr(cls, "fit", lambda self, rows, fit=fit: fits.append((self, rows)) or fit(self, rows))
    run = Tr.train(table, family, cfg)
    assert len(fits) == 2
    got, size = run.models["google", "cpu"], run.sizes["google", "cpu"]
    chosen = next(c for c in family.grid if c.desc == run.configs["google", "cpu"])
    again = chosen.make(size).fit(fits[0][1])
    assert got.getNumTrees == again.getNumTrees == size and got.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:]
    assert got.treeWeights == again.treeWeights and got.featureImportances == again.featureImportances


def test_results_wait_until_they_are_read(spark, table, monkeypatch):
    asked, judge = [], Tr.experiments
    monkeypatch.setattr(Tr, "experiments", lambda *args: asked.append(1) or judge(*args))
    run = Tr.train(table, Tr.linear_family(TINY, penalties=(1e-3,)), TINY)
    assert len(run.models) == 4 and asked == []
    assert run.results.count() == run.results.count() == 16 and asked == [1]


def test_only_the_family_that_is_read_is_trained(spark, monkeypatch):
    made = []
    monkeypatch.setattr(TQ, "_RUNS", {})
    monkeypatch.setattr(TQ, "run_of", lambda spark, sf, family: family)
    monkeypatch.setattr(store, "save_run", lambda run, root, cfg, spark: made.append((run, root)))
    trees, lines = TQ.saved(spark, "sf", "gbt_delta"), TQ.saved(spark, "sf", "linear_delta")
    assert TQ.saved(spark, "sf", "gbt_delta") == trees and made == [("gbt", trees), ("linear", lines)] and trees != lines


def test_few_rows_make_few_tasks(spark):
    rows = spark.range(1000).repartition(8)
    assert Tr._in_fewer_tasks(rows, 1000).rdd.getNumPartitions() == 1
    assert Tr._in_fewer_tasks(rows, 200_000).rdd.getNumPartitions() == 8


def test_tasks_are_those_of_the_labelled_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("google", 1.0, None), ("google", None, None), ("alibaba", 2.0, 1.0)], "cloud_provider string, y_cpu double, y_mem double")
    assert Tr._labelled_rows({"train": rows}, TINY) == {
        ("train", "google", "cpu"): 1, ("train", "google", "mem"): 0, ("train", "alibaba", "cpu"): 1, ("train", "alibaba", "mem"): 1}
    monkeypatch.setattr(Tr, "ROWS_A_TASK", 10)
    asked = []
    few = Tr._in_fewer_tasks
    monkeypatch.setattr(Tr, "_in_fewer_tasks", lambda rows, n: asked.append(n) or few(rows, n))
    table = spark.createDataFrame(
        [("google", f"n{i % 4}", i, "train" if i < 80 else "val" if i < 90 else "test", .5, .5, 3, .1, .1, .5, .5, i / 100 if i % 2 else None, .5) for i in range(100)],
        "cloud_provider string, node_id string, window_ts long, split string, cpu double, mem double, n_rec long, cpu_d1 double, mem_d1 double, "
        "cpu_mean6 double, mem_mean6 double, y_cpu_h1 double, y_mem_h1 double").repartition(16)
    cfg = Tr.TrainConfig(train_frac=1.0, tune_frac=1.0, val_frac=1.0, max_iter=1, min_refit_trees=1, min_inst=1, targets=("cpu",), providers=("google",))
    Tr.train(table, Tr.boosted_trees(cfg, depths=(1,), steps=(.1,)), cfg)
    assert asked == [40, 5]


def test_the_longest_fits_start_first():
    family = Tr.boosted_trees(TINY)
    started = Tr._longest_first({("google", "cpu"): list(family.grid), ("google", "mem"): list(family.grid)[:3]})
    assert [(p[1], c.desc.split(",")[0]) for p, c in started[:4]] == [("cpu", "depth=7"), ("cpu", "depth=7"), ("cpu", "depth=5"), ("cpu", "depth=5")]
    assert len(started) == 9 and started[-1][1].desc.startswith("depth=3")


def test_forests_keep_the_rows_places_and_stay_the_same(spark, table):
    cfg = Tr.TrainConfig(train_frac=1.0, tune_frac=1.0, val_frac=1.0, min_inst=1)
    Tr.enable_checkpoints(spark)
    rows = Tr.for_target(Tr.vectors(table, S.train_stats(table), cfg, ["cpu", "mem", "cpu_d1", "mem_d1"]), "cpu").cache()
    estimator = Tr.random_forest(cfg, depths=(12,), trees=(5,)).grid[0].make(0)
    assert estimator.getCacheNodeIds()
    kept, plain = estimator.fit(rows), estimator.copy().setCacheNodeIds(False).fit(rows)
    assert kept.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_stats_use_training_rows_and_floors(spark):
    rows = spark.createDataFrame(
        [("google", "train", 0.5, 0.5, 2, 0.0, 0.0), ("google", "test", 9.0, 9.0, 9, 9.0, 9.0)],
        "cloud_provider string, split string, cpu double, mem double, n_rec long, cpu_d1 double, mem_d1 double")
    r = S.train_stats(rows).first()
    assert (r.mu_cpu, r.sd_cpu, r.sd_n, r.dsd_mem) == (0.5, 1e-3, 1.0, 1e-4)


def test_settings_are_checked():
    for bad in ({"mode": "x"}, {"horizon": 2}, {"targets": ("disk",)}, {"tune_frac": 0.5}):
        with pytest.raises(ValueError):
            Tr.TrainConfig(**bad)


def test_published_confusion_matrix_figures(spark):
    matrix = spark.createDataFrame(
        [(0, 0, 115710), (0, 1, 123358), (1, 0, 14983), (1, 1, 46761)], "actual int, predicted int, n long")
    r = Q.class_report(matrix).first()
    got = (r.weighted_precision, r.weighted_recall, r.weighted_f1, r.active_recall)
    assert [round(x, 4) for x in got] == [0.7601, 0.5401, 0.5802, 0.7573]


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_auc_with_ties(spark, buckets):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    rows = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert Q.auc_roc(rows, "y", "s", buckets).first().auc == pytest.approx(want, abs=1e-12)


def test_weight_and_cap(spark):
    assert S.instance_weight(9000, 1000) == pytest.approx(3.0)
    assert S.instance_weight(1e9, 1) == 100.0
    df = spark.range(1000)
    assert M.fit_budget(df, 1000, keys=("id",)) is df
    one, two = ({r.id for r in M.fit_budget(d, 100, keys=("id",)).collect()} for d in (df, df.repartition(5)))
    assert one == two and len(one) == 100
