"""Saved models with the figures needed to reproduce their predictions, and scoring from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.functions.expressions import change_unit, scaled
from nodetide.models.train import Run, TrainConfig
from nodetide.operators.scaling import STAT_COLUMNS

LOADERS = {"gbt": GBTRegressionModel, "rf": RandomForestRegressionModel, "linear": LinearRegressionModel}
META_SCHEMA = ("model string, target string, source_cloud string, horizon int, scale_mode string, config string, "
               "sigma double, stats map<string,double>, features array<string>")


def model_path(root: str, cloud: str, target: str, horizon: int, name: str) -> str:
    return f"{root}/{cloud}/{target}/h{horizon}/{name}"


def save_run(run: Run, root: str, cfg: TrainConfig, spark: SparkSession) -> None:
    """All models of a run and one metadata row beside each."""
    for (cloud, target), model in run.models.items():
        path = model_path(root, cloud, target, cfg.horizon, run.name)
        model.write().overwrite().save(path)
        stats = run.stats[cloud]
        row = (run.name, target, cloud, cfg.horizon, cfg.mode, run.configs[cloud, target],
               stats[change_unit(target, cfg.mode)], stats, run.features)
        spark.createDataFrame([row], META_SCHEMA).write.mode("overwrite").parquet(f"{path}_meta")


def read_metadata(spark: SparkSession, path: str, mode: str = "delta"):
    """The metadata row; a model trained for another scale is refused."""
    row = spark.read.schema(META_SCHEMA).parquet(f"{path}_meta").first()
    if row["scale_mode"] != mode:
        raise ValueError(f"model at {path} was trained with scale mode {row['scale_mode']}, not {mode}")
    return row


@dataclass(frozen=True)
class Scorer:
    """cpu and mem models of one provider and what they need."""

    models: dict[str, object]
    features: list[str]
    stats: dict[str, float]
    mode: str

    def scaled_sql(self) -> list[str]:
        return [f"CAST({scaled(n, self.mode)} AS DOUBLE) AS f_{n}" for n in self.features]


def load_scorer(spark: SparkSession, root: str, cloud: str, horizon: int, name: str, mode: str = "delta") -> Scorer:
    paths = {t: model_path(root, cloud, t, horizon, name) for t in ("cpu", "mem")}
    metas = {t: read_metadata(spark, p, mode) for t, p in paths.items()}
    if metas["cpu"]["features"] != metas["mem"]["features"]:
        raise ValueError("cpu and mem models use different feature lists")
    kind = LOADERS[name.split("_")[0]]
    return Scorer(
        {t: kind.load(p) for t, p in paths.items()}, list(metas["cpu"]["features"]), dict(metas["cpu"]["stats"]), mode
    )


def score(rows: DataFrame, scorer: Scorer, step: int) -> DataFrame:
    """Both predictions per row in one pass: the vector is built once and both models read it.

    The statistics of the provider the model was trained on are constants of the plan.
    """
    constants = {c: F.lit(float(scorer.stats[c])) for c in STAT_COLUMNS}
    wide = rows.withColumns(constants).selectExpr(
        "node_id", "window_ts", "cpu AS cur_cpu", "mem AS cur_mem",
        *[f"{change_unit(t, scorer.mode)} AS unit_{t}" for t in scorer.models], *scorer.scaled_sql(),
    )
    names = [f"f_{n}" for n in scorer.features]
    out = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(wide).drop(*names)
    for target, model in scorer.models.items():
        out = model.setPredictionCol(f"out_{target}").transform(out)
    return out.selectExpr(
        "node_id",
        *[f"greatest(0D, least(1D, cur_{t} + out_{t} * unit_{t})) AS pred_{t}" for t in scorer.models],
        "cur_cpu", "cur_mem", "window_ts", f"window_ts + {step} AS target_ts",
    )
