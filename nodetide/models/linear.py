"""Linear models of a whole grid from one pass over the rows: second moments first, then every fit on them alone.

A pass gives, for each provider, split and target, the Gram matrix of [1, features, label]. Ridge solutions come from it by
Cholesky, lasso and elastic net by feature-sign search, and the squared error of any of them over another split from that
split's matrix. Penalties have the meaning of Spark MLlib's with standardised features and labels, so have the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodetide.session import ship_package

SETS = ["cloud_provider", "split", "target"]
#: Partial matrices that one task of the merge takes at most are those of all tasks over this number.
MERGE = 64


def moments(rows: DataFrame, names: list[str], targets: list[str]) -> DataFrame:
    """Columns cloud_provider, split, target, n and gram (the matrix, row by row) for every set there is.

    `rows` has the feature columns `names` and a column label_<target> for each target. Rows with a null or non-finite
    feature are left out, and those without the label for that target. A task sums its rows and gives one matrix a set;
    these are added up in two steps, so no task takes the matrices of all others.
    """
    ship_package(rows.sparkSession)
    width = len(names) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[_doubles(batch.column(2 + i)) for i in range(len(names))]])
            usable = np.isfinite(x).all(axis=1)
            keys = pd.MultiIndex.from_arrays([batch.column(0).to_pylist(), batch.column(1).to_pylist()])
            codes, found = keys.factorize()
            for t, target in enumerate(targets):
                y = _doubles(batch.column(2 + len(names) + t))
                ready = usable & np.isfinite(y)
                for k, key in enumerate(found):
                    own = ready & (codes == k)
                    if own.any():
                        z = np.column_stack([x[own], y[own]])
                        at = (*key, target)
                        sums[at] = sums.get(at, 0.0) + z.T @ z
        made = list(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k, _ in made], pa.string()) for i in range(3)] + [pa.array([g.tobytes() for _, g in made], pa.binary())],
                                         names=[*SETS, "gram"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        gram = sum(np.frombuffer(g) for g in group["gram"])
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in SETS}, "gram": [gram.tobytes()]})

    schema = "cloud_provider string, split string, target string, gram binary"
    parts = rows.select("cloud_provider", "split", *[F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)],
                        *[F.col(f"label_{t}").cast("double").alias(f"y{i}") for i, t in enumerate(targets)]).mapInArrow(partial, schema)
    some = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE))).groupBy(*SETS, "part").applyInPandas(lambda g: total(g), schema)
    whole = some.groupBy(*SETS).applyInPandas(lambda g: total(g), schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(g.as_py()) for g in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array([round(g[0]) for g in grams], pa.int64()),
                                              pa.array([g.tolist() for g in grams], pa.list_(pa.float64()))], names=[*SETS, "n", "gram"])

    return whole.mapInArrow(listed, f"cloud_provider string, split string, target string, n long, gram array<double>").withColumn("width", F.lit(width))


def _doubles(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def mean_products(found: DataFrame, names: list[str]) -> DataFrame:
    """The matrices as rows: for each set the mean product of every two of intercept, features and label (`a` not after `b`)."""
    all_names = F.array(*[F.lit(n) for n in ("1", *names, "label")])
    width = len(names) + 2
    cells = F.posexplode("gram").alias("at", "value")
    rows = found.select(*SETS, "n", cells).withColumn("i", F.floor(F.col("at") / width).cast("int")).withColumn("j", (F.col("at") % width).cast("int"))
    return rows.where("i <= j").select(*SETS, F.get(all_names, F.col("i")).alias("a"), F.get(all_names, F.col("j")).alias("b"),
                                       (F.col("value") / F.col("n")).alias("mean_product"))


@dataclass(frozen=True)
class Moments:
    """Moments of one set: number of rows, means and (population) covariances of features and label."""

    n: float
    means: np.ndarray
    cov: np.ndarray

    @staticmethod
    def of(gram: list[float] | np.ndarray) -> Moments:
        width = round(len(gram) ** 0.5)
        g = np.asarray(gram, float).reshape(width, width)
        n = g[0, 0]
        means = g[0, 1:] / n
        return Moments(n, means, g[1:, 1:] / n - np.outer(means, means))

    def squared_error(self, coefficients: np.ndarray, intercept: float) -> float:
        """Mean squared error of a line over this set."""
        line = np.append(-coefficients, 1.0)
        bias = self.means @ line - intercept
        return float(max(line @ self.cov @ line, 0.0) + bias * bias)


def fit(moments_: Moments, penalty: float, mix: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise error / 2 + penalty * (mix * |b| + (1 - mix) / 2 * b²) on standardised columns.

    Constant columns get coefficient 0; a constant label has no coefficients. Of the dependent columns of an unpenalised
    fit the shortest solution is taken.
    """
    p = len(moments_.means) - 1
    spread = np.sqrt(np.maximum(np.diag(moments_.cov), 0.0))
    used = np.flatnonzero(spread[:p] > 1e-12 * np.maximum(1.0, np.abs(moments_.means[:p])))
    coefficients = np.zeros(p)
    if spread[p] > 0 and len(used):
        r = moments_.cov[np.ix_(used, used)] / np.outer(spread[used], spread[used])
        q = moments_.cov[used, p] / (spread[used] * spread[p])
        strength = penalty / spread[p]
        b = _ridge(r, q, strength * (1 - mix)) if penalty == 0 or mix == 0 else _signed(r, q, strength * mix, strength * (1 - mix))
        coefficients[used] = b * spread[p] / spread[used]
    return coefficients, float(moments_.means[p] - coefficients @ moments_.means[:p])


def _ridge(r: np.ndarray, q: np.ndarray, l2: float) -> np.ndarray:
    full = r + l2 * np.eye(len(r))
    try:
        lower = np.linalg.cholesky(full)
        if np.diag(lower).min() > 1e-6:
            return np.linalg.solve(lower.T, np.linalg.solve(lower, q))
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(full, q, rcond=1e-10)[0]


def _signed(r: np.ndarray, q: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Exact minimum with an absolute penalty, by feature-sign search: a set of columns with the signs of their coefficients is
    kept, and for given signs the minimum is a linear system. The column that the conditions of a minimum are violated most by
    comes in; a column whose coefficient would change its sign on the way to the solution goes out. Every step lowers the
    error, so no set comes twice, however alike the columns are."""
    p = len(q)
    full = r + (l2 + 1e-12) * np.eye(p)
    b, sign, blocked = np.zeros(p), np.zeros(p), np.zeros(p, bool)
    for _ in range(50 * p):
        slope = q - full @ b
        open_ = (sign == 0) & ~blocked
        if not open_.any():
            break
        j = int(np.argmax(np.where(open_, np.abs(slope), -1.0)))
        if abs(slope[j]) <= l1 * (1 + 1e-10) + 1e-12:
            break
        sign[j] = np.sign(slope[j])
        blocked[:] = False
        while sign.any():
            at = np.flatnonzero(sign)
            x = np.linalg.solve(full[np.ix_(at, at)], q[at] - l1 * sign[at])
            turned = np.flatnonzero(x * sign[at] <= 0)
            if not len(turned):
                b[at] = x
                break
            share = np.array([b[at[i]] / (b[at[i]] - x[i]) if b[at[i]] != x[i] else 0.0 for i in turned])
            least = share.min()
            b[at] += least * (x - b[at])
            out = at[turned[share <= least]]
            blocked[out[b[out] == 0]] = least == 0.0  # came in and would go back at once: a tie within rounding
            b[out] = sign[out] = 0.0
    return b


def mllib_model(spark: SparkSession, coefficients: np.ndarray, intercept: float):
    """The line as a model of Spark MLlib, so that it is saved, loaded and applied like its other models."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.common import _py2java
    from pyspark.ml.regression import LinearRegressionModel

    jvm = spark._jvm.org.apache.spark.ml
    uid = jvm.util.Identifiable.randomUID("linReg")
    made = jvm.regression.LinearRegressionModel(uid, _py2java(spark.sparkContext, Vectors.dense(coefficients)), float(intercept), 1.0)
    return LinearRegressionModel(made)
