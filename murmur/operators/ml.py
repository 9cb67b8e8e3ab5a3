"""M1-M6: chronological-split regressors with Spark ML, and their evaluation.

The label (Amihud illiquidity, ~1e-10 on real data) is multiplied by ``label_scale``
before fitting and divided after, so tree impurity gains do not underflow; ``scale=1``
reproduces the original. Least squares (M2) is one aggregation: the covariances of all columns, from which the
driver solves a system as large as the number of features; trees are Spark ML's.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from murmur import config
from murmur.operators.stats import regression_metrics, unpivot
from murmur.operators.timeseries import chronological_split
from murmur.session import default_parallelism

MODEL_NAMES = {"linear_regression": "Linear Regression", "random_forest": "Random Forest",
               "gbt": "Gradient Boosted Trees"}


@dataclass(frozen=True)
class LeastSquares:
    """``intercept + sum(coefficient * column)``; ``rows`` took part in the fit, ``r2`` is None for a constant label."""

    intercept: float | None
    coefficients: dict[str, float]
    rows: int
    r2: float | None

    def predict(self) -> Column:
        terms = [F.lit(b) * F.col(c) for c, b in self.coefficients.items() if b]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept).cast("double"))


def least_squares(df: DataFrame, columns: list[str], label: str) -> LeastSquares:
    """M2: ordinary least squares from the normal equations. One aggregation over ``df`` gives the Gram matrix of the
    centred columns (means and covariances, merged across tasks without cancellation): (k + 1)(k + 2) / 2 numbers
    whatever the rows. Rows with a NULL among the columns take no part. The system is solved in
    correlations; a constant column gets 0, and of columns that determine each other the solution of least norm is taken."""
    names = [*columns, label]
    rows = df.select(*(F.col(c).cast("double").alias(str(i)) for i, c in enumerate(names))).na.drop()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(F.count(F.lit(1)), *(F.avg(str(i)) for i in range(len(names))), *(F.covar_pop(str(i), str(j)) for i, j in pairs)).first()
    n, means = got[0], got[1 : 1 + len(names)]
    if not n:
        return LeastSquares(None, dict.fromkeys(columns, 0.0), 0, None)
    gram = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, got[1 + len(names):], strict=True):
        gram[i, j] = gram[j, i] = v
    scale = np.sqrt(np.diag(gram))
    # a spread that is rounding of the column's mean is no spread
    used = [i for i in range(len(columns)) if scale[i] > 1e-14 * abs(means[i])]
    beta = np.zeros(len(columns))
    if used and scale[-1] > 0:
        corr = gram[np.ix_([*used, -1], [*used, -1])] / np.outer(scale[[*used, -1]], scale[[*used, -1]])
        solved = np.linalg.lstsq(corr[:-1, :-1], corr[:-1, -1], rcond=1e-12)[0]
        beta[used] = solved * scale[-1] / scale[used]
    r2 = float(beta @ gram[:-1, -1] / gram[-1, -1]) if scale[-1] > 0 else None
    return LeastSquares(float(means[-1] - beta @ np.array(means[:-1])), dict(zip(columns, map(float, beta))), n, r2)


def model_predictions(features: DataFrame, feature_cols: list[str] | None = None, label: str = "illiquidity",
                      keys=("symbol", "date"), test_fraction: float = config.TEST_FRACTION,
                      label_scale: float = 1e9, lagged_only: bool = False,
                      rf_trees: int = config.RF_TREES, rf_depth: int = config.RF_DEPTH,
                      gbt_rounds: int = config.GBT_ROUNDS, gbt_step: float = config.GBT_STEP,
                      gbt_depth: int = config.GBT_DEPTH, seed: int = config.MODEL_SEED,
                      models=("linear_regression", "random_forest", "gbt"), parallelism: int = 3) -> DataFrame:
    """M1-M6: fit on the first 80 % of each series, predict the last 20 %.
    Returns ``(*keys, actual, <model>...)`` for the test rows."""
    keys = list(keys)
    cols = [c for c in (feature_cols or config.MODEL_FEATURES) if c in features.columns]
    if lagged_only:
        cols = [c for c in cols if c not in ("return", "volume")]
    split = chronological_split(features, [k for k in keys if k != "date"] or keys[:1], "date", test_fraction)
    # the iterative learners launch jobs per round over the cached frame: give it one
    # partition per core, not the shuffle partitioning left by the feature windows
    data = (split.select(*keys, "is_test", *[F.col(c).cast("double").alias(c) for c in cols],
                         (F.col(label) * F.lit(label_scale)).alias("_y"))
            .na.drop().repartition(default_parallelism(features.sparkSession)).cache())
    train = data.where(~F.col("is_test"))
    test = data.where(F.col("is_test"))
    va_all = VectorAssembler(inputCols=cols, outputCol="_f")

    def fit(name):
        if name == "linear_regression":
            return least_squares(train, cols, "_y")
        if name == "random_forest":
            est = RandomForestRegressor(featuresCol="_f", labelCol="_y", predictionCol=name,
                                        numTrees=rf_trees, maxDepth=rf_depth, seed=seed,
                                        featureSubsetStrategy="all")
        else:
            est = GBTRegressor(featuresCol="_f", labelCol="_y", predictionCol=name, maxIter=gbt_rounds,
                               stepSize=gbt_step, maxDepth=gbt_depth, seed=seed)
        return va_all, est.fit(va_all.transform(train))

    # the three fits are independent: run them concurrently (as CrossValidator's
    # `parallelism` does) so their per-round job overheads overlap
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(models)))) as pool:
        fitted = dict(zip(models, pool.map(fit, models)))
    out = test
    for name in models:
        if isinstance(fitted[name], LeastSquares):
            out = out.withColumn(name, fitted[name].predict())
            continue
        va, model = fitted[name]
        out = model.transform(va.transform(out)).drop(va.getOutputCol())
    scale = F.lit(label_scale)
    return out.select(*keys, (F.col("_y") / scale).alias("actual"),
                      *[(F.col(m) / scale).alias(m) for m in models])


def model_results(predictions: DataFrame, models=("linear_regression", "random_forest", "gbt")) -> DataFrame:
    """One row per model with MAE, RMSE and R^2 on the test rows."""
    long = unpivot(predictions.select("actual", *models), list(models), "model", "prediction", keep=["actual"])
    return regression_metrics(long, "actual", "prediction", ["model"])
