"""Least squares from one aggregation, and models that are loaded once per worker."""

import os
import uuid

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from murmur.operators import ml, scoring


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{n} double" for n in [*names, "y"])).repartition(5), names


def test_least_squares_of_fourteen_features_agrees_with_spark_ml_and_numpy(spark):
    r = np.random.default_rng(1)
    x = (r.normal(size=(400, 14)) + 2) * 10.0 ** r.integers(-3, 6, 14)
    y = x @ (r.normal(size=14) / x.std(0)) + 3 + r.normal(size=400)
    df, names = frame(spark, x, y)
    fit = ml.least_squares(df, names, "y")
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    assert np.allclose([fit.intercept, *fit.coefficients.values()], want, rtol=1e-6)
    data = VectorAssembler(inputCols=names, outputCol="f").transform(df)
    other = LinearRegression(featuresCol="f", labelCol="y", solver="normal", standardization=False).fit(data)
    assert np.allclose(list(fit.coefficients.values()), other.coefficients.toArray(), rtol=1e-6)
    assert abs(fit.r2 - other.summary.r2) < 1e-9 and fit.rows == 400
    got = df.select(F.max(F.abs(fit.predict() - F.col("y")))).first()[0]
    assert abs(got - np.abs(np.c_[np.ones(400), x] @ want - y).max()) < 1e-6


def test_least_squares_of_constant_equal_missing_and_no_rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 2))
    x = np.c_[x, np.full(60, 1e6 + 0.1), x[:, 0]]  # a constant column and one that equals the first
    y = 4 * x[:, 0] - x[:, 1] + 7
    df, names = frame(spark, x, y)
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1e9)], df.schema))
    fit = ml.least_squares(df, names, "y")
    assert fit.rows == 60 and fit.coefficients["x2"] == 0 and abs(fit.r2 - 1) < 1e-9
    assert np.allclose([fit.coefficients["x0"] + fit.coefficients["x3"], fit.coefficients["x1"], fit.intercept], [4, -1, 7])
    flat = ml.least_squares(df.withColumn("y", F.lit(5.0)), names, "y")
    assert flat.r2 is None and flat.intercept == 5 and not any(flat.coefficients.values())
    none = ml.least_squares(df.where("false"), names, "y")
    assert none.rows == 0 and df.select(none.predict()).first()[0] is None


def counting(folder, scale):
    def factory():
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: [{"positive": len(t) * scale, "negative": 0.0} for t in texts]
    return factory


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    df = spark.range(48).selectExpr("id", "cast(id as string) text").repartition(24, "id")
    factory = counting(str(tmp_path), 1.0)
    for _ in range(3):
        got = scoring.probability_scores(df, ["id"], "text", factory, "s")
        assert {r["s"] for r in got.collect()} == {1.0, 2.0}
    loads = os.listdir(tmp_path)
    workers = {n.partition("-")[0] for n in loads}
    assert len(loads) == len(workers) < 24  # 72 tasks with rows
    other = scoring.probability_scores(df, ["id"], "text", counting(str(tmp_path), 2.0), "s")
    assert {r["s"] for r in other.collect()} == {2.0, 4.0}  # another factory is another model


def test_a_failed_load_is_tried_again(spark, tmp_path):
    def factory():
        if not os.path.exists(f"{tmp_path}/ready"):
            raise RuntimeError("not there yet")
        return lambda texts: [{"positive": 1.0} for _ in texts]

    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match="not there yet"):
        scoring.probability_scores(df, ["id"], "text", factory, "s").collect()
    open(f"{tmp_path}/ready", "w").close()
    assert scoring.probability_scores(df, ["id"], "text", factory, "s").first()["s"] == 1.0


def test_a_worker_keeps_few_models():
    scoring._LOADED.clear()
    for i in range(10):
        scoring._load((str(i), lambda: object()))
        kept = scoring._load(("0", lambda: object())) if i == 0 else scoring._LOADED.get("0")
    assert len(scoring._LOADED) == scoring.MODELS_KEPT and kept is None
    scoring._LOADED.clear()
