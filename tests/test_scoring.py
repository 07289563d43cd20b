import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from molweave.operators import metrics as M
from molweave.operators import scoring as S


@pytest.mark.parametrize("family", ["electra", "roberta", "regression"])
def test_score_batch_equals_numpy(spark, family):
    rng = np.random.default_rng(0)
    w = {"dense_w": rng.normal(size=(4, 4)), "dense_b": rng.normal(size=4), "out_w": rng.normal(size=(2, 4)), "out_b": rng.normal(size=2)}
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, features array<double>")
    act = {"gelu": np.vectorize(lambda v: 0.5 * v * (1 + math.erf(v / 2**0.5))), "tanh": np.tanh, "relu": lambda v: np.maximum(v, 0)}
    name = S.HEAD_ACTIVATION[family]
    expected = act[name](x @ w["dense_w"].T + w["dense_b"]) @ w["out_w"].T + w["out_b"]
    got = {r.k: r.logits for r in S.score_batch(df, w, name).collect()}
    assert np.allclose([got[i] for i in range(20)], expected, atol=1e-5)


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.2)
        rows.append((i, rng.normal(loc=2.0 * y, size=3).tolist(), y, float(10 + 5 * y + rng.normal() * 0.1)))
    return spark.createDataFrame(rows, "k int, features array<double>, target int, number double").cache()


def test_classifier_learns(separable):
    model = S.fit_classifier(separable.filter("k < 200"))
    scored = S.classifier_predictions(model, separable.filter("k >= 200"))
    from molweave.functions.vectors import positive_probability

    got = {r.name: r.value for r in M.evaluate_predictions(scored.withColumn("pred", positive_probability(F.col("logits"))), "classification", by=()).collect()}
    assert got["roc"] > 0.9


def test_regressor_predicts_the_standardised_target(separable):
    from molweave.operators.labels import standardize

    rows = separable.select("k", F.concat("features", F.array("number")).alias("features"), F.col("number").alias("target"))
    model = S.fit_regressor(rows)
    got = S.regressor_predictions(model, standardize(rows, rows))
    assert M.rmse(got).first()[0] < 1e-3
