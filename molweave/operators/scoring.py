"""Inference with a trained head, and simple heads fitted with MLlib."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.operators.labels import attach_weights, class_weights, standardize


def _erf(x: np.ndarray) -> np.ndarray:
    """Rational approximation of the error function, off by at most 1.5e-7."""
    # Abramowitz and Stegun, formula 7.1.26.
    a = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    tail = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t * np.exp(-x * x)
    return np.sign(x) * (1.0 - tail)


ACTIVATIONS = {
    "gelu": lambda x: 0.5 * x * (1.0 + _erf(x / np.sqrt(2.0))),
    "tanh": np.tanh,
    "relu": lambda x: np.maximum(x, 0.0),
}
# Head of each model family.
HEAD_ACTIVATION = {"electra": "gelu", "roberta": "tanh", "regression": "relu"}
BATCH_SIZE = 1024


def score_head(spark: SparkSession, weights: dict[str, np.ndarray], activation: str):
    """Batch function features -> logits: dense, activation, projection. No dropout at inference.

    ``weights`` has dense_w, dense_b, out_w and out_b; the arrays are shipped once per executor, and their type is the
    type of the logits.
    """
    act = ACTIVATIONS[activation]
    width = weights["dense_w"].shape[1]
    out_type = T.DoubleType() if weights["out_w"].dtype == np.float64 else T.FloatType()
    shipped = spark.sparkContext.broadcast(weights)

    def make():
        w = shipped.value

        def predict(features: np.ndarray) -> np.ndarray:
            return act(features @ w["dense_w"].T + w["dense_b"]) @ w["out_w"].T + w["out_b"]

        return predict

    return predict_batch_udf(
        make, return_type=T.ArrayType(out_type), batch_size=BATCH_SIZE, input_tensor_shapes=[[width]]
    )


def score_batch(df: DataFrame, weights: dict[str, np.ndarray], activation: str, features="features", out="logits") -> DataFrame:
    return df.withColumn(out, score_head(df.sparkSession, weights, activation)(F.col(features)))


def _vector(features: str) -> Column:
    return array_to_vector(F.col(features).cast("array<double>"))


def _converged(model, max_iter: int):
    """The model; a fit that used all its steps has not converged and is an error."""
    if model.hasSummary and model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the fit did not converge in {max_iter} steps")
    return model


def fit_classifier(
    train: DataFrame, features="features", target="target", max_iter: int = 200, tolerance: float = 1e-9
) -> LogisticRegressionModel:
    """Logistic head with balanced class weights."""
    weighted = attach_weights(train, class_weights(train, target), target, "w")
    rows = weighted.select(_vector(features).alias("x"), F.col(target).cast("double").alias("y"), "w")
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=max_iter, tol=tolerance)
    return _converged(fit.fit(rows), max_iter)


def classifier_predictions(model: LogisticRegressionModel, df: DataFrame, features="features") -> DataFrame:
    """Add logits as an array, whose softmax are the fitted probabilities.

    With two classes MLlib gives the margin with both signs, which is twice the distance of the logits.
    """
    scored = model.transform(df.withColumn("x", _vector(features)))
    scale = 0.5 if model.numClasses == 2 else 1.0
    logits = F.transform(vector_to_array("rawPrediction"), lambda x: x * scale)
    return scored.withColumn("logits", logits).drop("x", "rawPrediction", "probability", "prediction")


def fit_regressor(train: DataFrame, features="features", target="target", max_iter: int = 200) -> LinearRegressionModel:
    """Linear head on the standardised target; a null target, or one without spread, is an error."""
    missing = F.raise_error(F.lit("the target is null or does not vary")).cast("double")
    scaled = standardize(train, train, target, out="y")
    rows = scaled.select(_vector(features).alias("x"), F.coalesce("y", missing).alias("y"))
    return _converged(LinearRegression(featuresCol="x", labelCol="y", maxIter=max_iter).fit(rows), max_iter)


def regressor_predictions(model: LinearRegressionModel, df: DataFrame, features="features") -> DataFrame:
    return model.transform(df.withColumn("x", _vector(features))).withColumnRenamed("prediction", "pred").drop("x")

