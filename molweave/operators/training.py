"""Heads trained epoch by epoch, with validation after each, the best epoch kept and patience.

A step is one aggregation over a mini-batch: Arrow batches give partial gradients, Spark adds them on the map side, and only a
vector of the head's width reaches the driver, which moves the weights. A row's mini-batch is a hash of (seed, epoch, key), so a
retried step sees the same rows and every epoch has a new order. The log has one row per (run, epoch, split, name), as
``running_best`` and ``early_stop_epoch`` read it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import uniform
from molweave.operators.labels import attach_weights, class_weights, standardize

LOG = "run string, epoch int, split string, name string, value double"


@dataclass
class Head:
    """A linear head on standardised features; ``kind`` is classification (one output per class) or regression (one output)."""

    kind: str
    weights: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def outputs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        return np.concatenate([z, np.ones((len(z), 1))], axis=1) @ self.weights.T


def head_predictions(head: Head, df: DataFrame, features="features", out="logits") -> DataFrame:
    """Add the outputs of a head, one Arrow batch at a time."""
    kind, parts = head.kind, (head.weights, head.mean, head.std)

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        width = len(parts[1])
        got = Head(kind, *parts).outputs(x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
        return pa.FixedSizeListArray.from_arrays(pa.array(got.ravel()), got.shape[1]).cast(pa.list_(pa.float64()))

    return df.withColumn(out, run(F.col(features)))


def _moments(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every feature; a feature that doesn't vary is only centred."""
    got = train.select(Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("s")).first().s
    std = np.asarray(got.std)
    return np.asarray(got.mean), np.where(std > 0, std, 1.0)


def _sums(rows: DataFrame, head: Head) -> tuple[np.ndarray, float]:
    """(gradient of the weighted mean loss, that loss) over rows of (x, y, w); a class without a weight, or a null target, is an error."""
    kind, parts = head.kind, (head.weights, head.mean, head.std)

    def partial(batches):
        weights, mean, std = parts
        total = np.zeros(weights.size + 2)
        for batch in batches:
            x, y, w = (batch.column(c) for c in ("x", "y", "w"))
            if y.null_count or w.null_count:
                raise ValueError("a row has no target, or a class that the train split does not have")
            y, w = y.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)
            z = (x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean) / std
            z = np.concatenate([z, np.ones((len(z), 1))], axis=1)
            out = z @ weights.T
            if kind == "classification":
                out = out - out.max(axis=1, keepdims=True)
                p = np.exp(out)
                p /= p.sum(axis=1, keepdims=True)
                hot = y.astype(int)
                loss = -np.log(np.maximum(p[np.arange(len(hot)), hot], 1e-300))
                p[np.arange(len(hot)), hot] -= 1
                error = p
            else:
                error = out - y[:, None]
                loss = 0.5 * error[:, 0] ** 2
            total[:-2] += ((error * w[:, None]).T @ z).ravel()
            total[-2] += (w * loss).sum()
            total[-1] += w.sum()
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    made = rows.select("x", "y", "w").mapInArrow(partial, "g array<double>")
    summed = made.select(F.posexplode("g").alias("place", "part")).groupBy("place").agg(F.sum("part").alias("whole"))
    total = np.zeros(head.weights.size + 2)
    for r in summed.collect():
        total[r.place] = r.whole
    if not total[-1]:
        return np.zeros_like(head.weights), float("nan")
    return (total[:-2] / total[-1]).reshape(head.weights.shape), float(total[-2] / total[-1])


def fit_epochs(
    train: DataFrame,
    validation: DataFrame,
    kind: str,
    key: str,
    seed,
    epochs: int,
    steps: int,
    patience: int | None = None,
    rate: float = 1.0,
    momentum: float = 0.5,
    features="features",
    target="target",
    run="run",
) -> tuple[Head, int, DataFrame]:
    """(head of the best epoch, that epoch, the log of train_loss and val_loss).

    ``train`` and ``validation`` are written tables, since every step reads one. Classes are 0, 1, ... with balanced weights of the
    train split; a regression target is standardised by it. An epoch is ``steps`` mini-batches, then a pass over ``validation``;
    the rate falls with the root of the epoch. The best epoch has the smallest validation loss, the first one on ties. After ``patience`` epochs without a better one training ends;
    0 or None never stops. Without validation rows the loss of the last step decides.
    """
    if kind not in ("classification", "regression"):
        raise ValueError(f"unknown kind {kind!r}")
    spark = train.sparkSession
    x = F.col(features).cast("array<double>").alias("x")

    def rows(df: DataFrame) -> DataFrame:
        if kind == "classification":
            weighted = attach_weights(df, class_weights(train, target), target, "w")
            return weighted.select(F.col(key).alias("k"), x, F.col(target).cast("double").alias("y"), "w")
        return standardize(df, train, target, out="_y").select(F.col(key).alias("k"), x, F.col("_y").alias("y"), F.lit(1.0).alias("w"))

    seen, held = rows(train), rows(validation)
    mean, std = _moments(seen)
    outputs = 1 if kind == "regression" else int(train.agg(F.max(target)).first()[0]) + 1
    head = Head(kind, np.zeros((outputs, len(mean) + 1)), mean, std)
    speed = np.zeros_like(head.weights)
    best, best_loss, best_epoch, log = head.weights, float("inf"), -1, []
    for epoch in range(epochs):
        losses = []
        place = F.floor(uniform(f"{seed}:{epoch}", "k") * steps)
        for step in range(steps):
            gradient, loss = _sums(seen.filter(place == step), head)
            speed = momentum * speed - rate / (1 + epoch) ** 0.5 * gradient
            head.weights = head.weights + speed
            losses.append(loss)
        _, val_loss = _sums(held, head)
        log += [(run, epoch, "train", "train_loss", float(np.nanmean(losses))), (run, epoch, "validation", "val_loss", val_loss)]
        judged = losses[-1] if np.isnan(val_loss) else val_loss
        if judged < best_loss:
            best, best_loss, best_epoch = head.weights, judged, epoch
        if patience and epoch - best_epoch >= patience:
            break
    return Head(kind, best, mean, std), best_epoch, spark.createDataFrame(log, LOG)
