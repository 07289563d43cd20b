"""Training by epochs against MLlib fits, its log, the best epoch and patience."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from molweave.operators import runs
from molweave.operators import scoring as S
from molweave.operators import training as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = []
    for i in range(600):
        y = int(rng.random() < 0.3)
        x = rng.normal(loc=[0.8 * y, -0.5 * y, 0.0], scale=[1.0, 3.0, 0.2])
        made.append((i, x.tolist(), y, float(2 * x[0] - x[1] + rng.normal())))
    df = spark.createDataFrame(made, "k long, features array<double>, target int, number double").repartition(3)
    return df.filter("k < 450").cache(), df.filter("k >= 450").cache()


def test_classifier_converges_to_the_mllib_fit(spark, rows):
    train, held = rows
    head, best, log = T.fit_epochs(train, held, "classification", "k", 1, epochs=6, steps=3)
    model = S.fit_classifier(train)
    ours = T.head_predictions(head, train).select("k", F.col("logits")[1] - F.col("logits")[0]).collect()
    theirs = S.classifier_predictions(model, train).select("k", F.col("logits")[1] - F.col("logits")[0]).collect()
    a, b = (np.array([v for _, v in sorted(map(tuple, x))]) for x in (ours, theirs))
    y = np.array([r.target for r in train.orderBy("k").select("target").collect()])
    w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ours, theirs = ((w * np.log1p(np.exp(np.where(y == 1, -m, m)))).mean() for m in (a, b))
    assert theirs - 1e-9 <= ours <= theirs + 0.01 and np.corrcoef(a, b)[0, 1] > 0.99
    stopped = runs.running_best(log.filter("name = 'val_loss'"), {"loss": "minimize"}).filter("improved").agg(F.max("epoch")).first()[0]
    assert stopped == best
    losses = [r.value for r in log.filter("name = 'train_loss'").orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_regressor_converges_and_repeats(rows):
    train, held = (df.withColumn("target", F.col("number")) for df in rows)
    head, _, log = T.fit_epochs(train, held, "regression", "k", 1, epochs=4, steps=3, rate=0.7)
    again, _, _ = T.fit_epochs(train, held, "regression", "k", 1, epochs=4, steps=3, rate=0.7)
    assert np.allclose(head.weights, again.weights)
    model = S.fit_regressor(train)
    ours = head.weights[0, :-1] / head.std
    assert np.allclose(ours, model.coefficients.toArray(), atol=0.05)


def test_patience_and_best_epoch(rows):
    train, held = rows
    # Steps that overshoot more each time: the first epoch is the best one.
    head, best, log = T.fit_epochs(train, held, "classification", "k", 1, epochs=8, steps=1, patience=2, rate=300.0, momentum=1.0)
    epochs = log.filter("name = 'val_loss'").orderBy("epoch").collect()
    assert len(epochs) == best + 3 and min(epochs, key=lambda r: r.value).epoch == best
    stop = runs.early_stop_epoch(log.filter("name = 'val_loss'"), 2, {"loss": "minimize"}).first()
    assert stop.stop_epoch == epochs[-1].epoch


def test_no_validation_rows_and_unknown_classes(rows):
    train, held = rows
    head, best, log = T.fit_epochs(train, held.limit(0), "classification", "k", 1, epochs=2, steps=2)
    assert best >= 0 and log.filter("isnan(value)").count() == 2
    with pytest.raises(Exception, match="does not have"):
        T.fit_epochs(train, held.withColumn("target", F.lit(7)), "classification", "k", 1, epochs=1, steps=1)
    with pytest.raises(ValueError):
        T.fit_epochs(train, held, "other", "k", 1, epochs=1, steps=1)
