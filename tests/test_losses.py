import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from molweave.functions import vectors as X
from molweave.operators import labels as L
from molweave.operators import losses as O

LOGITS = [[1.0, 2.0, -1.0], [0.5, 0.5, 0.5], [1000.0, 0.0, -1000.0], [-3.0, 4.0, 0.0]]
LABELS = [0, 2, 0, -100]


def nll(x, y):
    x = np.array(x)
    return float(np.log(np.exp(x - x.max()).sum()) + x.max() - x[y])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(zip(LOGITS, LABELS)), "logits array<double>, label int")


def value(df, column="loss"):
    return df.first()[column]


@pytest.mark.parametrize("k", [None, 3])
def test_softmax_forms(rows, k):
    for r in rows.select("logits", X.softmax(F.col("logits"), k).alias("p")).collect():
        e = np.exp(np.array(r.logits) - max(r.logits))
        assert r.p == pytest.approx((e / e.sum()).tolist())


def test_two_labels_and_argmax(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 3.0],), ([1000.0, -1000.0],)], "l array<double>")
    p = [r.p for r in df.select(X.positive_probability(F.col("l")).alias("p")).collect()]
    assert p == pytest.approx([0.5, 1 / (1 + math.exp(-2)), 0.0])
    assert [r.i for r in df.select(X.argmax(F.col("l")).alias("i")).collect()] == [0, 1, 0]
    with pytest.raises(ValueError):
        X.prediction_score(F.col("l"), 3)


@pytest.mark.parametrize("k", [None, 3])
def test_cross_entropy_ignores_negative_labels(rows, k):
    expected = np.mean([nll(x, y) for x, y in zip(LOGITS, LABELS) if y >= 0])
    r = O.token_cross_entropy(rows, num_labels=k).first()
    assert r.loss == pytest.approx(expected) and r.n == 3
    assert value(O.labelled_cross_entropy(rows, num_labels=k)) == pytest.approx(expected)


def test_no_labelled_row(rows):
    none = rows.withColumn("label", F.lit(-100))
    assert value(O.token_cross_entropy(none, num_labels=3)) is None
    assert value(O.labelled_cross_entropy(none, num_labels=3)) == 0.0


def test_weighted_cross_entropy(spark):
    pairs = [([1.0, 0.0], 0), ([0.0, 2.0], 1), ([0.3, 0.1], 1), ([0.2, 0.9], 1)]
    df = spark.createDataFrame(pairs, "logits array<double>, target int")
    w = {0: 4 / 2, 1: 4 / 6}
    expected = sum(w[y] * nll(x, y) for x, y in pairs) / sum(w[y] for _, y in pairs)
    assert value(O.weighted_cross_entropy(df, L.class_weights(df), num_labels=2)) == pytest.approx(expected)


def test_bce(spark):
    df = spark.createDataFrame([(1000.0, 0, 1), (-1000.0, 0, 1), (0.0, 0, 0)], "logit double, label int, keep int")
    assert value(O.bce_loss(df)) == pytest.approx((1000 + math.log(2)) / 3)
    r = O.bce_loss(df, active=F.col("keep") == 1).first()
    assert r.loss == pytest.approx(500) and r.n == 2


def test_multilabel_and_soft_labels(spark):
    df = spark.createDataFrame([([0.0, 1.0], [1, 0]), ([2.0, -1.0], [1, 1])], "logits array<double>, targets array<int>")
    cells = [(0.0, 1), (1.0, 0), (2.0, 1), (-1.0, 1)]
    expected = np.mean([max(x, 0) - x * y + math.log1p(math.exp(-abs(x))) for x, y in cells])
    assert value(O.multilabel_bce(df, 2)) == pytest.approx(expected)
    soft = spark.createDataFrame([([1.0, 2.0], [0.25, 0.75])], "logits array<double>, targets array<double>")
    expected = 0.25 * nll([1, 2], 0) + 0.75 * nll([1, 2], 1)
    for k in (None, 2):
        assert value(O.soft_label_loss(soft, num_labels=k)) == pytest.approx(expected)


def test_mse_of_several_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 0.0), (3.0, 3.0, 1.0, 4.0)], "a double, b double, c double, d double")
    assert value(O.mse_loss(df, [("a", "b")])) == 0.5
    assert value(O.mse_loss(df, [("a", "b"), ("c", "d")])) == pytest.approx((1 + 0 + 0 + 9) / 4)


def test_classifier_loss_follows_the_problem(spark):
    df = spark.createDataFrame([([1.0], 3.0)], "logits array<double>, target double")
    assert value(O.classifier_loss(df, 1, False)) == 4.0
    df = spark.createDataFrame([([1.0, 0.0], 0)], "logits array<double>, target int")
    assert value(O.classifier_loss(df, 2, True)) == pytest.approx(nll([1, 0], 0))
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "logits array<double>, target array<double>")
    assert value(O.classifier_loss(df, 2, False)) == pytest.approx(math.log(2))


def test_sign_prediction_takes_zero_as_original(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.1,)], "x double")
    assert [r.p for r in df.select(X.sign_prediction(F.col("x")).alias("p")).collect()] == [0, 0, 1]


def test_rtd_losses_per_batch(spark):
    rows = [
        # batch, nll, logit, label, masked, token
        (0, 2.0, 1.0, 1, True, 7),
        (0, 4.0, -1.0, 1, True, 8),
        (0, None, -2.0, 0, False, 9),
        (0, None, 5.0, 0, False, 3),
        (1, None, 0.0, 0, False, 6),
    ]
    df = spark.createDataFrame(rows, "batch_id int, nll double, disc_logit double, disc_label int, masked boolean, token_id int")
    got = {r.batch_id: r for r in O.rtd_losses(df).collect()}
    bce = lambda x, y: max(x, 0) - x * y + math.log1p(math.exp(-abs(x)))
    disc = np.mean([bce(1, 1), bce(-1, 1), bce(-2, 0)])
    assert got[0].mlm_loss == 3.0 and got[0].disc_loss == pytest.approx(disc)
    assert got[0].loss == pytest.approx(3.0 + 50 * disc)
    # Padding counts among the unmasked positions.
    assert got[0].disc_acc == pytest.approx(0.5 * 0.5 + 0.5 * 0.5)
    assert got[1].mlm_loss is None and got[1].loss is None and got[1].disc_loss == pytest.approx(math.log(2))


def test_generator_accuracy(spark):
    df = spark.createDataFrame(
        [([0.0, 1.0], 1, True), ([3.0, 1.0], 1, True), ([0.0, 9.0], -100, False)], "logits array<double>, mlm_label int, masked boolean"
    )
    assert value(O.generator_accuracy(df), "gen_acc") == 0.5


def test_weights_meet_classes_not_rows(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0)], "logits array<double>, target int")
    plan = O.weighted_cross_entropy(df, L.class_weights(df), num_labels=2)._jdf.queryExecution().executedPlan().toString()
    # The aggregate over rows is below the join.
    assert plan.index("Join") < plan.index("partial_sum(CASE WHEN")


def test_a_label_outside_the_logits_is_an_error(spark):
    df = spark.createDataFrame([([0.0, 1.0], 0), ([0.0, 1.0], 7)], "logits array<double>, label int")
    for loss in (O.token_cross_entropy, O.labelled_cross_entropy):
        with pytest.raises(Exception, match="label outside the logits"):
            loss(df).collect()
    with pytest.raises(Exception, match="label outside the logits"):
        O.token_cross_entropy(df.withColumn("label", F.lit(-5))).collect()
    assert O.token_cross_entropy(df.withColumn("label", F.lit(-100))).first().n == 0


def test_a_class_without_a_weight_is_an_error(spark):
    df = spark.createDataFrame([([0.0, 1.0], 0), ([0.0, 1.0], 1)], "logits array<double>, target int")
    with pytest.raises(Exception, match="no weight for class 1"):
        O.weighted_cross_entropy(df, L.class_weights(df.filter("target = 0")), num_labels=2).collect()


def test_generator_accuracy_joins_the_batch_record(spark):
    rows = [(0, 5, True, True, 1.0, 1, 0.5), (0, 6, True, False, -1.0, 1, 1.5), (0, 7, False, True, -1.0, 0, None)]
    df = spark.createDataFrame(rows, "batch_id int, token_id int, masked boolean, hit boolean, disc_logit double, disc_label int, nll double")
    r = O.rtd_losses(df, hit="hit").first()
    assert (r.gen_acc, r.mlm_loss) == (0.5, 1.0)
