import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from molweave.operators import metrics as M


def table(spark, rows):
    return spark.createDataFrame([(float(p), float(t)) for p, t in rows], "pred double, target double")


def area(rows):
    pos = [p for p, t in rows if t == 1]
    neg = [p for p, t in rows if t == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])


def test_rmse_and_pearson(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=50), rng.normal(size=50)
    df = table(spark, zip(x, y))
    assert M.rmse(df).first()[0] == pytest.approx(np.sqrt(np.mean((x - y) ** 2)))
    assert M.pearsonr(df).first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert M.pearsonr(table(spark, [(1, 2), (1, 3)])).first()[0] is None


def test_precision(spark):
    assert M.precision(table(spark, [(0.9, 1), (0.6, 0), (0.5, 0), (0.1, 1)])).first()[0] == 0.5
    assert M.precision(table(spark, [(0.5, 1), (0.2, 0)])).first()[0] == 0.0


@pytest.mark.parametrize("ties", [True, False])
def test_auroc_is_exact(spark, ties):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, 300) if ties else rng.normal(size=300)
    rows = [(s, int(rng.random() < 0.3)) for s in scores]
    df = table(spark, rows).repartition(5)
    got = M.auroc(df).first().roc
    assert got == pytest.approx(area(rows), abs=1e-12)
    flipped = M.auroc(df.withColumn("pred", -F.col("pred"))).first().roc
    assert got + flipped == pytest.approx(1.0)


def test_auroc_edges(spark):
    assert M.auroc(table(spark, [(0.1, 1), (0.9, 1)])).first().roc is None
    assert M.auroc(table(spark, [(0.5, 1), (0.5, 0), (0.5, 0)])).first().roc == 0.5


def test_auroc_with_a_hot_score_and_group(spark):
    # One group holds most rows, and a third of its rows share a score.
    rng = np.random.default_rng(5)
    rows = [("hot", 0.5 if i % 3 == 0 else rng.random(), int(rng.random() < 0.4)) for i in range(3000)]
    rows += [("cold", rng.random(), i % 2) for i in range(40)]
    df = spark.createDataFrame([(g, float(s), t) for g, s, t in rows], "g string, pred double, target int")
    got = {r.g: r.roc for r in M.auroc(df, by=["g"]).collect()}
    for g in got:
        assert got[g] == pytest.approx(area([(s, t) for h, s, t in rows if h == g]), abs=1e-12)


def test_batch_mean_differs_from_row_mean(spark):
    rows = [(1, 0, "train", b, float(b == 2)) for b, n in ((0, 32), (1, 32), (2, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "run int, epoch int, split string, batch_id int, loss double")
    r = M.batch_mean_loss(df).first()
    assert r.loss == pytest.approx(1 / 3) and r.n_batches == 3
    assert df.agg(F.avg("loss")).first()[0] == pytest.approx(1 / 65)


def test_mae_averages_runs(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 1.0), (2, 0.0, 4.0)], "run int, pred double, target double")
    assert M.mae(df).first().mae_mean == 2.5


def test_evaluate_by_problem(spark):
    df = table(spark, [(0.9, 1), (0.2, 0), (0.7, 0), (0.3, 1)])
    got = {r.name: r.value for r in M.evaluate_predictions(df, "classification", by=()).collect()}
    assert got == {"precision": 0.5, "roc": pytest.approx(0.75)}
    assert {r.name for r in M.evaluate_predictions(df, "regression", by=()).collect()} == {"rmse", "pearsonr"}
    with pytest.raises(ValueError):
        M.evaluate_predictions(df, "ranking")


def test_epoch_metrics_and_format(spark):
    rows = [(1, e, s, 0, 2.0, 1.0, 1.0 + e) for e in (0, 1) for s in ("train", "validation")]
    df = spark.createDataFrame(rows, "run int, epoch int, split string, batch_id int, loss double, pred double, target double")
    got = M.epoch_metrics(df, "regression", {"train": "train", "validation": "val"})
    assert {(r.epoch, r.name): r.value for r in got.collect()}[(1, "val_rmse")] == 1.0
    lines = M.format_metrics(got.filter("name like 'val%' and value is not null").withColumn("split", F.lit("val")), ["run", "epoch", "split"])
    assert {r.line for r in lines.collect()} == {
        "[val] epoch 0 val_loss: 2.0000 val_rmse: 0.0000",
        "[val] epoch 1 val_loss: 2.0000 val_rmse: 1.0000",
    }


def test_nan_scores_are_errors(spark):
    df = table(spark, [(float("nan"), 0), (0.9, 1), (0.2, 0)])
    for metric in (M.precision, M.auroc):
        with pytest.raises(Exception, match="a score is NaN"):
            metric(df).collect()


def test_epoch_metrics_read_their_table_once(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(1, 0, "train", b, 1.0 * b, p, p * 2.0 + b) for b in range(3) for p in range(4)]
    spark.createDataFrame(rows, "run int, epoch int, split string, batch_id int, loss double, pred int, target double").write.parquet(path)
    df = spark.read.parquet(path)
    made = M.epoch_metrics(df, "regression", {"train": "train"})
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r.name: r.value for r in made.collect()}
    want = df.agg(M.rmse_of(F.col("pred"), F.col("target")), M.pearson_of(F.col("pred"), F.col("target"))).first()
    assert got["train_loss"] == 1.0
    assert got["train_rmse"] == pytest.approx(want[0]) and got["train_pearsonr"] == pytest.approx(want[1])
