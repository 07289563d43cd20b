import math
import random

import pytest
from pyspark.sql import functions as F

from molweave.operators import runs as R

NAN = float("nan")


def log(spark, series, name="rmse"):
    rows = [(run, name, e, v) for run, vs in series.items() for e, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run int, name string, epoch int, value double")


def loop(values, maximize, patience):
    """The training loop: strict improvement resets the count, and the count reaching patience stops."""
    best, waited, flags, bests = (-math.inf if maximize else math.inf), 0, [], []
    stop = None
    for epoch, v in enumerate(values):
        better = v > best if maximize else v < best
        flags.append(better)
        if better:
            best, waited = v, 0
        else:
            waited += 1
        bests.append(best if math.isfinite(best) else None)
        if stop is None and patience and waited == patience:
            stop = epoch
    return flags, bests, stop


def series(seed, n=12):
    rng = random.Random(seed)
    return {r: [rng.choice([NAN, 1.0, 2.0, 3.0, rng.random() * 4]) for _ in range(rng.randint(1, n))] for r in range(40)}


@pytest.mark.parametrize("name,maximize", [("rmse", False), ("roc", True), ("val_roc", True), ("val_rmse", False)])
@pytest.mark.parametrize("block", [4096, 3])
def test_running_best_equals_the_loop(spark, monkeypatch, name, maximize, block):
    monkeypatch.setattr(R, "BLOCK", block)
    data = series(1)
    got = {}
    for r in R.running_best(log(spark, data, name), R.METRIC_GOALS).collect():
        got.setdefault(r.run, {})[r.epoch] = (r.improved, r.best, r.step)
    for run, values in data.items():
        flags, bests, _ = loop(values, maximize, None)
        assert [got[run][e] for e in range(len(values))] == [(f, b, e + 1) for e, (f, b) in enumerate(zip(flags, bests))]


@pytest.mark.parametrize("patience", [None, 0, 1, 2, 3])
@pytest.mark.parametrize("name,maximize", [("rmse", False), ("val_pearsonr", True)])
def test_early_stop_equals_the_loop(spark, monkeypatch, patience, name, maximize):
    monkeypatch.setattr(R, "BLOCK", 4)
    data = series(2, 20)
    got = {r.run: (r.stop_epoch, r.last_epoch) for r in R.early_stop_epoch(log(spark, data, name), patience, R.METRIC_GOALS).collect()}
    assert got == {run: (loop(v, maximize, patience)[2], len(v) - 1) for run, v in data.items()}


def test_equal_values_do_not_improve(spark):
    rows = R.running_best(log(spark, {1: [2.0, 2.0, 1.0]}), R.METRIC_GOALS).orderBy("epoch").collect()
    assert [r.improved for r in rows] == [True, False, True]


def test_a_long_run_is_spread_over_blocks(spark, monkeypatch):
    # One run has nearly all rows; no window may hold more than a block of it.
    monkeypatch.setattr(R, "BLOCK", 64)
    rng = random.Random(4)
    data = {1: [rng.random() for _ in range(2000)], 2: [1.0, 0.5]}
    got = {r.run: r.stop_epoch for r in R.early_stop_epoch(log(spark, data), 150, R.METRIC_GOALS).collect()}
    assert got == {run: loop(v, False, 150)[2] for run, v in data.items()}


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, "rmse", 0, 1.0), (None, "rmse", 1, 0.5)], "run int, name string, epoch int, value double")
    assert [r.best for r in R.running_best(rows, R.METRIC_GOALS).orderBy("epoch").collect()] == [1.0, 0.5]


def test_best_trial_goal_and_ties(spark):
    rows = [("a", 3, "roc", 0.9), ("a", 2, "roc", 0.9), ("a", 1, "roc", 0.1), ("a", 4, "roc", NAN), ("b", 1, "rmse", 2.0), ("b", 2, "rmse", 3.0)]
    df = spark.createDataFrame(rows, "dataset string, run int, name string, value double")
    assert {(r.dataset, r.run, r.value) for r in R.best_trial(df, R.METRIC_GOALS).collect()} == {("a", 2, 0.9), ("b", 1, 2.0)}


def test_a_sweep_declares_its_metric(spark):
    rows = [("a", 1, "val_roc", 0.5), ("a", 2, "val_roc", 0.9), ("a", 3, "loss", 0.1)]
    df = spark.createDataFrame(rows, "dataset string, run int, name string, value double")
    assert [tuple(r) for r in R.best_trial(df, {"val_roc": "maximize"}, "val_roc").collect()] == [("a", "val_roc", 2, 0.9)]
    goal = df.withColumn("goal", F.when(F.col("name") == "loss", "minimize").otherwise("maximize"))
    assert {r.run for r in R.best_trial(goal, F.col("goal")).collect()} == {2, 3}


def test_a_metric_without_a_goal_is_an_error(spark):
    with pytest.raises(Exception, match="no goal for metric val_odd"):
        R.running_best(log(spark, {1: [1.0]}, "val_odd"), R.METRIC_GOALS).collect()
    with pytest.raises(ValueError):
        R.best_trial(log(spark, {1: [1.0]}), {"rmse": "down"}, by="epoch")


def test_unchanged_keys(spark):
    before = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 4.0)], "k int, v double")
    after = spark.createDataFrame([(1, 1.0), (2, None), (3, 9.0), (5, 5.0)], "k int, v double")
    assert {r.k for r in R.unchanged_keys(before, after, "k", "v").collect()} == {1, 2}
