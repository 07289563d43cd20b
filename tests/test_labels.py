import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.operators import labels as L


def targets(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"target {kind}")


def test_mean_and_population_std(spark):
    x = [1.0, 2.0, 4.0, 9.0]
    r = L.target_mean_std(targets(spark, x)).first()
    assert r.mean == pytest.approx(np.mean(x)) and r.std == pytest.approx(np.std(x))


def test_class_weights_are_balanced(spark):
    rows = L.class_weights(targets(spark, [0] * 6 + [1] * 2 + [None], "int")).orderBy("target").collect()
    assert [(r.target, r.n_c, r.weight) for r in rows] == [(0, 6, 8 / 12), (1, 2, 8 / 4)]
    assert sum(r.n_c * r.weight for r in rows) == pytest.approx(8)
    assert L.class_weights(targets(spark, [3, 3], "int")).first().weight == 1.0


def test_infer_problem(spark):
    as_row = lambda df: tuple(L.infer_problem(df).first())
    assert as_row(targets(spark, [0, 1, 1, None], "int")) == ("classification", 2)
    assert as_row(targets(spark, [0.5])) == ("regression", 1)
    field = T.StructField("target", T.IntegerType(), True, {"num_classes": 5})
    declared = spark.createDataFrame([(0,)], T.StructType([field]))
    assert as_row(declared) == ("classification", 5)


def test_train_statistics_on_another_split(spark):
    train, test = targets(spark, [0, 0, 1], "int"), targets(spark, [0, 2], "int")
    got = {r.target: r.class_weight for r in L.apply_train_stats(test, train).collect()}
    # Class 2 is not in the train split.
    assert got == {0: 3 / 4, 2: None}
    r = L.apply_train_stats(targets(spark, [9.0]), targets(spark, [1.0, 3.0])).first()
    assert (r.target, r.mean, r.std) == (9.0, 2.0, 1.0)


def test_many_classes_are_joined(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").cast("int").alias("target"))
    weighted = L.apply_train_stats(rows, rows)
    assert weighted.count() == n and weighted.agg(F.max(F.abs(F.col("class_weight") - 1))).first()[0] < 1e-9
    assert "BroadcastNestedLoopJoin" not in weighted._jdf.queryExecution().executedPlan().toString()


def test_standardize(spark):
    train = targets(spark, [1.0, 3.0])
    z = [r.target for r in L.standardize(targets(spark, [2.0, 5.0, None]), train).collect()]
    assert z == [0.0, 3.0, None]
    for constant in ([4.0, 4.0], [4.0]):
        assert L.standardize(targets(spark, [4.0]), targets(spark, constant)).first().target is None


def test_statistics_are_inlined_without_a_join(spark):
    df = targets(spark, [1.0, 2.0])
    plan = L.standardize(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" in plan


@pytest.mark.parametrize("num_tasks", [None, 2])
def test_standardize_multi(spark, num_tasks):
    df = spark.createDataFrame([([1.0, 7.0],), ([3.0, 7.0],)], "targets array<double>")
    assert [r.targets for r in L.standardize_multi(df, df, num_tasks=num_tasks).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
