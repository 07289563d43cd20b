"""Label statistics of the train split and their use on any split.

Means and deviations are one row. They enter other plans as scalar subqueries: computed once per query and inlined as constants,
with no join. Class weights are joined by class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def target_mean_std(df: DataFrame, target: str = "target") -> DataFrame:
    """Mean and population standard deviation."""
    x = F.col(target).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """(target, n_c, weight): balanced weights n / (k * n_c)."""
    counts = (
        df.filter(F.col(target).isNotNull())
        .groupBy(F.col(target).alias("target"))
        .agg(F.count(F.lit(1)).alias("n_c"))
    )
    totals = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).select(F.struct("n", "k")).scalar()
    return counts.select("target", "n_c", (totals["n"] / (totals["k"] * F.col("n_c"))).alias("weight"))


def attach_weights(df: DataFrame, weights: DataFrame, target: str = "target", out: str = "class_weight") -> DataFrame:
    """Add the weight of a row's class; null for a class the train split does not have.

    A join on the class, of which Spark knows the size: few classes are broadcast, many are not.
    """
    by_class = weights.select(F.col("target").alias("_class"), F.col("weight").alias(out))
    return df.join(by_class, F.col(target) == F.col("_class"), "left").drop("_class")


def infer_problem(df: DataFrame, target: str = "target") -> DataFrame:
    """(problem_type, num_labels) of a target column.

    A class count in the column metadata decides without reading data; otherwise an integral type means classes, and
    anything else one regression output.
    """
    field = df.schema[target]
    declared = field.metadata.get("num_classes")
    if declared is not None:
        return _problem_row(df, "classification", int(declared))
    if isinstance(field.dataType, T.IntegralType):
        classes = df.select(target).na.drop().groupBy(target).agg(F.lit(1).alias("one"))
        return classes.agg(F.count("one").alias("num_labels")).select(
            F.lit("classification").alias("problem_type"), "num_labels"
        )
    return _problem_row(df, "regression", 1)


def _problem_row(df: DataFrame, problem_type: str, num_labels: int) -> DataFrame:
    one = df.sparkSession.range(0, 1, 1, 1)
    return one.select(F.lit(problem_type).alias("problem_type"), F.lit(num_labels).cast("bigint").alias("num_labels"))


def is_classification(df: DataFrame, target: str = "target") -> bool:
    field = df.schema[target]
    return "num_classes" in field.metadata or isinstance(field.dataType, T.IntegralType)


def apply_train_stats(df: DataFrame, train: DataFrame, target: str = "target") -> DataFrame:
    """Attach the train split's statistics to the rows of any split.

    Classification adds ``class_weight``; regression adds ``mean`` and ``std``.
    """
    if is_classification(train, target):
        return attach_weights(df, class_weights(train, target), target)
    stats = _stats(train, target)
    return df.withColumn("mean", stats["mean"]).withColumn("std", stats["std"])


def standardize(df: DataFrame, train: DataFrame, target: str = "target", out: str | None = None) -> DataFrame:
    """(target - mean) / std with the train split's statistics; null when std is 0."""
    stats = _stats(train, target)
    z = F.try_divide(F.col(target).cast("double") - stats["mean"], stats["std"])
    return df.withColumn(out or target, z)


def _stats(train: DataFrame, target: str) -> Column:
    return target_mean_std(train, target).select(F.struct("mean", "std")).scalar()


def standardize_multi(
    df: DataFrame, train: DataFrame, targets: str = "targets", num_tasks: int | None = None, out: str | None = None
) -> DataFrame:
    """Per-task standardisation of an array of targets; a task whose std is 0 is divided by 1.

    A head knows its number of tasks; with ``num_tasks`` the statistics are plain aggregates over the rows. Without it
    the arrays are exploded, and each task is a group.
    """
    if num_tasks is not None:
        cells = [F.col(targets)[i].cast("double") for i in range(num_tasks)]
        row = train.agg(*[x for i, c in enumerate(cells) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))])
        stats = row.select(F.struct("*")).scalar()
        z = F.array(*[F.try_divide(c - stats[f"m{i}"], _divisor(stats[f"s{i}"])) for i, c in enumerate(cells)])
        return df.withColumn(out or targets, z)
    per_task = (
        train.select(F.posexplode_outer(targets).alias("task", "value"))
        .filter(F.col("task").isNotNull())
        .groupBy("task")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("task", "mean", _divisor(F.col("std")).alias("std"))))
    z = F.zip_with(targets, "_stats", lambda t, s: F.try_divide(t - s["mean"], s["std"]))
    with_stats = df.withColumn("_stats", per_task.agg(ordered.alias("stats")).scalar())
    return with_stats.withColumn(out or targets, z).drop("_stats")


def _divisor(std: Column) -> Column:
    return F.when(std == 0, 1.0).otherwise(std)
