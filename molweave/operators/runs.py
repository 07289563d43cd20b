"""Metrics over epochs and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The goals of the metrics this package makes, for callers to pass on.
METRIC_GOALS = {"loss": "minimize", "rmse": "minimize", "mae": "minimize", "pearsonr": "maximize", "roc": "maximize", "precision": "maximize"}
# Split prefixes of logged metric names.
PREFIXES = ["train", "val", "test"]
# Epochs per block of a running aggregate.
BLOCK = 4096


def goal_sign(name: Column, goals: dict[str, str] | Column) -> Column:
    """1 to maximise, -1 to minimise.

    ``goals`` maps metric names to "maximize" or "minimize", or is a column that holds the goal. A name is looked up as it is,
    then without its split prefix; a metric without a goal is an error.
    """
    if isinstance(goals, Column):
        goal = goals
    else:
        wrong = sorted(set(goals.values()) - {"maximize", "minimize"})
        if wrong or not goals:
            raise ValueError(f"a goal is 'maximize' or 'minimize', not {wrong}")
        table = F.create_map(*[F.lit(x) for pair in goals.items() for x in pair])
        bare = F.regexp_replace(name, f"^({'|'.join(PREFIXES)})_", "")
        goal = F.coalesce(F.try_element_at(table, name), F.try_element_at(table, bare))
    unknown = F.raise_error(F.concat(F.lit("no goal for metric "), F.coalesce(name, F.lit("null")))).cast("double")
    return F.when(goal == "maximize", 1.0).when(goal == "minimize", -1.0).otherwise(unknown)


def _followed(log: DataFrame, goals, keys: list[str], epoch: str, name: str, value: str) -> DataFrame:
    """The log with _sign, _score, step and _lead: the best score of earlier rows and its earliest step, negated.

    The earliest row that holds the best score is the last strict improvement. A block of epochs is numbered and reduced first,
    block results are carried over, and each row meets them once, so a long run is spread over many tasks.
    """
    sign = goal_sign(F.col(name), goals)
    score = F.when(~F.isnan(value), F.col("_sign") * F.col(value))
    rows = log.withColumn("_sign", sign).withColumn("_score", score).withColumn("_block", F.floor(F.col(epoch) / BLOCK))
    inside = Window.partitionBy(*keys, "_block").orderBy(epoch)
    local = rows.withColumn("_place", F.row_number().over(inside))
    lead = F.when(F.col("_score").isNotNull(), F.struct(F.col("_score").alias("score"), (-F.col("_place")).alias("step")))
    totals = local.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), F.max(lead).alias("_best"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    moved = F.when(
        F.col("_best").isNotNull(), F.struct(F.col("_best.score").alias("score"), (F.col("_best.step") - F.col("_offset")).alias("step"))
    )
    carried = offsets.withColumn("_best", moved).withColumn("_carried", F.max("_best").over(earlier))
    renamed = carried.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_block"]], "_offset", "_carried")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, "_block"]]
    joined = local.join(renamed, same).withColumn("step", F.col("_offset") + F.col("_place"))
    own = F.when(F.col("_score").isNotNull(), F.struct(F.col("_score").alias("score"), (-F.col("step")).alias("step")))
    before = F.max(own).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    led = joined.withColumn("_lead", F.greatest("_carried", before))
    return led.drop(*[f"_k_{k}" for k in [*keys, "_block"]], "_offset", "_carried", "_block", "_place")


def running_best(log: DataFrame, goals: dict[str, str] | Column, keys=("run", "name"), epoch="epoch", name="name", value="value") -> DataFrame:
    """Add step (rows of the run so far), improved (a strict improvement) and best (the best value so far).

    NaN never improves. A run starts from the worst possible value, so its first number is an improvement.
    """
    ran = _followed(log, goals, list(keys), epoch, name, value)
    improved = F.coalesce(F.col("_score") > F.coalesce(F.col("_lead.score"), F.lit(float("-inf"))), F.lit(False))
    best = F.col("_sign") * F.greatest("_lead.score", "_score")
    return ran.withColumn("improved", improved).withColumn("best", best).drop("_sign", "_score", "_lead")


def early_stop_epoch(
    log: DataFrame, patience: int | None, goals: dict[str, str] | Column, keys=("run", "name"), epoch="epoch", name="name", value="value"
) -> DataFrame:
    """(keys..., stop_epoch, last_epoch): the first epoch at which ``patience`` epochs brought no improvement.

    A patience of 0 or None never stops: stop_epoch is null.
    """
    keys = list(keys)
    if not patience or patience < 0:
        never = F.lit(None).cast(log.schema[epoch].dataType)
        return log.groupBy(*keys).agg(never.alias("stop_epoch"), F.max(epoch).alias("last_epoch"))
    ran = _followed(log, goals, keys, epoch, name, value)
    improved = F.coalesce(F.col("_score") > F.coalesce(F.col("_lead.score"), F.lit(float("-inf"))), F.lit(False))
    last = F.when(improved, F.col("step")).otherwise(F.coalesce(-F.col("_lead.step"), F.lit(0)))
    stopped = F.when(F.col("step") - last == patience, F.col(epoch))
    return ran.groupBy(*keys).agg(F.min(stopped).alias("stop_epoch"), F.max(epoch).alias("last_epoch"))


def best_trial(
    trials: DataFrame, goals: dict[str, str] | Column, metric: str | None = None, by="dataset", run="run", name="name", value="value"
) -> DataFrame:
    """(by, name, run, value) of the best trial by the metric's goal; equal values go to the smaller run id.

    ``metric`` names the one metric that decides, as a sweep declares it; without it there is a best trial per metric. A
    minimum over structs combines on the map side, so no group is sorted.
    """
    usable = trials.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if metric is not None:
        usable = usable.filter(F.col(name) == metric)
    rank = -goal_sign(F.col(name), goals) * F.col(value)
    best = usable.groupBy(by, name).agg(F.min(F.struct(rank.alias("rank"), F.col(run), F.col(value))).alias("b"))
    return best.select(by, name, F.col(f"b.{run}").alias(run), F.col(f"b.{value}").alias(value))


def unchanged_keys(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value is the same in both snapshots; two nulls are the same."""
    new = after.select(key, F.col(value).alias("_after"))
    return before.join(new, key).filter(F.col(value).eqNullSafe(F.col("_after"))).select(key, value)
