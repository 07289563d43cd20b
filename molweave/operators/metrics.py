"""Metrics over prediction tables and per epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The metrics of each problem type.
PROBLEM_METRICS = {"regression": ["rmse", "pearsonr"], "classification": ["roc", "precision"]}
THRESHOLD = 0.5


def rmse_of(pred: Column, target: Column) -> Column:
    d = pred - target
    return F.sqrt(F.avg(d * d))


def pearson_of(pred: Column, target: Column) -> Column:
    """Correlation; null when either side is constant (plain corr would raise in ANSI mode)."""
    spread = F.stddev_pop(pred) * F.stddev_pop(target)
    return F.try_divide(F.covar_pop(pred, target), spread)


def checked_score(score: Column) -> Column:
    """The score; NaN has no place in an order and is an error."""
    number = score.cast("double")
    return F.when(F.isnan(number), F.raise_error(F.lit("a score is NaN")).cast("double")).otherwise(number)


def precision_of(score: Column, target: Column) -> Column:
    """True positives among rows scored above the threshold; 0 when there is none. A NaN score is an error."""
    said = checked_score(score) > THRESHOLD
    return F.coalesce(F.try_divide(F.count_if(said & (target == 1)), F.count_if(said)), F.lit(0.0))


def mae_of(pred: Column, target: Column) -> Column:
    return F.avg(F.abs(pred - target))


def rmse(df: DataFrame, pred="pred", target="target", by=()) -> DataFrame:
    return df.groupBy(*by).agg(rmse_of(F.col(pred), F.col(target)).alias("rmse"))


def pearsonr(df: DataFrame, pred="pred", target="target", by=()) -> DataFrame:
    return df.groupBy(*by).agg(pearson_of(F.col(pred), F.col(target)).alias("pearsonr"))


def precision(df: DataFrame, score="pred", target="target", by=()) -> DataFrame:
    return df.groupBy(*by).agg(precision_of(F.col(score), F.col(target)).alias("precision"))


def mae(df: DataFrame, run="run", pred="pred", target="target", by=()) -> DataFrame:
    """Mean absolute error of each run, averaged over runs."""
    per_run = df.groupBy(run, *by).agg(mae_of(F.col(pred), F.col(target)).alias("mae"))
    return per_run.groupBy(*by).agg(F.avg("mae").alias("mae_mean"))


def auroc(df: DataFrame, score="pred", target="target", by=()) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half; null with one class only.

    Equal scores are counted together first. The distinct scores are range-partitioned, so each part is a stretch of the
    order: pairs inside a part come from a running sum within it, pairs across parts from the part totals. No group is
    ordered in one task, however many rows it has, and only one row per part reaches the last window.
    """
    return area(score_counts(df, F.col(score), target, by), by)


def score_counts(df: DataFrame, score: Column, target: str, by=()) -> DataFrame:
    """(by..., _s, _p, _n): positives and negatives per score; rows without a score or target count as neither.

    A NaN score is an error.
    """
    positive, scored = F.col(target) == 1, score.isNotNull()
    return df.groupBy(*by, checked_score(score).alias("_s")).agg(
        F.count_if(scored & positive).alias("_p"), F.count_if(scored & ~positive).alias("_n")
    )


def area(counts: DataFrame, by=()) -> DataFrame:
    """Area under the curve from counts per score."""
    parts = counts.repartitionByRange(*by, "_s").withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy("_part", *by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(before), F.lit(0))
    # Doubled so that half a tie stays an integer; decimals, since pairs outgrow 64 bits.
    pairs = parts.withColumn("_w", F.col("_p").cast("decimal(18,0)") * (2 * below + F.col("_n")).cast("decimal(19,0)"))
    totals = pairs.groupBy(*by, "_part").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_w").alias("_w")
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    across = F.col("_p").cast("decimal(18,0)") * (2 * ahead).cast("decimal(19,0)")
    area = totals.withColumn("_w", F.col("_w") + across)
    p, n = F.sum("_p").cast("double"), F.sum("_n").cast("double")
    return area.groupBy(*by).agg(F.try_divide(F.sum("_w").cast("double"), 2 * p * n).alias("roc"))


def evaluate_predictions(df: DataFrame, problem_type: str, pred="pred", target="target", by=("split",)) -> DataFrame:
    """(by..., name, value) with the metrics of the problem type."""
    names = PROBLEM_METRICS.get(problem_type)
    if names is None:
        raise ValueError(f"unknown problem type {problem_type!r}")
    p, t = F.col(pred), F.col(target)
    made = {"rmse": rmse_of(p, t), "pearsonr": pearson_of(p, t), "precision": precision_of(p, t)}
    direct = [n for n in names if n in made]
    long = df.groupBy(*by).agg(*[made[n].alias(n) for n in direct]).unpivot(list(by), direct, "name", "value")
    if "roc" in names:
        long = long.unionByName(auroc(df, pred, target, by).unpivot(list(by), ["roc"], "name", "value"))
    return long


def batch_mean_loss(df: DataFrame, loss="loss", batch="batch_id", by=("run", "epoch", "split")) -> DataFrame:
    """Mean of the batch means: every batch weighs 1, the short last one too."""
    per_batch = df.groupBy(*by, batch).agg(F.avg(loss).alias("_loss"))
    return per_batch.groupBy(*by).agg(F.avg("_loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def _named(rows: DataFrame, by: list[str], split: str, prefixes: dict[str, str], columns: list[str]) -> DataFrame:
    """(by..., name, value) of wide rows, names with the prefix of their split."""
    long = rows.unpivot([*by, split], columns, "name", "value")
    prefix = F.element_at(F.create_map(*[F.lit(x) for pair in prefixes.items() for x in pair]), F.col(split))
    return long.select(*by, F.concat_ws("_", prefix, F.col("name")).alias("name"), "value")


def epoch_metrics(
    df: DataFrame,
    problem_type: str,
    prefixes: dict[str, str],
    loss="loss",
    batch="batch_id",
    pred="pred",
    target="target",
    by=("run", "epoch"),
    split="split",
) -> DataFrame:
    """(by..., name, value): loss and the problem's metrics per epoch and split, named train_..., val_....

    A new epoch is a new group, which is all a reset has to do. Rows are reduced per batch, to counts, means and centred sums
    that merge, and batches per epoch, so the table is read once; the area under the curve alone needs the scores themselves.
    """
    if problem_type not in PROBLEM_METRICS:
        raise ValueError(f"unknown problem type {problem_type!r}")
    keys = [*by, split]
    p, t = F.col(pred).cast("double"), F.col(target).cast("double")
    if problem_type == "classification":
        said = checked_score(p) > THRESHOLD
        parts = [F.count_if(said & (t == 1)).alias("_hit"), F.count_if(said).alias("_said")]
        metrics = {"precision": F.coalesce(F.try_divide(F.sum("_hit"), F.sum("_said")), F.lit(0.0))}
    else:
        both = p.isNotNull() & t.isNotNull()
        x, y = F.when(both, p), F.when(both, t)
        parts = [
            F.count(x).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.sum((x - y) * (x - y)).alias("_d"),
            F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_vxy"),
        ]
        n, mx, my = F.col("_n"), F.col("_mx"), F.col("_my")
        total = F.sum(n)

        def merged(within: Column, a: Column, b: Column) -> Column:
            """Centred sum of all rows from those of the batches; the batches' means are centred on one of theirs."""
            return F.sum(n * within) + F.sum(n * a * b) - F.try_divide(F.sum(n * a) * F.sum(n * b), total)

        dx, dy = mx - F.col("_x0"), my - F.col("_y0")
        spread = F.sqrt(merged(F.col("_vx"), dx, dx)) * F.sqrt(merged(F.col("_vy"), dy, dy))
        metrics = {
            "rmse": F.sqrt(F.try_divide(F.sum("_d"), total)),
            "pearsonr": F.try_divide(merged(F.col("_vxy"), dx, dy), spread),
        }
    batches = df.groupBy(*keys, batch).agg(F.avg(loss).alias("_loss"), *parts)
    if problem_type == "regression":
        # Any batch's mean will do as a centre; it keeps the products of means small.
        group = Window.partitionBy(*keys)
        batches = batches.withColumn("_x0", F.max("_mx").over(group)).withColumn("_y0", F.max("_my").over(group))
    wide = batches.groupBy(*keys).agg(F.avg("_loss").alias("loss"), *[m.alias(name) for name, m in metrics.items()])
    named = _named(wide, list(by), split, prefixes, ["loss", *metrics])
    if "roc" in PROBLEM_METRICS[problem_type]:
        named = named.unionByName(_named(auroc(df, pred, target, keys), list(by), split, prefixes, ["roc"]))
    return named


# What pretraining logs per epoch.
PRETRAINING_METRICS = ["loss", "mlm_loss", "disc_loss", "gen_acc", "disc_acc"]


def pretraining_metrics(batches: DataFrame, prefixes: dict[str, str], by=("run", "epoch"), split="split") -> DataFrame:
    """(by..., name, value): the mean over batches of each number of ``rtd_losses``, per epoch and split."""
    wide = batches.groupBy(*by, split).agg(*[F.avg(name).alias(name) for name in PRETRAINING_METRICS])
    return _named(wide, list(by), split, prefixes, PRETRAINING_METRICS)


def format_metrics(df: DataFrame, by: list[str], split="split", epoch="epoch") -> DataFrame:
    """One line per group: ``[split] epoch n name: 0.1234 ...`` with names in order."""
    cell = F.format_string("%s: %.4f", F.col("name"), F.col("value"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", cell.alias("text")))), lambda c: c["text"]), " ")
    head = F.concat(F.lit("["), F.col(split), F.lit("] epoch "), F.col(epoch).cast("string"), F.lit(" "))
    return df.groupBy(*by).agg(joined.alias("_line")).select(*by, F.concat(head, F.col("_line")).alias("line"))
