"""Losses and scores over prediction tables.

Each is one aggregation with map-side partial sums. ``by`` gives one loss per group, for example per batch. A mean over
no rows is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.functions.ids import PAD
from molweave.functions.vectors import (
    argmax,
    bce_with_logits,
    negative_log_likelihood,
    sign_prediction,
    soft_label_nll,
)

# Weights of the two parts of the replaced-token objective.
GENERATOR_WEIGHT = 1.0
DISCRIMINATOR_WEIGHT = 50.0


def token_cross_entropy(df: DataFrame, logits="logits", label="label", num_labels=None, by=()) -> DataFrame:
    """Mean negative log likelihood; the ignored label is left out, any other outside the logits is an error."""
    nll = negative_log_likelihood(F.col(logits), F.col(label), num_labels)
    return df.groupBy(*by).agg(F.avg(nll).alias("loss"), F.count(nll).alias("n"))


def weighted_cross_entropy(df: DataFrame, weights: DataFrame, logits="logits", target="target", num_labels=None) -> DataFrame:
    """sum(w * nll) / sum(w).

    The weight depends on the class alone, so rows are summed per class first and only those sums meet the weights. A class
    without a weight is an error.
    """
    nll = negative_log_likelihood(F.col(logits), F.col(target), num_labels)
    per_class = df.groupBy(F.col(target).alias("target")).agg(F.sum(nll).alias("nll"), F.count(nll).alias("n"))
    joined = per_class.filter("n > 0").join(weights.select("target", "weight"), "target", "left")
    unknown = F.raise_error(F.concat(F.lit("no weight for class "), F.col("target").cast("string"))).cast("double")
    w = F.coalesce("weight", unknown)
    return joined.agg(F.try_divide(F.sum(w * F.col("nll")), F.sum(w * F.col("n"))).alias("loss"))


def bce_loss(df: DataFrame, x="logit", y="label", active: Column | None = None, by=()) -> DataFrame:
    """Mean binary cross entropy over active positions, or over all without a mask."""
    loss = bce_with_logits(F.col(x), F.col(y).cast("double"))
    if active is not None:
        loss = F.when(active, loss)
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count(loss).alias("n"))


def multilabel_bce(df: DataFrame, num_labels: int, logits="logits", targets="targets") -> DataFrame:
    """Mean over rows and labels."""
    terms = [bce_with_logits(F.col(logits)[i].cast("double"), F.col(targets)[i].cast("double")) for i in range(num_labels)]
    return df.agg((F.avg(reduce(lambda a, b: a + b, terms)) / num_labels).alias("loss"))


def mse_loss(df: DataFrame, pairs: list[tuple[str, str]], by=()) -> DataFrame:
    """Mean squared error over rows and (prediction, target) pairs; a regression head may have several."""
    squares = [(F.col(p) - F.col(t)) * (F.col(p) - F.col(t)) for p, t in pairs]
    return df.groupBy(*by).agg((F.avg(reduce(lambda a, b: a + b, squares)) / len(pairs)).alias("loss"))


def labelled_cross_entropy(df: DataFrame, logits="logits", label="label", num_labels=None) -> DataFrame:
    """Mean over rows with a label >= 0; 0 when there is none."""
    nll = negative_log_likelihood(F.col(logits), F.col(label), num_labels, ignored=F.col(label) < 0)
    return df.agg(F.coalesce(F.avg(nll), F.lit(0.0)).alias("loss"))


def soft_label_loss(df: DataFrame, logits="logits", targets="targets", num_labels=None) -> DataFrame:
    return df.agg(F.avg(soft_label_nll(F.col(logits), F.col(targets), num_labels)).alias("loss"))


def classifier_loss(
    df: DataFrame, num_labels: int, integral_target: bool, logits="logits", target="target", weights: DataFrame | None = None
) -> DataFrame:
    """The loss a sequence head uses: one output is regression, integer targets are classes, others are multi-label."""
    if num_labels == 1:
        return mse_loss(df.withColumn("_p", F.col(logits)[0].cast("double")), [("_p", target)])
    if not integral_target:
        return multilabel_bce(df, num_labels, logits, target)
    if weights is None:
        return token_cross_entropy(df, logits, target, num_labels).select("loss")
    return weighted_cross_entropy(df, weights, logits, target, num_labels)


def generator_accuracy(df: DataFrame, logits="logits", label="mlm_label", masked="masked", by=()) -> DataFrame:
    """Share of masked positions whose largest logit is the label."""
    hit = F.when(F.col(masked), (argmax(F.col(logits)) == F.col(label)).cast("double"))
    return df.groupBy(*by).agg(F.avg(hit).alias("gen_acc"))


def generator_losses(positions: DataFrame, nll="nll", hit="hit", by=()) -> DataFrame:
    """mlm_loss, its perplexity and gen_acc of a corruption run that judged its generator; both inputs are null where nothing is masked."""
    parts = positions.groupBy(*by).agg(F.avg(nll).alias("mlm_loss"), F.avg(F.col(hit).cast("double")).alias("gen_acc"), F.count(nll).alias("n"))
    return parts.withColumn("perplexity", F.exp("mlm_loss"))


def _disc_accuracy(x: Column, y: Column, masked: Column) -> Column:
    hit = (sign_prediction(x) == y).cast("double")
    return 0.5 * F.avg(F.when(masked, hit)) + 0.5 * F.avg(F.when(~masked, hit))


def discriminator_accuracy(df: DataFrame, x="disc_logit", y="disc_label", masked="masked", by=()) -> DataFrame:
    """Half the accuracy on masked positions plus half that on all others, padding included."""
    return df.groupBy(*by).agg(_disc_accuracy(F.col(x), F.col(y), F.col(masked)).alias("disc_acc"))


def rtd_losses(
    df: DataFrame,
    by=("batch_id",),
    nll="nll",
    x="disc_logit",
    y="disc_label",
    masked="masked",
    token="token_id",
    hit: str | None = None,
    gen_weight: float = GENERATOR_WEIGHT,
    disc_weight: float = DISCRIMINATOR_WEIGHT,
) -> DataFrame:
    """Per batch: mlm_loss, disc_loss, their weighted sum, and disc_acc, in one aggregation over positions.

    ``nll`` is null where a position has no label; the discriminator loss leaves out padding. ``hit`` names a column that is
    true where the generator's best token is the label; with it gen_acc, its share of the masked positions, is added.
    """
    bce = F.when(F.col(token) != PAD, bce_with_logits(F.col(x), F.col(y).cast("double")))
    parts = df.groupBy(*by).agg(
        F.avg(nll).alias("mlm_loss"),
        F.avg(bce).alias("disc_loss"),
        _disc_accuracy(F.col(x), F.col(y), F.col(masked)).alias("disc_acc"),
        *([F.avg(F.when(F.col(masked), F.col(hit).cast("double"))).alias("gen_acc")] if hit else []),
    )
    return parts.withColumn("loss", gen_weight * F.col("mlm_loss") + disc_weight * F.col("disc_loss"))
