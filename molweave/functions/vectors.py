"""Expressions over logits.

The number of labels of a head is known when the query is written, so the sums over labels are unrolled into plain
expressions that Spark compiles (``num_labels`` up to UNROLL_LIMIT). Wider rows, such as logits over a vocabulary, use
higher-order functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from molweave.functions.ids import IGNORE_LABEL

UNROLL_LIMIT = 32


def _parts(logits: Column, num_labels: int) -> list[Column]:
    return [logits[i].cast("double") for i in range(num_labels)]


def _largest(parts: list[Column]) -> Column:
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def log_sum_exp(logits: Column, num_labels: int | None = None) -> Column:
    """ln(sum(exp(logit))), shifted by the largest logit so that it cannot overflow."""
    if num_labels is not None and num_labels <= UNROLL_LIMIT:
        parts = _parts(logits, num_labels)
        top = _largest(parts)
        return top + F.log(reduce(lambda a, b: a + b, [F.exp(p - top) for p in parts]))
    top = F.array_max(logits).cast("double")
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return top + F.log(total)


def softmax(logits: Column, num_labels: int | None = None) -> Column:
    """Probabilities, as an array."""
    lse = log_sum_exp(logits, num_labels)
    if num_labels is not None and num_labels <= UNROLL_LIMIT:
        return F.array(*[F.exp(p - lse) for p in _parts(logits, num_labels)])
    return F.transform(logits, lambda x: F.exp(x - lse))


def positive_probability(logits: Column) -> Column:
    """Softmax probability of class 1 of two."""
    return F.exp(logits[1].cast("double") - log_sum_exp(logits, 2))


def prediction_score(logits: Column, num_labels: int) -> Column:
    """What the metrics see: the class-1 probability for two labels, the bare logit for one."""
    if num_labels == 2:
        return positive_probability(logits)
    if num_labels == 1:
        return logits[0].cast("double")
    raise ValueError("metrics are defined for one output or two labels")


def argmax(logits: Column) -> Column:
    """Index of the largest logit, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def negative_log_likelihood(logits: Column, label: Column, num_labels: int | None = None, ignored: Column | None = None) -> Column:
    """logsumexp - logit[label]; null where the label is ignored (IGNORE_LABEL unless told otherwise) or null.

    Any other label outside the logits is an error: a row must not vanish from a mean.
    """
    left_out = label.isNull() | (label == IGNORE_LABEL if ignored is None else ignored)
    inside = (label >= 0) & (label < F.size(logits))
    outside = F.raise_error(F.concat(F.lit("label outside the logits: "), label.cast("string"))).cast("double")
    nll = log_sum_exp(logits, num_labels) - F.get(logits, label).cast("double")
    return F.when(~left_out, F.when(inside, nll).otherwise(outside))


def soft_label_nll(logits: Column, targets: Column, num_labels: int | None = None) -> Column:
    """-sum(log_softmax * target) for a distribution over labels."""
    lse = log_sum_exp(logits, num_labels)
    if num_labels is not None and num_labels <= UNROLL_LIMIT:
        terms = [(p - lse) * targets[i] for i, p in enumerate(_parts(logits, num_labels))]
        return -reduce(lambda a, b: a + b, terms)
    terms = F.zip_with(logits, targets, lambda x, t: (x - lse) * t)
    return -F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def bce_with_logits(x: Column, y: Column) -> Column:
    """Binary cross entropy of one logit, in the form that does not overflow."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def sign_prediction(x: Column) -> Column:
    """round((sign(x) + 1) / 2) with halves to even: logit 0 is class 0."""
    return F.bround((F.signum(x) + 1) * 0.5, 0).cast("int")


def gumbel(u: Column) -> Column:
    """Gumbel noise of a uniform draw, with the small constant that keeps both logarithms finite."""
    # Fixed value.
    eps = F.lit(1e-9)
    return -F.log(-F.log(u + eps) + eps)
