"""Looking at predictions position by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import uniform
from molweave.functions.ids import PAD
from molweave.operators.corrupt import positions_of
from molweave.operators.vocab import with_tokens

# Fixed value: batches looked at.
REVIEW_BATCHES = 5


def shown_length(ids: Column) -> Column:
    """Positions before the first [PAD]; all of them when there is none."""
    first = F.array_position(ids, F.lit(PAD))
    return F.when(first > 0, (first - 1).cast("int")).otherwise(F.size(ids))


def _until_padding(df: DataFrame, ids: str, arrays: list[str]) -> DataFrame:
    """Cut parallel arrays at the first [PAD] of ``ids``, before anything is exploded."""
    n = shown_length(F.col(ids))
    cut = df.withColumn("_n", n)
    return cut.select(
        *[c for c in df.columns if c not in arrays], *[F.slice(a, F.lit(1), F.col("_n")).alias(a) for a in arrays]
    )


def token_diff(df: DataFrame, vocab: DataFrame, key: str, ids="disc_input", labels="input_ids") -> DataFrame:
    """(key, pos, token, changed): tokens shown and whether they differ from the original."""
    cut = _until_padding(df.select(key, ids, labels), ids, [ids, labels])
    compared = cut.select(key, ids, F.zip_with(ids, labels, lambda x, y: x != y).alias("_changed"))
    shown = with_tokens(compared, vocab, key, ids, "_token")
    return positions_of(shown, [key], {"_token": "token", "_changed": "changed"})


def verdict(predicted: Column, replaced: Column) -> Column:
    """right: replaced and predicted so; wrong: exactly one of the two; null: neither."""
    return F.when(predicted & replaced, "right").when(predicted | replaced, "wrong")


def replacement_report(df: DataFrame, key: str, ids="disc_input", predicted="disc_predictions", labels="disc_labels") -> DataFrame:
    """(key, pos, id, verdict) before the first [PAD]."""
    arrays = [ids, predicted, labels]
    cut = _until_padding(df.select(key, *arrays), ids, arrays)
    long = positions_of(cut, [key], {ids: "id", predicted: "_p", labels: "_y"})
    return long.select(key, "pos", "id", verdict(F.col("_p") == 1, F.col("_y") == 1).alias("verdict"))


def confusion(report: DataFrame) -> DataFrame:
    return report.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def sample_for_review(df: DataFrame, key: str, seed, batches: int = REVIEW_BATCHES) -> DataFrame:
    """One whole row drawn from each of the first batches.

    The draw is a minimum over hashes, so it combines on the map side: a row per batch and task is shuffled.
    """
    u = uniform(seed, "batch_id", key)
    first = F.min_by(F.struct("*"), F.struct(u, F.col(key))).alias("m")
    picked = df.filter(F.col("batch_id") < batches).groupBy(F.col("batch_id").alias("_batch")).agg(first)
    return picked.select("m.*")
