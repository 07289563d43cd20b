"""Encoding, masking and metrics over streamed corpora.

The caller names where rows and state are kept. A query that is started again with the same two paths goes on from its last
batch; what it gives back is read from disk, so nothing depends on the driver that ran before. Randomness is a hash of the row
key, so a replayed batch gives the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from molweave.functions.ids import MAX_LENGTH
from molweave.operators.corrupt import (
    MASK_PROB,
    corrupt_arrays,
    corrupt_sequences,
    mask_sequences,
    mask_state,
    proposal_table,
    sample_state,
    tempered,
)
from molweave.operators.encoding import encode_text
from molweave.operators.metrics import area, checked_score, mae_of, pearson_of, rmse_of, score_counts
from molweave.operators.ordering import SHUFFLE_BUFFER, buffer_shuffle
from molweave.operators.vocab import fits_broadcast

# Longer than a stream lives: a trigger of this length runs one micro-batch and then waits.
ONE_BATCH = "36500 days"
POLL_SECONDS = 0.05
# What a query says between two triggers.
IDLE = "Waiting for next trigger"
# Rank error of a sketch with parameter k, one-sided at 99 % confidence: a fixed formula of the sketch.
SKETCH_ERROR = (2.296, 0.9723)
SKETCH_K = 4096
# Quantiles that a sketch is read at.
SKETCH_POINTS = 1024


def stream_encode(
    stream: DataFrame, vocab: DataFrame, text: str = "selfies", max_length: int = MAX_LENGTH, key: str | None = None
) -> DataFrame:
    """Encode a stream against a fixed vocabulary; stateless.

    A vocabulary that is too large to broadcast is joined by the unique ``key``, which ``drain_through`` does micro-batch by
    micro-batch.
    """
    if stream.isStreaming and not fits_broadcast(vocab):
        raise ValueError("a vocabulary of this size is joined: encode the micro-batches with drain_through")
    return encode_text(stream, vocab, text, max_length, key)


def stream_mask(stream: DataFrame, key: str, seed, ids: str = "input_ids", p: float = MASK_PROB) -> DataFrame:
    """Mask a stream of encoded sequences; stateless."""
    return mask_sequences(stream, key, seed, ids, p)


def stream_shuffle(stream: DataFrame, key: str, seed, buffer: int = SHUFFLE_BUFFER) -> DataFrame:
    """Shuffle a stream within bounded buffers of each task; stateless, no exchange."""
    return buffer_shuffle(stream, key, seed, buffer)


def stream_corrupt(
    stream: DataFrame, candidates: DataFrame, key: str, seed, ids: str = "input_ids", p: float = MASK_PROB, temperature: float = 1.0
) -> DataFrame:
    """Corrupt a stream of encoded sequences with written proposals that fit in a broadcast; stateless.

    ``drain_corrupted`` takes proposals of any size, and so does this on a micro-batch of ``drain_through``.
    """
    if not stream.isStreaming:
        return corrupt_sequences(stream, candidates, key, seed, ids, p, temperature=temperature)
    table = proposal_table(tempered(candidates, temperature))
    if table is None:
        raise ValueError("these proposals are too many to broadcast: use drain_corrupted")
    fn = corrupt_arrays(candidates.sparkSession, table, p)
    made = stream.withColumn("_c", fn(F.col(ids), mask_state(seed, key), sample_state(seed, key)))
    return made.select(*stream.columns, "_c.*")


def drain_corrupted(
    stream: DataFrame, candidates: DataFrame, key: str, seed, out: str, state: str, ids: str = "input_ids", p: float = MASK_PROB, **options
) -> DataFrame:
    """Corrupt a stream to the end of what is there, micro-batch by micro-batch, with proposals of any size; all its rows.

    Each micro-batch goes through ``corrupt_sequences``, which joins proposals that are too many to broadcast. ``options`` are those
    of ``corrupt_sequences``.
    """
    return drain_through(stream, lambda rows: corrupt_sequences(rows, candidates, key, seed, ids, p, **options), out, state)


def drain_through(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, state: str) -> DataFrame:
    """Run a stream to the end of what is there, each micro-batch through ``step``, which may join and shuffle; all its rows.

    A micro-batch is written under its own number, so a repeated one replaces itself. ``step`` treats rows one by one: what it makes
    of a row must not depend on the others of a micro-batch.
    """

    def publish(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    like = step(stream.sparkSession.createDataFrame([], stream.schema))
    stream.writeStream.option("checkpointLocation", state).foreachBatch(publish).trigger(availableNow=True).start().awaitTermination()
    return _written(like.withColumn("batch", F.lit(0).cast("long")), out).drop("batch")


def _written(like: DataFrame, path: str) -> DataFrame:
    """The rows at a path, or none if nothing was written there yet."""
    spark = like.sparkSession
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def drain(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Run a stateless stream to the end of what is there and return all rows written so far."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _written(stream, out)


def metric_table(df: DataFrame, pred="pred", target="target", by=("epoch", "split")) -> DataFrame:
    """Regression metrics per (epoch, split).

    Each is made of mergeable aggregates, so the state holds a few numbers per group. An exact AUROC has no bounded
    state: the batch operator is exact, ``stream_auroc`` works on a histogram.
    """
    p, t = F.col(pred).cast("double"), F.col(target).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rmse_of(p, t).alias("rmse"),
        mae_of(p, t).alias("mae"),
        pearson_of(p, t).alias("pearsonr"),
    )


def run_metrics(metrics: DataFrame, publish: Callable[[DataFrame, int], None], state_path: str, **trigger) -> StreamingQuery:
    """Keep the running metrics of a stream and hand every updated table to ``publish``.

    Complete mode: the table has one row per (epoch, split), whatever the stream's length.
    """
    return (
        metrics.writeStream.outputMode("complete")
        .option("checkpointLocation", state_path)
        .foreachBatch(publish)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def drain_table(table: DataFrame, out: str, state: str) -> DataFrame:
    """Run a streaming aggregate to the end of what is there and return its last state.

    Each batch writes the whole (small) table under its own batch number, so it can be read while the stream runs, a repeated
    batch overwrites itself, and the last table is found on disk even if there is no new batch.
    """

    def publish(now: DataFrame, batch: int) -> None:
        now.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    run_metrics(table, publish, state).awaitTermination()
    numbered = _written(table.withColumn("batch", F.lit(0).cast("long")), out)
    last = numbered.agg(F.max("batch")).first()[0]
    return numbered.filter(F.col("batch") == last).drop("batch") if last is not None else numbered.drop("batch")


def stream_metrics(stream: DataFrame, out: str, state: str, pred="pred", target="target", by=("epoch", "split")) -> DataFrame:
    """Drain a stream of predictions and return its regression metrics."""
    return drain_table(metric_table(stream, pred, target, by), out, state)


def stream_auroc(stream: DataFrame, out: str, state: str, bins: int | None, pred="pred", target="target", by=("epoch", "split")) -> DataFrame:
    """Area under the curve of a stream of scores.

    With ``bins`` the state is a histogram of scores in [0, 1], at most bins + 1 rows per group however long the stream; a score
    outside is an error, and scores in one bin count as ties, so multiples of 1 / bins give the exact area. With None the state
    has a row per distinct score, and the area is exact for any scores.
    """
    score = F.col(pred).cast("double")
    if bins is not None:
        outside = F.raise_error(F.lit("a score is outside [0, 1]")).cast("double")
        score = F.floor(F.when((score < 0) | (score > 1), outside).otherwise(score) * bins + 0.5)
    return area(drain_table(score_counts(stream, score, target, by), out, state), by)


def sketch_bound(k: int = SKETCH_K, points: int = SKETCH_POINTS) -> float:
    """How far ``stream_auroc_sketch`` is off at most, at 99 % confidence: for each of two sketches its rank error and half a point."""
    factor, power = SKETCH_ERROR
    return 2 * (factor / k**power + 0.5 / points)


def stream_auroc_sketch(
    stream: DataFrame, out: str, state: str, k: int = SKETCH_K, pred="pred", target="target", by=("epoch", "split"), points: int = SKETCH_POINTS
) -> DataFrame:
    """(by..., n_positive, n_negative, roc): area under the curve of any scores with bounded state.

    The state is two quantile sketches per group, of the positives' and of the negatives' scores, whose size doesn't grow with the
    stream. Each is read at ``points`` quantiles, which are scores of the stream, and the area of these points is exact, so ties
    count half. The error is below ``sketch_bound``.
    """
    score = checked_score(F.col(pred).cast("double"))
    positive, negative = F.when(F.col(target) == 1, score), F.when(F.col(target) != 1, score)
    table = stream.groupBy(*by).agg(
        F.count(positive).alias("n_positive"),
        F.count(negative).alias("n_negative"),
        F.kll_sketch_agg_double(positive, F.lit(k)).alias("_p"),
        F.kll_sketch_agg_double(negative, F.lit(k)).alias("_n"),
    )
    places = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    drained = drain_table(table, out, state)

    def read(sketch: str, size: str) -> DataFrame:
        return drained.filter(F.col(size) > 0).select(*by, F.explode(F.kll_sketch_get_quantile_double(sketch, places)).alias("_s"))

    counts = [
        read("_p", "n_positive").select(*by, "_s", F.lit(1).alias("_p"), F.lit(0).alias("_n")),
        read("_n", "n_negative").select(*by, "_s", F.lit(0).alias("_p"), F.lit(1).alias("_n")),
    ]
    summed = counts[0].unionByName(counts[1]).groupBy(*by, "_s").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    roc = area(summed, by).select(*[F.col(c).alias(f"_k_{c}") for c in by], "roc")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    return drained.join(roc, same, "left").select(*by, "n_positive", "n_negative", "roc")


def _steps_done(like: DataFrame, out: str) -> int:
    """Micro-batches written so far; they are numbered from 0 without gaps."""
    last = _written(like, out).agg(F.max("batch")).first()[0]
    return 0 if last is None else last + 1


def stream_limit(stream: DataFrame, steps: int, out: str, state: str) -> DataFrame:
    """Take a bounded number of micro-batches from a stream and return their rows.

    The size of a step is the source's maxFilesPerTrigger. A step is one run of the query, whose trigger lets one micro-batch
    through; it is stopped once that batch is committed. So no batch past the last step is ever started, and a later run with more
    steps goes on after it. Steps count from the stream's beginning.
    """
    numbered = stream.withColumn("batch", F.lit(0).cast("long"))

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    done = _steps_done(numbered, out)
    while done < steps:
        query = stream.writeStream.option("checkpointLocation", state).foreachBatch(publish).trigger(processingTime=ONE_BATCH).start()
        try:
            _await_batch(query)
        finally:
            query.stop()
        if query.exception() is not None:
            raise query.exception()
        now = _steps_done(numbered, out)
        if now == done:
            break
        done = now
    return _written(numbered, out).filter(F.col("batch") < steps).drop("batch")


def _await_batch(query: StreamingQuery) -> None:
    """Wait until a query that lets one micro-batch through has committed it, or has found nothing new."""
    while query.isActive:
        status, progress = query.status, query.lastProgress
        if status["message"] == IDLE and not status["isTriggerActive"] or progress is not None and progress["numInputRows"]:
            return
        time.sleep(POLL_SECONDS)
