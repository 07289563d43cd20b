"""Streams whose state lives as long as they do: a sliding shuffle buffer, batches assembled across micro-batches, early stopping.

Each is a ``transformWithState`` over shards or runs, so state is kept by Spark in its checkpoint, survives lost executors and
restarts, and is bounded by the arguments, not by the stream. The session must keep state in RocksDB (``use_rocksdb``). The rows
that are still held when a stream is drained are read from that state; they stay there and go on with the stream.

Inside a micro-batch rows are taken in a stated order, so a replayed batch gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from molweave.functions.hashing import key_hash
from molweave.operators.ordering import SHUFFLE_BUFFER
from molweave.operators.runs import goal_sign
from molweave.streaming.jobs import drain

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Shards of a stream: each has its own buffer or open batch, and is worked on by one task at a time.
SHARDS = 8


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, which these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _held(spark: SparkSession, state: str, name: str) -> DataFrame:
    """The values of a list state as of the last committed micro-batch: (key, list_element)."""
    return spark.read.format("statestore").option("stateVarName", name).load(state)


def _named(names: list[str], *values) -> Row:
    return Row(**dict(zip(names, values)))


def _shard(key: str, shards: int):
    return (key_hash("shard", key) % shards).cast("int")


# ---- sliding shuffle ----------------------------------------------------------------------------------------------------


class _Slots(StatefulProcessor):
    """A buffer of rows per shard: a new row takes a hashed slot, and what lay there comes out."""

    def __init__(self, schema: T.StructType, buffer: int, out: list[str]):
        self.schema, self.buffer, self.out = schema, buffer, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)
        self.turns = handle.getValueState("turns", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.rows.get()]
        turn = self.turns.get()[0] if self.turns.exists() else 0
        for row in sorted(rows, key=lambda r: r["_draw"]):
            own = tuple(row)[1:]
            if len(held) < self.buffer:
                held.append(own)
                continue
            slot = row["_draw"] % self.buffer
            out, held[slot] = held[slot], own
            yield _named(self.out, *key, turn, *out)
            turn += 1
        self.rows.put(held)
        self.turns.update((turn,))

    def close(self) -> None:
        pass


def sliding_shuffle(stream: DataFrame, key: str, seed, buffer: int = SHUFFLE_BUFFER, shards: int = SHARDS) -> DataFrame:
    """(shard, turn, _draw, the stream's columns): rows in a new order, through one buffer per shard for the whole stream.

    A shard holds ``buffer`` / ``shards`` rows. Once it is full, each new row replaces one at a hashed place, which comes out as the
    shard's next turn; so a row can move any number of micro-batches. Rows still held are those of ``shuffled_rest``.
    """
    own = T.StructType([T.StructField("_draw", T.LongType()), *stream.schema.fields])
    out = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("turn", T.LongType()), *own.fields])
    drawn = stream.select(_shard(key, shards).alias("shard"), key_hash(seed, key).alias("_draw"), "*")
    slots = _Slots(own, max(1, buffer // shards), out.names)
    return drawn.groupBy("shard").transformWithState(slots, out, "Append", "None")


def shuffled_rest(stream: DataFrame, state: str, emitted: DataFrame) -> DataFrame:
    """The rows that the buffers of a drained shuffle hold, in the order of their draws, as turns after those ``emitted``."""
    held = _held(stream.sparkSession, state, "rows").select(F.col("key.shard").alias("shard"), "list_element.*")
    done = emitted.groupBy("shard").agg((F.max("turn") + 1).alias("_done"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("_draw")) - 1
    numbered = held.withColumn("_place", place).join(F.broadcast(done), "shard", "left")
    return numbered.withColumn("turn", F.coalesce("_done", F.lit(0)) + F.col("_place")).select("shard", "turn", "_draw", *stream.columns)


def drain_shuffled(stream: DataFrame, key: str, seed, out: str, state: str, buffer: int = SHUFFLE_BUFFER, shards: int = SHARDS) -> DataFrame:
    """Run a stream through the sliding shuffle to the end of what is there; (shard, turn, columns) of all its rows."""
    use_rocksdb(stream.sparkSession)
    emitted = drain(sliding_shuffle(stream, key, seed, buffer, shards), out, state)
    return emitted.unionByName(shuffled_rest(stream, state, emitted)).drop("_draw")


# ---- batches --------------------------------------------------------------------------------------------------------------


class _OpenBatch(StatefulProcessor):
    """The rows of a shard that don't fill a batch yet, and the number of the batch they will be."""

    def __init__(self, schema: T.StructType, columns: list[str], batch_size: int):
        self.schema, self.columns, self.batch_size = schema, columns, batch_size
        self.out = ["shard", "batch_id", "n_rows", *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)
        self.next = handle.getValueState("next", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = [tuple(r) for r in self.rows.get()]
        number = self.next.get()[0] if self.next.exists() else 0
        names = self.schema.names
        at = [names.index(c) for c in self.columns]
        for row in sorted((tuple(r)[1:] for r in rows), key=lambda r: r[0]):
            waiting.append(row)
            if len(waiting) == self.batch_size:
                yield _named(self.out, *key, number, len(waiting), *[[r[k] for r in waiting] for k in at])
                waiting, number = [], number + 1
        self.rows.put(waiting) if waiting else self.rows.clear()
        self.next.update((number,))

    def close(self) -> None:
        pass


def stream_collate(stream: DataFrame, key: str, order: str, columns: list[str], batch_size: int, shards: int = SHARDS) -> DataFrame:
    """(shard, batch_id, n_rows, one array per column): whole batches, each of rows that follow one another in a shard.

    Rows of a micro-batch follow in ``order`` (a column without nulls) after those of earlier ones; what doesn't fill a batch waits for the next
    micro-batch. A task holds a micro-batch's rows of a shard.
    """
    fields = {f.name: f for f in stream.schema.fields}
    own = T.StructType([T.StructField("_order", fields[order].dataType), *[fields[c] for c in columns]])
    arrays = [T.StructField(c, T.ArrayType(fields[c].dataType)) for c in columns]
    head = [T.StructField("shard", T.IntegerType()), T.StructField("batch_id", T.LongType()), T.StructField("n_rows", T.IntegerType())]
    placed = stream.select(_shard(key, shards).alias("shard"), F.col(order).alias("_order"), *columns)
    return placed.groupBy("shard").transformWithState(_OpenBatch(own, list(columns), batch_size), T.StructType([*head, *arrays]), "Append", "None")


def drain_batches(
    stream: DataFrame, key: str, order: str, columns: list[str], batch_size: int, out: str, state: str, shards: int = SHARDS
) -> DataFrame:
    """Run ``stream_collate`` to the end of what is there; all batches, the last of a shard may be short."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    whole = drain(stream_collate(stream, key, order, columns, batch_size, shards), out, state)
    held = _held(spark, state, "rows").select(F.col("key.shard").alias("shard"), "list_element.*")
    # A short batch holds fewer rows than a whole one, so its shard's group is bounded.
    cells = held.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_order", *columns))).alias("cells"))
    done = whole.groupBy("shard").agg((F.max("batch_id") + 1).alias("_done"))
    short = cells.join(F.broadcast(done), "shard", "left").select(
        "shard",
        F.coalesce("_done", F.lit(0)).cast("long").alias("batch_id"),
        F.size("cells").alias("n_rows"),
        *[F.col(f"cells.{c}").alias(c) for c in columns],
    )
    return whole.unionByName(short)


# ---- early stopping -----------------------------------------------------------------------------------------------------

RUN_STATE = T.StructType(
    [T.StructField("step", T.LongType()), T.StructField("best", T.DoubleType()), T.StructField("best_step", T.LongType()), T.StructField("epoch", T.LongType())]
)
FOLLOWED = "run string, name string, epoch long, value double, step long, improved boolean, best double, waited long, event string"
FOLLOWED_NAMES = [f.split()[0] for f in FOLLOWED.split(", ")]
NEVER = float("-inf")


class _Patience(StatefulProcessor):
    """Best score, its step and the last epoch of a run's metric."""

    def __init__(self, patience: int | None, silent_ms: int | None):
        self.patience, self.silent_ms = patience or 0, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", RUN_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        step, best, best_step, epoch = self.run.get() if self.run.exists() else (0, None, 0, None)
        for row in sorted(rows, key=lambda r: r["epoch"]):
            step += 1
            epoch, value, sign = row["epoch"], row["value"], row["sign"]
            score = None if value is None or value != value else sign * value
            improved = score is not None and score > (NEVER if best is None else best)
            if improved:
                best, best_step = score, step
            elif best is None:
                best = score
            waited = step - best_step
            event = "stop" if self.patience > 0 and waited == self.patience else "epoch"
            yield _named(FOLLOWED_NAMES, *key, epoch, value, step, improved, None if best is None else sign * best, waited, event)
        self.run.update((step, best, best_step, epoch))
        if self.silent_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        step, best, best_step, epoch = self.run.get()
        yield _named(FOLLOWED_NAMES, *key, epoch, None, step, False, None, step - best_step, "silent")

    def close(self) -> None:
        pass


def stream_early_stop(
    log: DataFrame, patience: int | None, goals: dict[str, str], silent_ms: int | None = None, run="run", epoch="epoch", name="name", value="value"
) -> DataFrame:
    """Follow a stream of (run, epoch, name, value): each row with step, improved, best, waited and event.

    event is "stop" on the row at which ``patience`` epochs brought no improvement, "epoch" on others, and "silent" on a row of its
    own when a run has sent nothing for ``silent_ms`` of processing time. Steps count in the order of epochs inside a micro-batch, and
    micro-batches follow one another; with epochs that come in order the rows are those of ``running_best``. NaN and null never
    improve. State is four numbers per run and metric.
    """
    rows = log.select(
        F.col(run).cast("string").alias("run"),
        F.col(name).alias("name"),
        F.col(epoch).cast("long").alias("epoch"),
        F.col(value).cast("double").alias("value"),
        goal_sign(F.col(name), goals).alias("sign"),
    )
    times = "None" if silent_ms is None else "ProcessingTime"
    return rows.groupBy("run", "name").transformWithState(_Patience(patience, silent_ms), T._parse_datatype_string(FOLLOWED), "Append", times)


def stops(followed: DataFrame) -> DataFrame:
    """(run, name, stop_epoch, last_epoch) of drained rows, as ``early_stop_epoch`` has them."""
    rows = followed.filter("event <> 'silent'")
    stopped = F.min(F.when(F.col("event") == "stop", F.col("epoch")))
    return rows.groupBy("run", "name").agg(stopped.alias("stop_epoch"), F.max("epoch").alias("last_epoch"))
