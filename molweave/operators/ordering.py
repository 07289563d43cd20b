"""Reproducible order: full shuffle, block shuffle, dense index, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.functions.hashing import uniform
from molweave.sources.scratch import stored

# Fixed value: rows of a shuffle buffer.
SHUFFLE_BUFFER = 10_000
# Buckets per shuffle partition: many small buckets spread evenly, and their offsets still fit in a broadcast.
BUCKETS_PER_PARTITION = 16
MAX_BUCKETS = 1_000_000


def _prefix_offsets(sizes: DataFrame, bucket: str) -> DataFrame:
    """(bucket, offset): rows before each bucket. One row per bucket enters the single-task window."""
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(bucket, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


def global_shuffle(
    df: DataFrame, key: str, seed, take: int | None = None, out: str = "idx", buckets: int | None = None, bucket_out: str | None = None
) -> DataFrame:
    """Rows with a dense index in the order of (u(seed, key), key); ``key`` is unique.

    u is uniform, so cutting [0, 1) into equal buckets gives balanced ordered groups without sampling. A first pass over
    the key column alone counts the buckets; the rows are then shuffled once, by bucket, and numbered inside it.
    ``take`` keeps the first rows of the order: buckets past it are dropped before the shuffle. ``seed`` is any text, so
    a new order per epoch is a seed that names the epoch.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or min(partitions * BUCKETS_PER_PARTITION, MAX_BUCKETS)
    draw = uniform(seed, key)
    bucket = F.floor(draw * buckets).cast("int")
    sizes = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("size"))
    offsets = _prefix_offsets(sizes, "_bucket")
    if take is not None:
        offsets = offsets.filter(F.col("offset") < take)
    placed = df.withColumn("_u", draw).withColumn("_bucket", bucket).join(F.broadcast(offsets), "_bucket")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_u", key))
    indexed = placed.withColumn(out, F.col("offset") + inside - 1).drop("_u", "offset")
    indexed = indexed.withColumnRenamed("_bucket", bucket_out) if bucket_out else indexed.drop("_bucket")
    return indexed if take is None else indexed.filter(F.col(out) < take)


def dense_index(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """Rows with a dense index in the order of columns that together identify a row.

    A value shared by many rows is then split by the columns after it.

    Range partitioning places rows by sampled bounds, so the placed rows are stored once; counting the partitions and
    reading the rows back then see the same layout. Nothing is ordered in a single task.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", local), "ordered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("size"))
    offsets = _prefix_offsets(sizes, "_part")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("offset") + F.col("_place"))
        .drop("_part", "_place", "offset")
    )


def buffer_shuffle(df: DataFrame, key: str, seed, buffer: int = SHUFFLE_BUFFER) -> DataFrame:
    """Shuffle inside buffers of ``buffer`` consecutive rows of a partition: adds block (the buffer's number there) and place.

    Rows come out in the new order and stay within their buffer, which is what a bounded shuffle is for: a task holds one buffer,
    nothing is exchanged, and a stream can be shuffled like a table. Buffers follow the order in which rows are read.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("block", T.LongType()), T.StructField("place", T.LongType())])

    def shuffled(rows: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by([("_u", "ascending"), (key, "ascending")]).drop_columns(["_u"])
        n = rows.num_rows
        rows = rows.append_column("block", pa.array(np.full(n, block))).append_column("place", pa.array(np.arange(n)))
        yield from rows.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, buffer - size)
                held.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == buffer:
                    yield from shuffled(pa.Table.from_batches(held), block)
                    held, size, block = [], 0, block + 1
        if held:
            yield from shuffled(pa.Table.from_batches(held), block)

    return df.withColumn("_u", uniform(seed, key)).mapInArrow(run, schema)


def with_row_key(df: DataFrame, *columns: str, out: str = "row_key") -> DataFrame:
    """Add a unique text key for rows that have none: a hash of the columns (all if none are named), and a number among equals."""
    names = columns or df.columns
    content = F.md5(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    same = Window.partitionBy("_content").orderBy("_content")
    numbered = df.withColumn("_content", content).withColumn("_no", F.row_number().over(same))
    return numbered.withColumn(out, F.concat_ws("-", "_content", F.col("_no").cast("string"))).drop("_content", "_no")


def assign_batches(df: DataFrame, batch_size: int, idx: str = "idx") -> DataFrame:
    """Consecutive rows form a batch; the last one may be short."""
    return df.withColumn("batch_id", F.floor(F.col(idx) / batch_size))


def take_steps(df: DataFrame, steps: int) -> DataFrame:
    """The first ``steps`` batches."""
    return df.filter(F.col("batch_id") < steps)


def first_batches(df: DataFrame, key: str, seed, batch_size: int, steps: int) -> DataFrame:
    """The first ``steps`` batches of the shuffled corpus, shuffling only the rows that can be in them."""
    return take_steps(assign_batches(global_shuffle(df, key, seed, take=steps * batch_size), batch_size), steps)


def collate_batches(
    df: DataFrame, *columns: str, idx: str = "idx", batch_size: int | None = None, bucket: str | None = None
) -> DataFrame:
    """(batch_id, n_rows, one array per column) in row order. A group is one batch.

    With the ``bucket`` that ``global_shuffle`` kept and the ``batch_size``, rows are collated where that shuffle put them, and only
    batches that lie across two buckets are shuffled again, two a bucket.
    """
    cell = F.struct(idx, *columns)
    if bucket is None:
        grouped = df.groupBy("batch_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    else:
        if batch_size is None:
            raise ValueError("name the batch size along with the bucket")
        parts = df.groupBy(bucket, "batch_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        whole = parts.filter(F.size("cells") == batch_size).select("batch_id", "cells")
        torn = parts.filter(F.size("cells") != batch_size).groupBy("batch_id")
        grouped = whole.unionByName(torn.agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells")))
    return grouped.select("batch_id", F.size("cells").alias("n_rows"), *[F.col(f"cells.{c}").alias(c) for c in columns])
