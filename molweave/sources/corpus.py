"""Corpora: named splits, streams, column projection, column batches, vocabulary and metric tables."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.functions.hashing import uniform
from molweave.sources.scratch import stored

SPLITS = ["train", "validation", "test"]
SPLIT_SEED = "split"
# Folder column of a metric log: one folder a record.
RECORD = "record"
# Rows of a file of a stream's step.
STEP_FILE_ROWS = 10_000
# Upper edges of the hash ranges of train and validation; test is the rest.
SPLIT_EDGES = [0.8, 0.9]

# The columns of the two public pretraining corpora and of the fine-tune sets.
# kind -> (id column, text column, columns that go once the text is encoded)
SOURCE_KINDS = {
    "pubchem": (
        "PUBCHEM_COMPOUND_CID",
        "CAN_SELFIES",
        ["PUBCHEM_COMPOUND_CID", "CAN_SELFIES", "PUBCHEM_OPENEYE_CAN_SMILES", "tokenized"],
    ),
    "zinc20": ("id", "selfies", ["selfies", "tokenized", "smiles", "id"]),
    "finetune_selfies": (None, "selfies", ["smiles", "selfies", "tokenized"]),
    "finetune_smiles": (None, "smiles", ["smiles", "selfies", "tokenized"]),
}


def split_of(*keys) -> Column:
    """Split name drawn from the row key, for corpora that carry no split column."""
    u = uniform(SPLIT_SEED, *keys)
    return F.when(u < SPLIT_EDGES[0], SPLITS[0]).when(u < SPLIT_EDGES[1], SPLITS[1]).otherwise(SPLITS[2])


def load_corpus(spark: SparkSession, path: str, split: str | None = None, key: str | None = None) -> DataFrame:
    """One named split of a parquet corpus, or all of it with its split column.

    With a ``split`` partition column the filter prunes directories; without one, ``key`` decides the split by hash.
    """
    df = spark.read.parquet(path)
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    if "split" in df.columns:
        return df if split is None else df.filter(F.col("split") == split)
    if key is None:
        raise ValueError("the corpus has no split column: name the key that splits it")
    if split is None:
        return df.withColumn("split", split_of(key))
    low, high = dict(zip(SPLITS, zip([0.0, *SPLIT_EDGES], [*SPLIT_EDGES, 1.0])))[split]
    u = uniform(SPLIT_SEED, key)
    return df.filter((u >= low) & (u < high)).withColumn("split", F.lit(split))


def stream_corpus(
    spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same rows as an unbounded source. ``path`` is a folder or a glob."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def files_of_steps(df: DataFrame, steps: int, file_rows: int = STEP_FILE_ROWS) -> int:
    """Files that each of ``steps`` parts of a table is written to, so that one has about ``file_rows`` rows however large the table."""
    return max(1, math.ceil(df.count() / steps / file_rows))


def append_step(df: DataFrame, path: str, name: str, files: int) -> None:
    """Write the rows of one step of a stream as exactly ``files`` files under ``path``/``name``, some of them empty if there are few rows.

    Steps are written one after the other, and a file source reads files in the order of their age. So with ``files`` as its
    maxFilesPerTrigger and ``path``/* as its folder each micro-batch is one step.
    """
    folder = f"{path}/{name}"
    dealt = df.coalesce(1) if files == 1 else df.repartition(files)
    dealt.write.parquet(folder)
    spark = df.sparkSession
    for _ in range(files - len(spark.read.schema(df.schema).parquet(folder).inputFiles())):
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(folder)


def project(df: DataFrame, kind: str) -> DataFrame:
    """Bring a corpus to (mol_id, text[, target]) columns; the scan then reads only those."""
    id_column, text_column, _ = SOURCE_KINDS[kind]
    columns = [F.col(text_column).alias("text")]
    if id_column is not None:
        columns.insert(0, F.col(id_column).alias("mol_id"))
    kept = [c for c in ("target", "split") if c in df.columns]
    return df.select(*columns, *kept)


def drop_source_columns(df: DataFrame, kind: str) -> DataFrame:
    """Drop what encoding has used up."""
    return df.drop(*SOURCE_KINDS[kind][2])


def map_batches(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], dict | pd.DataFrame],
    schema: str | T.StructType,
    remove_columns: list[str] = (),
    batch_size: int | None = None,
) -> DataFrame:
    """Apply fn to batches of columns; its result columns are added to (or replace) the batch's own.

    ``schema`` describes the new columns. Where batches fall depends on the partitioning, so fn must treat rows one by
    one. ``batch_size`` cuts Arrow batches further; it never needs rows of more than one batch in memory.
    """
    added = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    new_names = set(added.names)
    kept = [f for f in df.schema.fields if f.name not in new_names and f.name not in set(remove_columns)]
    out_schema = T.StructType(kept + list(added.fields))
    names = out_schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = batch_size or max(len(batch), 1)
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step].reset_index(drop=True)
                yield part.assign(**dict(fn(part)))[names]

    return df.mapInPandas(run, out_schema)


def save_vocab(vocab: DataFrame, path: str) -> DataFrame:
    """Write a vocabulary and return the written table; an empty one is an error, and nothing is left at ``path``.

    It is counted once, into the shared folder, and checked there.
    """
    counted = stored(vocab, "vocab")
    if counted.filter(F.col("n") > 0).isEmpty():
        raise ValueError("the vocabulary is empty")
    counted.write.mode("errorifexists").parquet(path)
    return vocab.sparkSession.read.schema(vocab.schema).parquet(path)


def log_metrics(metrics: DataFrame, names: list[str], splits: dict[str, str]) -> DataFrame:
    """One wide record per (run, epoch): train_<name>, val_<name>, ...

    ``metrics`` is (run, epoch, split, name, value); ``splits`` maps a split to its prefix. The columns are fixed by the
    arguments, so no pass is needed to find them.
    """
    cells = [
        F.max(F.when((F.col("split") == s) & (F.col("name") == n), F.col("value"))).alias(f"{p}_{n}")
        for s, p in splits.items()
        for n in names
    ]
    return metrics.groupBy("run", "epoch").agg(*cells)


def append_metrics(log: DataFrame, path: str, record: str) -> None:
    """Append rows to a metric log under the name of their record, such as a run and its epoch.

    A record that is written again, by a retried epoch or after a crash, takes the place of the earlier one.
    """
    if not re.fullmatch(r"[\w.-]+", record):
        raise ValueError(f"the name of a record is made of letters, digits, '.', '_' and '-', not {record!r}")
    log.write.mode("overwrite").parquet(f"{path}/{RECORD}={record}")


def read_metrics(like: DataFrame, path: str) -> DataFrame:
    """All records of a metric log with the columns of ``like``."""
    schema = T.StructType([*like.schema.fields, T.StructField(RECORD, T.StringType())])
    return like.sparkSession.read.schema(schema).parquet(path).drop(RECORD)
