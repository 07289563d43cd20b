"""Exact deduplication by content sort.

Texts are normalised by deleting white space and range-partitioned by sampled splitters. The splitting key is the beginning of
the normalised text, then a hash of all of it, then length and id: the splitters stay small whatever the texts are, equal
texts come together, and even a text that a third of all rows share is cut into even parts. Each part is sorted by Spark's
external sort, the full text among its keys, and neighbours are compared in full. Rows of a run of equals are in order of
preference, so the first row of a run is the one that stays. Runs with the hash of a part's first or last row are joined with
their like in the next parts by their full texts: two runs a part, and more only where different texts share a 64-bit hash.

The row with the most code points in the original text stays, then the smallest id (a null id last). A null text counts as
empty and equals texts of white space alone. Rows that repeat an id are rows of their own; one row of each group is kept.
An empty table gives an empty result. Extra columns are ignored (``exact_dedup``) or passed through (``keep_first``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molweave.llm.words import pieces
from molweave.sources.scratch import stored

# Characters of the normalised text that the splitters see before its hash.
SPLIT_CHARS = 32

# A row of a run, or a mark (``edge_text`` not null) with the size and the kept id of a run at an edge.
RUN_SCHEMA = (
    "doc_id long, row_no long, keep_id long, group_size long, kept boolean, text_sha256 string, part int, run long, edge_text string"
)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def content_sorted(documents: DataFrame) -> DataFrame:
    """(doc_id, row_no, norm, hash) in content order within and across partitions; better rows of equals come first.

    Parts are cut by (head, hash, preference) and sorted by the full text within a hash, so texts that share head and hash may
    alternate between the parts on both sides of a cut.
    """
    rows = documents.select(
        "doc_id",
        "row_no",
        normalised(F.col("text")).alias("norm"),
        (-F.char_length(F.coalesce("text", F.lit("")))).alias("shortness"),
    ).select("*", F.substring("norm", 1, SPLIT_CHARS).alias("head"), F.xxhash64("norm").alias("hash"))
    preference = [F.asc("shortness"), F.asc_nulls_last("doc_id"), F.asc("row_no")]
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, F.asc("head"), F.asc("hash"), *preference)
    return placed.sortWithinPartitions("head", "hash", "norm", *preference).select("doc_id", "row_no", "norm", "hash")


def neighbour_runs(batches):
    """Compare neighbours in full. A run is given out when it ends, so its size is known; every run with the hash of the first
    or the last row of the partition may go on beyond its edge, and one further row carries its text, size and kept id."""
    part = TaskContext.get().partitionId()
    names = [field.strip().split(" ")[0] for field in RUN_SCHEMA.split(",")]
    run = 0
    text, code, ids, numbers = None, None, [], []
    first_code, open_runs = None, []

    def rows_of(doc_id, row_no, sizes, starts, shas) -> pa.RecordBatch:
        """Rows of whole runs; ``starts`` are their first places in the arrays."""
        which = np.repeat(np.arange(len(sizes)), sizes)
        kept = np.zeros(len(which), bool)
        kept[starts] = True
        return pa.RecordBatch.from_arrays(
            [
                doc_id,
                row_no,
                doc_id.take(pa.array(starts[which])),
                pa.array(sizes[which]),
                pa.array(kept),
                pa.array(shas, pa.string()).take(pa.array(which)),
                pa.array(np.full(len(which), part, np.int32)),
                pa.array(run + which),
                pa.nulls(len(which), pa.string()),
            ],
            names=names,
        )

    def marks() -> pa.RecordBatch:
        n = len(open_runs)
        numbers, texts, sizes, keeps = zip(*open_runs, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()),
                pa.array(keeps, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.nulls(n, pa.bool_()),
                pa.nulls(n, pa.string()),
                pa.array([part] * n, pa.int32()),
                pa.array(numbers, pa.int64()),
                pa.array(texts, pa.string()),
            ],
            names=names,
        )

    def ended(number: int, run_code: int, run_text: str, size: int, keep) -> Iterator[pa.RecordBatch]:
        """Take note of a run that ended; gives the marks of the hash before, if it is that of the part's first row."""
        nonlocal first_code, open_runs, code
        if first_code is None:
            first_code = run_code
        elif run_code != code:
            if code == first_code:
                yield marks()
            open_runs = []
        code = run_code
        open_runs.append((number, run_text, size, keep))

    def end_held() -> Iterator[pa.RecordBatch]:
        doc_id, row_no = pa.concat_arrays(ids), pa.concat_arrays(numbers)
        n = len(doc_id)
        yield rows_of(doc_id, row_no, np.array([n]), np.array([0]), [hashlib.sha256(text.encode()).hexdigest()])
        yield from ended(run, held_code, text, n, doc_id[0].as_py())

    for batch in pieces(batches, "norm"):
        norm, doc_id, row_no = batch.column("norm"), batch.column("doc_id"), batch.column("row_no")
        codes = batch.column("hash").to_numpy()
        fresh = np.ones(len(norm), bool)
        if len(norm) > 1:
            fresh[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = text is None or norm[0].as_py() != text
        starts = np.flatnonzero(fresh)
        head = int(starts[0]) if len(starts) else len(norm)
        if head:
            ids.append(doc_id[:head])
            numbers.append(row_no[:head])
        if not len(starts):
            continue
        if text is not None:
            yield from end_held()
            run += 1
        # Runs that begin and end inside this piece.
        begins, stops = starts[:-1], starts[1:]
        if len(begins):
            sizes = stops - begins
            texts = norm.take(pa.array(begins)).to_pylist()
            low, high = int(begins[0]), int(stops[-1])
            shas = [hashlib.sha256(x.encode()).hexdigest() for x in texts]
            yield rows_of(doc_id[low:high], row_no[low:high], sizes, begins - low, shas)
            keeps = doc_id.take(pa.array(begins)).to_pylist()
            for i, (one, keep) in enumerate(zip(texts, keeps, strict=True)):
                yield from ended(run + i, int(codes[begins[i]]), one, int(sizes[i]), keep)
            run += len(sizes)
        last = int(starts[-1])
        text, held_code = norm[last].as_py(), int(codes[last])
        ids, numbers = [doc_id[last:]], [row_no[last:]]
    if text is not None:
        yield from end_held()
        yield marks()


def grouped_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, row_no, keep_id, group_size, kept, text_sha256) of every row."""
    runs = stored(content_sorted(documents).mapInArrow(neighbour_runs, RUN_SCHEMA), "runs")
    rows = runs.filter("edge_text IS NULL").drop("edge_text")
    # The runs of two hashes a partition: joined by their full texts.
    edges = runs.filter("edge_text IS NOT NULL").select(
        "part", "run", "edge_text", F.col("group_size").alias("n"), F.col("keep_id").alias("keep")
    )
    place = F.struct("part", "run")
    whole = edges.groupBy("edge_text").agg(
        F.sum("n").alias("all_size"), F.min_by("keep", place).alias("all_keep"), F.min(place).alias("root")
    )
    fixed = edges.join(whole, "edge_text").select("part", "run", "all_size", "all_keep", (F.col("root") == place).alias("is_root"))
    joined = rows.join(fixed, ["part", "run"], "left")
    return joined.select(
        "doc_id",
        "row_no",
        F.when(F.col("is_root").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")).alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("kept") & F.coalesce("is_root", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def exact_dedup(documents: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_no"), "text")
    return grouped_rows(rows).drop("row_no")


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with its own columns.

    Rows that repeat an id can't be told apart by it: of the rows of a kept id with the kept text, the numbering below keeps one.
    """
    own = documents.columns
    kept = exact_dedup(documents).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(normalised(F.col("text")), 256)
    length = F.char_length(F.coalesce("text", F.lit("")))
    packed = documents.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_own"), sha.alias("_own_sha"), length.alias("_cp"))
    same = packed["_own"].eqNullSafe(kept["_id"]) & (packed["_own_sha"] == kept["_sha"])
    joined = packed.join(kept, same)
    order = Window.partitionBy("_own", "_own_sha").orderBy(F.desc("_cp"))
    first = joined.withColumn("_no", F.row_number().over(order)).filter("_no = 1")
    return first.select(*[F.col(f"_doc.`{c}`").alias(c) for c in own])
