"""Exact length histogram of a tokenised corpus.

Documents are encoded whole; each Arrow batch is reduced to (length, documents) before anything is shuffled, so the rest works
on one row per distinct length. Suffix sums over it answer totals, quantiles and truncated totals for every context limit:
for a limit L between two lengths, truncated total = tokens of the shorter documents + L * documents at or above L.

The sums go in two levels, blocks of BLOCK lengths and the lengths inside one, so no task holds all lengths.
Null text is an empty one, of length 0. Long texts are encoded whole, one at a time. Repeated rows count as they stand, and rows of
one length, ties, are one row of the histogram. An empty table has an empty histogram. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molweave.llm.tokens import Vocabulary, public_vocabulary
from molweave.llm.words import pieces
from molweave.sources.scratch import stored

BLOCK = 4096


def length_histogram(documents: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length."""
    vocabulary = vocabulary or public_vocabulary()

    def count(batches):
        encoder = vocabulary.encoder()
        for piece in pieces(batches, "text"):
            lengths = [len(vocabulary.encode(t, encoder)) if t else 0 for t in piece.column("text").to_pylist()]
            value, n = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.record_batch([pa.array(value), pa.array(n.astype(np.int64))], names=["n_tokens", "n"])

    partial = documents.select("text").mapInArrow(count, "n_tokens long, n long")
    return partial.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """Per distinct length, taken as a context limit:

    n_docs and tokens of that length, docs_at_least and tokens_at_least (suffix sums), docs_below and tokens_below,
    truncated_total (tokens left if every document is cut there) and share_at_most (the quantile that the length is).
    """
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    totals = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    above = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_block",
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{name}") for name, w in (("up", above), ("low", below)) for c in ("_d", "_t")],
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("n_tokens"))
    before = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, "_block")
    sums = joined.select(
        "n_tokens",
        "n_docs",
        "tokens",
        (F.sum("n_docs").over(inside) + F.col("_d_up")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("_t_up")).alias("tokens_at_least"),
        (F.coalesce(F.sum("n_docs").over(before), F.lit(0)) + F.col("_d_low")).alias("docs_below"),
        (F.coalesce(F.sum("tokens").over(before), F.lit(0)) + F.col("_t_low")).alias("tokens_below"),
    )
    return sums.withColumn("truncated_total", F.col("tokens_below") + F.col("n_tokens") * F.col("docs_at_least")).withColumn(
        "share_at_most", (F.col("docs_below") + F.col("n_docs")) / (F.col("docs_below") + F.col("docs_at_least"))
    )


def at_limits(table: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit, docs_cut, truncated_total) for any context limits (a table with a column ``limit``).

    A limit is answered by the shortest length that is at or above it: that length's sums below it are the whole ones.
    """
    marks = table.select(F.col("n_tokens").alias("_at"), "docs_at_least", "tokens_below", "n_docs", "tokens")
    marked = limits.select("limit").distinct().join(marks, F.col("_at") >= F.col("limit"))
    first = marked.groupBy("limit").agg(F.min_by(F.struct("_at", "docs_at_least", "tokens_below", "n_docs"), "_at").alias("m"))
    whole = table.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("_all"))
    answered = limits.select("limit").distinct().join(first, "limit", "left").join(F.broadcast(whole))
    cut = F.col("m.docs_at_least") - F.when(F.col("m._at") == F.col("limit"), F.col("m.n_docs")).otherwise(0)
    return answered.select(
        "limit",
        F.coalesce(cut, F.lit(0)).alias("docs_cut"),
        F.coalesce(F.col("m.tokens_below") + F.col("limit") * F.col("m.docs_at_least"), F.col("_all")).alias("truncated_total"),
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the smallest length that at least ``share`` of the documents don't exceed."""
    return table.filter(F.col("share_at_most") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame) -> DataFrame:
    """The limit table of a corpus. The histogram is written once, since both levels of the sums read it."""
    return limit_table(stored(length_histogram(documents), "lengths"))
