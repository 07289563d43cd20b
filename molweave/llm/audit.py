"""Audit of how five document filters interact, over all 120 orders in which they can be applied.

A document's failures are a mask of five bits. What happens to it at a step of an order follows from the mask alone: it is removed
there, or it fails there but was removed earlier. ``wide_counters`` maps every mask to one big integer with a field for each of the
1,200 outcomes (600 removed, 600 redundant), 1 where the outcome holds. Adding such integers adds all their fields at once, so
the sum over the documents of a part, unpacked, holds every count of its 600 rows. A field has WIDTH bits, and a part of
2**WIDTH documents or more is an error, so no field can run over into the next.

Documents are narrowed to (doc_id, part, mask, hash of the text) in one scan and counted by part, mask and labels with map-side
sums, at most 128 rows a part; the integers of those rows times their counts are added per part. A text's smallest id is found on
rows that were summed per (text, part, labels) first, so a group of copies of any size costs four rows a part at most.

Null text is an empty one, and so identical to empty texts; a null source is the part ''. A row without an id has no smaller and
no larger one, so it never fails E; it has no labels. Rows that repeat an id and text don't fail E for one another. A document
that has several label rows counts as good (toxic) if one of them says so. Long texts are words of one row in a task. Extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import string
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
# Bits of a field: more documents than any part holds.
WIDTH = 64
# Bounds of the filters.
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
MARKS = "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def own_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails A, B, C and D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words, n_points = F.size(words), F.length(text)
    capitals = n_points - F.length(F.translate(text, string.ascii_uppercase, ""))
    failures = [
        n_words < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n_words,
        100 * capitals > CAPITAL_PERCENT * n_points,
        text.rlike(MARKS),
    ]
    return sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(failures)), F.lit(0))


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by failures and labels."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        own_mask(text).alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("same"),
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    labelled = narrow.join(marks.filter("doc_id IS NOT NULL"), "doc_id", "left").fillna(False, ["good", "toxic"])
    kinds = ["same", "part", "mask", "good", "toxic"]
    by_id = labelled.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("first"),
        F.min_by("n", "doc_id").alias("n_first"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("n_null"),
    )
    placed = groups.withColumn("smallest", F.min("first").over(Window.partitionBy("same")))
    spared = F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0) + F.col("n_null")
    copy = 1 << FILTERS.index("E")
    cells = F.array(
        F.struct(F.col("mask").alias("mask"), spared.alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - spared).alias("n")),
    )
    both = placed.select("part", "good", "toxic", F.explode(cells).alias("c"))
    counted = both.groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))
    return counted.filter("n > 0")


def wide_counters() -> list[int]:
    """The big integer of each mask: field 5 * order + step is 1 where it removes, field STEPS + that where it fails once more."""
    wide = []
    for mask in range(1 << len(FILTERS)):
        total = 0
        for place, order in enumerate(ORDERS):
            gone = False
            for step, name in enumerate(order):
                if mask >> FILTERS.index(name) & 1:
                    field = len(FILTERS) * place + step + STEPS * gone
                    total += 1 << (WIDTH * field)
                    gone = True
        wide.append(total)
    return wide


def unpack(total: int, fields: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(fields * WIDTH // 8, "little"), f"<u{WIDTH // 8}").astype(np.int64)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with its counts."""
    wide = wide_counters()
    lower = (1 << (WIDTH * STEPS)) - 1
    letters = [[FILTERS.index(name) for name in order] for order in ORDERS]

    def add_up(cells: pa.Table) -> pa.Table:
        part = cells.column("part")[0].as_py()
        mask, good, toxic, n = (cells.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))
        documents_here = sum(n)
        if documents_here >= 1 << (WIDTH - 1):
            raise OverflowError(f"the part {part!r} has more documents than a field can count")
        everything = sum(wide[m] * k for m, k in zip(mask, n))
        good_ones = sum((wide[m] & lower) * k for m, g, k in zip(mask, good, n) if g)
        toxic_ones = sum((wide[m] & lower) * k for m, t, k in zip(mask, toxic, n) if t)
        removed, redundant = unpack(everything, 2 * STEPS).reshape(2, len(ORDERS), len(FILTERS))
        at = np.array(letters)
        alone = np.array([sum(k for m, k in zip(mask, n) if m == 1 << f) for f in range(len(FILTERS))], np.int64)
        over_orders = np.bincount(at.ravel(), weights=removed.ravel(), minlength=len(FILTERS)).astype(np.int64)
        columns = [
            documents_here - np.cumsum(removed, axis=1),
            removed,
            redundant,
            alone[at],
            unpack(good_ones, STEPS),
            unpack(toxic_ones, STEPS),
            over_orders[at],
        ]
        names = pa.array([o for o in ORDERS for _ in FILTERS])
        steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
        head = [pa.array([part] * STEPS, pa.string()), names, steps]
        return pa.table([*head, *[pa.array(c.ravel()) for c in columns]], names=["part", "filter_order", "step", *COUNTS])

    return mask_counts(documents, labels).groupBy("part").applyInArrow(add_up, SCHEMA)
