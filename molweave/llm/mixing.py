"""Mixing sources to target weights.

Sizes are summed per source. A target is the source's share by weight of BUDGET times all sizes, but at most CAP times its own
size; what lies above is shared again by weight among the others until none is above. Since targets below the cap stay in
proportion to their weights, they are level * weight, and each round only needs two sums over the sources, so the table of
sources never goes through the driver. The rate of a source is target / size; a document is taken floor(rate) times plus once
more if a hash of the seed and its id falls below the fraction.

Null texts have size 0; a null source is a source of its own, the last one. Rows that repeat an id share its draw. Long
texts are only counted. Sources of the same size are full in the same round. A source of size 0 has target 0 and is not taken. Extra
columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import uniform
from molweave.operators.ordering import dense_index
from molweave.sources.scratch import stored

# Weights by the place of a source in code point order, repeating.
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2.0
SEED = "mix"


def size_of(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight), one row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = dense_index(sums.withColumn("_null", F.col("source").isNull()), "_null", "source", out="rank")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return placed.select("source", "source_size", F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int")).alias("weight"))


def water_level(sources: DataFrame, budget: float = BUDGET, cap: float = CAP) -> tuple[float, float]:
    """(amount, weight) whose ratio is the target per weight of the sources that are not capped."""
    limit = cap * F.col("source_size")
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total[0]:
        return 0.0, 1.0
    amount, weight, capped = budget * total[0], float(total[1]), 0
    while True:
        above = F.col("weight") * amount >= limit * weight
        full = sources.filter(above).agg(F.count("*"), F.sum(limit), F.sum("weight")).first()
        if full[0] == capped:
            return amount, weight
        capped, left = full[0], float(total[1] - full[2])
        if left == 0:
            return float("inf"), 1.0
        amount, weight = budget * total[0] - full[1], left


def plan(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """Documents with size, source_size, target, rate and copies (how often each is taken)."""
    sized = documents.withColumn("size", size_of(F.col("text")))
    sources = stored(source_sizes(documents.select("source", size_of(F.col("text")).alias("size"))), "sources")
    amount, weight = water_level(sources)
    target = F.least(CAP * F.col("source_size"), F.col("weight") * F.lit(amount) / F.lit(weight))
    rated = sources.select(
        F.col("source").alias("_source"),
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )
    joined = sized.join(rated, sized["source"].eqNullSafe(rated["_source"])).drop("_source")
    extra = (uniform(seed, "doc_id") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra)


def mix(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return plan(rows, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emit(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    own = [F.col(f"_doc.`{c}`").alias(c) for c in documents.columns]
    packed = documents.select(F.struct("*").alias("_doc"), "doc_id", "text", "source")
    taken = plan(packed, seed).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*own)
