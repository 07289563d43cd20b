"""The held-out fold and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.functions.hashing import uniform


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of documents that nothing may be learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, key: str, bound: int, seed: str) -> tuple[DataFrame, dict]:
    """About ``bound`` rows per label value at most, chosen by a hash of ``key``, and the share taken of each value.

    The size of the sample has mean ``bound`` and a deviation below its root, so it stays bounded as the table grows.
    ``label`` must have few values: their counts go to the driver.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    shares = {value: min(1.0, bound / n) for value, n in counts.items()}
    if not shares:
        return rows.limit(0), {}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col(label)]
    return rows.filter(uniform(seed, key) < share), shares
