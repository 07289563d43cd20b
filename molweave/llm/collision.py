"""Nearest neighbours by collision counting.

Index: every vector is scaled to length 1 and projected on PROJECTIONS random directions. Vectors are dealt to blocks of about
BLOCK rows; in a block, each projection is a sorted array, so a vector is its rank in it.
Search: for a query and a projection, the window around the query's own value is a range of ranks. A vector collides with the
query in a projection if its rank lies in the range. Virtual rehashing widens all windows of a query step by step, until
VERIFY_SHARE of the block's vectors (and no fewer than VERIFY_LEAST) collide in at least THRESHOLD of the projections. Those are
verified with the exact cosine of the original vectors, in double precision. Blocks are searched independently: a block gives
its best k per query, and the best k of all blocks are the result.

Queries are dealt to groups; a task holds one block of vectors and one group of queries, so its memory is bounded, and blocks
and groups meet through a keyed shuffle. There is no cap on candidates: if many vectors are equally near (copies), all that
collide are verified.

Vectors that are null or zero, or hold null or non-finite components, take no part, neither as queries nor as candidates. All
vectors have the length of the first valid one; others take no part. Rows that repeat an id are candidates of their own, dealt
to blocks one by one; of rows equal in id and vector k are searched, since no more of them can be among the best k. A query id that repeats is answered once per row's vector, the smallest. With fewer candidates than k all are returned. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 64
THRESHOLD = 0.85
VERIFY_SHARE = 0.2
VERIFY_LEAST = 512
# First window, in deviations of the projections, and the factor of each widening.
FIRST_WINDOW = 1.7
WIDEN = 1.12
BLOCK = 8192
QUERY_GROUP = 1024
# Queries counted together in a task.
BATCH = 32

RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) with v as doubles, without the vectors that take no part."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine & F.exists("v", lambda x: x != 0))


def lists_to_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of one query with each row; rows are summed one by one, so equal vectors get equal scores in every task."""
    dot = (vectors * query).sum(axis=1)
    return dot / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


class Block:
    """The sorted projections of some vectors, fewer than 2**32."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lengths = np.sqrt((self.vectors * self.vectors).sum(axis=1, keepdims=True))
        values = ((self.vectors / lengths) @ directions).astype(np.float32).T
        by_value = np.argsort(values, axis=1)
        self.sorted = np.take_along_axis(values, by_value, axis=1)
        # Ranges of ranks end at the number of vectors.
        kind = np.uint16 if values.shape[1] < 1 << 16 else np.uint32
        self.rank = np.empty(values.shape, kind)
        np.put_along_axis(self.rank, by_value, np.arange(values.shape[1], dtype=kind)[None, :], axis=1)

    def collisions(self, projected: np.ndarray, width: float) -> np.ndarray:
        """How many projections put each vector into each query's window."""
        count = np.zeros((len(projected), len(self.ids)), np.uint8)
        for j, ranks in enumerate(self.rank):
            low = np.searchsorted(self.sorted[j], projected[:, j] - width, "left").astype(ranks.dtype)
            high = np.searchsorted(self.sorted[j], projected[:, j] + width, "right").astype(ranks.dtype)
            count += (ranks[None, :] - low[:, None]) < (high - low)[:, None]
        return count

    def search(self, query_ids: np.ndarray, queries: np.ndarray, directions: np.ndarray, k: int) -> Iterator[tuple]:
        """(query index, ids, scores) of the best k candidates of each query."""
        lengths = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        projected = ((queries / lengths) @ directions).astype(np.float32)
        enough = max(VERIFY_LEAST, k + 1, int(VERIFY_SHARE * len(self.ids)))
        needed = int(np.ceil(THRESHOLD * directions.shape[1]))
        active = np.arange(len(queries))
        width = FIRST_WINDOW
        while len(active):
            left = []
            whole = width > 2 * np.abs(self.sorted).max() + 2 * np.abs(projected[active]).max()
            for begin in range(0, len(active), BATCH):
                some = active[begin : begin + BATCH]
                count = self.collisions(projected[some], width)
                for i, row in zip(some, count >= needed, strict=True):
                    near = np.flatnonzero(row)
                    if len(near) < min(enough, len(self.ids)) and not whole:
                        left.append(i)
                        continue
                    near = near[self.ids[near] != query_ids[i]]
                    score = cosines(queries[i], self.vectors[near])
                    best = np.lexsort((self.ids[near], -score))[:k]
                    yield i, self.ids[near[best]], score[best]
            active = np.array(left, np.int64)
            width *= WIDEN


def directions_of(width: int, projections: int, seed: int) -> np.ndarray:
    """Random directions, scaled so that projections of random unit vectors have a deviation of 1."""
    return np.random.default_rng(seed).standard_normal((width, projections))


def search_pairs(width: int, k: int, projections: int, seed: int):
    """Search one group of queries in one block of vectors, as a function of two Arrow tables."""
    empty = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return empty.empty_table()
        directions = directions_of(width, projections, seed)
        ids, query_ids = (t.column("vec_id").to_numpy() for t in (vectors, queries))
        rows, asked = (lists_to_matrix(t.column("v").combine_chunks(), width) for t in (vectors, queries))
        block = Block(ids, rows, directions)
        found = [(np.full(len(i), query_ids[q]), i, score) for q, i, score in block.search(query_ids, asked, directions, k)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=empty)

    return run


def in_blocks(rows: DataFrame, blocks: int, k: int) -> DataFrame:
    """(vec_id, v, block): rows dealt by id, vector and number among equal rows, so that no id fills a block; k of equal rows."""
    equal = rows.groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    numbered = equal.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)))))
    return numbered.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(blocks)).cast("int").alias("block"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", projections: int = PROJECTIONS
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, not counting its own id; ties to the smaller id."""
    rows, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    shape = rows.agg(F.count("*").alias("n"), F.min_by(F.size("v"), "vec_id").alias("width")).first()
    width = shape.width or 1
    n_queries = asked.count()
    blocks = max(1, -(-shape.n // BLOCK))
    groups = max(1, -(-n_queries // QUERY_GROUP))
    group = F.pmod(F.xxhash64(F.lit("group"), "vec_id"), F.lit(groups)).cast("int")
    index = in_blocks(rows.filter(F.size("v") == width), blocks, k)
    one_each = asked.filter(F.size("v") == width).groupBy("vec_id").agg(F.min("v").alias("v"))
    searched = one_each.select("vec_id", "v", group.alias("group"))
    dealt_index = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt_queries = searched.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = (
        dealt_index.groupBy("block", "group")
        .cogroup(dealt_queries.groupBy("block", "group"))
        .applyInArrow(search_pairs(width, k, projections, seed=5), RESULT)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
