"""Best-fit packing of token sequences by a configuration linear program.

Documents are encoded once, in numpy over Arrow batches, and cut into pieces of at most ``capacity`` tokens; what is kept of a
piece is a small row. The histogram of piece lengths, one row per length, goes to the driver. There the configuration program
(cover every length with as few sequences as possible) is solved by multiplicative weights: prices per length, a knapsack
dynamic program that finds the best-priced configurations, a step along them, lower prices for what they cover. Rounding takes
whole copies of the found configurations, fullest first, and packs the rest by best fit, also on the histogram. The plan is a
list of configurations with copy counts; its size depends on the capacity and not on the number of documents.

Every piece then finds its place by its rank among the pieces of its length. Ranks need no sort and no window over pieces: a
task numbers its own pieces per length, and the tasks' counts are added up.

Null texts are empty documents: the end token alone. Repeated rows are packed as documents of their own. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molweave.llm.tokens import Vocabulary, public_vocabulary
from molweave.llm.words import pieces as bounded
from molweave.sources.scratch import stored

CAPACITY = 2048
END_ID = 0
# Rounds of pricing, the step in the exponents, and how near the best price a configuration must come to be used.
ROUNDS = 300
STEP = 4.0
NEAR = 0.95

Config = tuple[tuple[int, int], ...]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all are full but the first."""
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(start, capacity) for start in range(head, n, capacity)]


def piece_rows(documents: DataFrame, capacity: int = CAPACITY, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place): place counts the task's pieces of the same length."""
    vocabulary = vocabulary or public_vocabulary()

    def run(batches):
        encoder = vocabulary.encoder()
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in bounded(batches, "text"):
            rows, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(vocabulary.encode(text or "", encoder), END_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(i)
                    out.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]))
                    seen[length] += 1
            piece, start, length, crc, place = map(np.array, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(piece.astype(np.int32)),
                    *[pa.array(x.astype(np.int64)) for x in (start, length, crc)],
                    pa.array(np.full(len(rows), task, np.int32)),
                    pa.array(place.astype(np.int64)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(best value of every capacity, index of the last item taken or -1), each length as often as it fits."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        k = fits[c]
        if k:
            value = best[c - lengths[:k]] + price[:k]
            i = int(value.argmax())
            best[c], choice[c] = value[i], i
    return best, choice


def trace(lengths: np.ndarray, choice: np.ndarray, room: int) -> dict[int, int]:
    taken: dict[int, int] = {}
    while room > 0 and choice[room] >= 0:
        item = int(lengths[choice[room]])
        taken[item] = taken.get(item, 0) + 1
        room -= item
    return taken


def price_configurations(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Config, float]:
    """Configurations of the linear program and how often each is used, by multiplicative weights.

    Round by round the level rises up to which each length may be covered, so in the end none is covered more than it needs.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    if not len(lengths):
        return {}
    covered = np.zeros(len(lengths))
    used: dict[Config, float] = {}
    index = {int(x): i for i, x in enumerate(lengths)}
    for level in np.arange(1, rounds + 1) / rounds:
        price = lengths / capacity * np.exp(STEP * (level - covered / need))
        best, choice = knapsack(lengths, price, capacity)
        value = price + best[capacity - lengths]
        near = np.flatnonzero(value >= NEAR * value.max())
        for i in near[np.argsort(-value[near], kind="stable")]:
            taken = trace(lengths, choice, capacity - int(lengths[i]))
            taken[int(lengths[i])] = taken.get(int(lengths[i]), 0) + 1
            config = tuple(sorted(taken.items(), reverse=True))
            at = [index[x] for x, _ in config]
            times = np.array([n for _, n in config], float)
            step = float(((level * need[at] - covered[at]) / times).min())
            if step > 0:
                covered[at] += step * times
                used[config] = used.get(config, 0.0) + step
    return used


def round_off(counts: np.ndarray, configs: dict[Config, float], capacity: int) -> list[tuple[Config, int]]:
    """(configuration, copies): the whole parts of the given uses, fullest first, then best fit for what is left."""
    left = counts.copy()
    plan = []
    fill = {c: sum(x * n for x, n in c) for c in configs}
    for config in sorted(configs, key=lambda c: -fill[c]):
        copies = min(int(configs[config]), *(int(left[x]) // n for x, n in config))
        if copies and fill[config] == capacity:
            for x, n in config:
                left[x] -= copies * n
            plan.append((config, copies))
    while left.any():
        room, taken = capacity, {}
        present = np.flatnonzero(left)
        while True:
            fitting = present[: np.searchsorted(present, room, "right")]
            item = next((int(x) for x in fitting[::-1] if left[x] > taken.get(int(x), 0)), None)
            if item is None:
                break
            times = min(room // item, int(left[item]) - taken.get(item, 0))
            taken[item] = taken.get(item, 0) + times
            room -= times * item
        copies = min(int(left[x]) // n for x, n in taken.items())
        for x, n in taken.items():
            left[x] -= copies * n
        plan.append((tuple(sorted(taken.items(), reverse=True)), copies))
    return plan


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[Config, int]]:
    """(configuration, copies) that use up ``counts`` (pieces per length, index 0 unused) exactly."""
    rest = counts.copy()
    full = int(rest[capacity])
    rest[capacity] = 0
    plan = [(((capacity, 1),), full)] if full else []
    return plan + round_off(rest, price_configurations(rest, capacity), capacity)


class Places:
    """The plan as sorted intervals of ranks, one per configuration and length."""

    def __init__(self, plan: list[tuple[Config, int]]):
        given: dict[int, int] = {}
        rows, base = [], 0
        for config, copies in plan:
            offset = 0
            for length, times in config:
                rows.append((length, given.get(length, 0), base, times, offset))
                given[length] = given.get(length, 0) + copies * times
                offset += length * times
            base += copies
        self.length, self.first, self.base, self.times, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T
        self.key = (self.length << 48) + self.first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the piece of that rank among those of its length."""
        i = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        inside = rank - self.first[i]
        return self.base[i] + inside // self.times[i], self.offset[i] + inside % self.times[i] * length


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    placed = stored(piece_rows(documents, capacity, vocabulary), "pieces")
    per_task = placed.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    # At most ``capacity`` rows.
    for row in placed.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    places = Places(solve(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def locate(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = places.find(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    ranked = placed.join(offsets, ["length", "task"]).select(*names, (F.col("place") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(
        locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
