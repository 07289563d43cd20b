"""Words of whole texts as numpy arrays, for functions that run over Arrow batches.

A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased. All work goes over the bytes of
many texts at once, in pieces of bounded size, so a batch of any number of rows or a text of any length needs little memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts taken together, and bytes hashed together.
PIECE_BYTES = 4 << 20
SEGMENT_BYTES = 1 << 18

# Odd multipliers of public 64-bit mixers, and their inverse modulo 2**64 where it is needed.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xBF58476D1CE4E5B9


def _fold_table() -> np.ndarray:
    """Byte to lower-cased byte, 0 for bytes outside words."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


FOLD = _fold_table()
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    flat = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(flat) + 1, flat.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])), offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(MIX)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Words:
    """Words of a string column: the row, first byte, end and 64-bit hash of each, in text order."""

    def __init__(self, column: pa.Array, prefixes: tuple[int, ...] = ()):
        data, offsets = text_bytes(column)
        self.rows = len(column)
        folded = FOLD[data]
        inside = folded != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = np.empty(len(self.start), np.uint64)
        self.prefix = {k: np.zeros(len(self.start), np.uint64) for k in prefixes}
        self._hash(folded)

    def _hash(self, folded: np.ndarray) -> None:
        """Polynomial hashes from running sums; the hash of a prefix is 0 for words that are not longer."""
        powers = inverse = np.zeros(0, np.uint64)
        at, n = 0, len(self.start)
        while at < n:
            stop = max(at + 1, int(np.searchsorted(self.start, self.start[at] + SEGMENT_BYTES, "left")))
            low, high = self.start[at], self.end[stop - 1]
            if high - low > len(powers):
                powers, inverse = _powers(BASE, int(high - low) + 1), _powers(BASE_INVERSE, int(high - low) + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(BYTE_VALUES[folded[low:high]] * powers[: high - low], out=sums[1:])
            begin, end = self.start[at:stop] - low, self.end[at:stop] - low
            self.hash[at:stop] = mix((sums[end] - sums[begin]) * inverse[begin])
            for k, out in self.prefix.items():
                long = np.flatnonzero(end - begin > k)
                b = begin[long]
                out[at + long] = mix((sums[b + k] - sums[b]) * inverse[b] + np.uint64(k))
            at = stop

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def first_of_row(self) -> np.ndarray:
        """Index of each row's first word; one more entry closes the last row."""
        return np.searchsorted(self.row, np.arange(self.rows + 1), "left")


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a row with fewer words is one run of all it has."""
    first = words.first_of_row()
    n = np.diff(first)
    rows, hashes = [], []
    if len(words.hash) >= size:
        total = np.zeros(len(words.hash) - size + 1, np.uint64)
        for k in range(size):
            total = mix(total + words.hash[k : k + len(total)])
        whole = words.row[: len(total)] == words.row[size - 1 :]
        rows.append(words.row[: len(total)][whole])
        hashes.append(total[whole])
    for length in range(1, size):
        short = np.flatnonzero(n == length)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for k in range(length):
                total = mix(total + words.hash[first[short] + k])
            rows.append(short)
            hashes.append(total + np.uint64(length))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(row, kind="stable")
    return row[order], value[order]
