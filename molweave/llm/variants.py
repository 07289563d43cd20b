"""Grouping of spelling variants: words of a corpus at edit distance one, by search schemes over FM-indexes.

Words are counted once with map-side sums. Two searches then find every near word of a word. Both match one half of it exactly and
extend across the other half allowing one error (one code point inserted, deleted or replaced): the forward search matches the
first half after a delimiter and extends right to the closing one, the backward search matches the second half and extends left.
An error lies in one of the halves, so no pair is missed; the backward search reports only words whose first half differs, so
no pair is found twice.

A search walks suffix-rank intervals of an FM-index over the delimited words of a block. The index is bidirectional in that there is
one of the text and one of its reversal: the first extends patterns left, the second right, and the backward search is the forward
one on mirrored words. An interval is extended by looking up its two ends among the sorted (symbol, rank) pairs of the
Burrows-Wheeler transform, for all words of a block at once. The error branches on the symbols that an interval holds, so a step
costs what can still match.

Blocks are ranges of the sorted words (of the reversed words for the backward search), so the words that share a half lie in one
block or in few. A word is sent to the blocks its half can lie in, by the blocks' first words: at most BLOCKS rows, which is all
that goes through the driver. Nothing compares all pairs of a block. A word follows its form by pointer doubling, each round written to the
shared folder; forms are five times as frequent as their words, so a chain is short.

A null text has no words; neither has an empty one. The id of a document without one is written as nothing. Repeated rows and
ids count as they stand. Long texts are one array of runs in a task. Ties of the largest n go to the smallest word in
code-point order. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import string
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.operators.ordering import dense_index
from molweave.sources.scratch import stored

# What a run is, which runs lose a code point, and which results are words.
RUN = r"[a-zÀ-ÿ]+"
SLIP = 199
LEAST_POINTS = 6
LEAST_COUNT = 5
FORM_TIMES = 5
# Blocks at most, and words of a block at least.
BLOCKS = 4096
BLOCK_WORDS = 2048


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): the words of a corpus, each an array of runs away from its text, summed on the map side."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = documents.select(
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"),
        F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"),
    )
    hashed = runs.select("run", F.crc32(F.concat("head", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shortened = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % SLIP == 0, shortened).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= LEAST_POINTS) & (F.col("n") >= LEAST_COUNT))


# ---- the index of a block ------------------------------------------------------------------------------------------------

DELIMITER = 0
# Words looked for at a time.
CHUNK = 4096


class Suffixes:
    """FM-index of a circular text of symbols: puts a symbol before many patterns at once, each held as a suffix-rank interval."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            pairs = rank * (rank.max() + 1) + np.roll(rank, -width)
            distinct, rank = np.unique(pairs, return_inverse=True)
            if len(distinct) == n or width > n:
                break
            width *= 2
        self.order = np.argsort(rank)
        self.last = text[self.order - 1]
        self.symbols = int(text.max()) + 1
        self.pairs = np.sort(self.last * (n + 1) + np.arange(n))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with a symbol before them; low == high where there is none."""
        start = symbol * (self.n + 1)
        return np.searchsorted(self.pairs, start + low), np.searchsorted(self.pairs, start + high)

    def before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol): the different symbols that stand before each interval's pattern."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which]
        seen = np.unique(which * self.symbols + self.last[row])
        return seen // self.symbols, seen % self.symbols


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and the length of each word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), np.array([len(w) for w in words], np.int64)


class Block:
    """Words indexed so that a pattern that begins at a word's beginning is extended to the right: the index of the reversed text."""

    def __init__(self, words: list[str]):
        points, size = code_points(words)
        self.alphabet = np.unique(points)
        self.starts = np.cumsum(size + 1) - size - 1
        of_word = np.repeat(np.arange(len(words)), size)
        first = np.cumsum(size) - size
        mirrored = size[of_word] - 1 - (np.arange(len(points)) - first[of_word])
        text = np.full(len(points) + len(words), DELIMITER, np.int64)
        text[self.starts[of_word] + 1 + mirrored] = np.searchsorted(self.alphabet, points) + 1
        self.index = Suffixes(text)
        self.words = len(words)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; those that no word holds get one that nothing matches."""
        place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[place] == points, place + 1, len(self.alphabet) + 1)

    def near(self, words: list[str], halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, indexed word) for all at one error behind the first ``halves`` code points, which are the same."""
        found = [self._near(words[k : k + CHUNK], halves[k : k + CHUNK], k) for k in range(0, len(words), CHUNK)]
        asked, met = (np.concatenate([f[side] for f in found]) if found else np.zeros(0, np.int64) for side in (0, 1))
        return asked, met

    def _near(self, words: list[str], halves: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        points, size = code_points(words)
        symbols, first = self._symbols(points), np.cumsum(size) - size
        index = self.index

        def step(q, p, low, high):
            """One more code point of each word, matched exactly."""
            low, high = index.extend(low, high, symbols[first[q] + p])
            alive = low < high
            return q[alive], p[alive] + 1, low[alive], high[alive]

        q, p = np.arange(len(words)), np.zeros(len(words), np.int64)
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.words)
        exact, waiting = [], (q, p, low, high)
        while len(waiting[0]):
            at_half = waiting[1] == halves[waiting[0]]
            exact.append([c[at_half] for c in waiting])
            waiting = step(*[c[~at_half] for c in waiting])
        q, p, low, high = (np.concatenate(c) for c in zip(*exact))
        wrong = []
        while len(q):
            more = p < size[q]
            wrong.append((q[more], p[more] + 1, low[more], high[more]))
            which, symbol = index.before(low, high)
            which, symbol = which[symbol != DELIMITER], symbol[symbol != DELIMITER]
            l, h = index.extend(low[which], high[which], symbol)
            wrong.append((q[which], p[which], l, h))
            due = symbols[np.minimum(first[q] + p, len(symbols) - 1)][which]
            other = more[which] & (symbol != due)
            wrong.append((q[which][other], p[which][other] + 1, l[other], h[other]))
            q, p, low, high = step(q[more], p[more], low[more], high[more])
        q, p, low, high = (np.concatenate(c) for c in zip(*wrong))
        asked, met = [], []
        while len(q):
            closed = p == size[q]
            l, h = index.extend(low[closed], high[closed], np.full(int(closed.sum()), DELIMITER))
            asked.append(q[closed][l < h])
            met.append(np.searchsorted(self.starts, index.order[l[l < h]]))
            q, p, low, high = step(q[~closed], p[~closed], low[~closed], high[~closed])
        both = np.unique(np.concatenate(asked) * self.words + np.concatenate(met)) if asked else np.zeros(0, np.int64)
        return both // self.words + offset, both % self.words


# ---- the search over all words ---------------------------------------------------------------------------------------------

# Code points of a block's first word that are kept for routing.
ROUTE_POINTS = 64
LARGEST = chr(0x10FFFF)


def block_words(n_words: int) -> int:
    """Words of a block, so that there are BLOCKS blocks at most."""
    return max(BLOCK_WORDS, -(-n_words // BLOCKS))


def near_words(words: DataFrame, size: int, mirrored: bool) -> DataFrame:
    """(word, near, n): near words that share the first half of a word, or mirrored: the second half but not the first."""
    length, half = F.length("word"), F.floor(F.length("word") / 2)
    key, same = (F.reverse("word"), length - half) if mirrored else (F.col("word"), half)
    placed = dense_index(words.select(key.alias("key"), same.cast("int").alias("same"), "n"), "key")
    placed = placed.withColumn("block", F.floor(F.col("idx") / size))
    firsts = placed.filter(F.col("idx") % size == 0).select("block", F.substring("key", 1, ROUTE_POINTS).alias("first"))
    starts = [r.first for r in firsts.orderBy("block").collect()]

    @F.arrow_udf("array<long>")
    def blocks_of(halves: pa.Array) -> pa.Array:
        found = []
        for x in halves.to_pylist():
            x = x[:ROUTE_POINTS]
            found.append(list(range(max(0, bisect_left(starts, x) - 1), bisect_right(starts, x + LARGEST))))
        return pa.array(found, pa.list_(pa.int64()))

    routes = blocks_of(F.substring("key", F.lit(1), F.col("same")))
    asked = placed.select(F.col("key").alias("looked"), F.col("same").alias("shared"), F.explode(routes).alias("block"))

    def search(indexed: pa.Table, asked: pa.Table) -> pa.Table:
        own, looked = indexed.column("key").to_pylist(), asked.column("looked").to_pylist()
        if own and looked:
            which, met = Block(own).near(looked, asked.column("shared").to_numpy())
        else:
            which = met = np.zeros(0, np.int64)
        pairs = [(looked[a], own[b]) for a, b in zip(which.tolist(), met.tolist())]
        n = indexed.column("n").to_numpy()[met] if own else met
        if mirrored:
            pairs = [(a[::-1], b[::-1]) for a, b in pairs]
            kept = np.array([a[: len(a) // 2] != b[: len(a) // 2] for a, b in pairs], bool)
            pairs, n = [x for x, k in zip(pairs, kept) if k], n[kept]
        columns = [pa.array([x[k] for x in pairs], pa.string()) for k in (0, 1)]
        return pa.table([*columns, pa.array(n, pa.int64())], names=["word", "near", "n"])

    index = placed.select("block", "key", "n")
    return index.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(search, "word string, near string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow on a word, by pointer doubling. ``forms``: (word, form), no form null."""
    links = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = stored(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "roots")
        links = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return links


def spelling_forms(documents: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of a corpus."""
    words = stored(word_counts(documents), "words")
    size = block_words(words.count())
    pairs = near_words(words, size, mirrored=False).unionByName(near_words(words, size, mirrored=True))
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("b"))
    joined = words.join(best, "word", "left")
    frequent = -F.col("b.less") >= FORM_TIMES * F.col("n")
    formed = stored(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(frequent, F.col("b.near")).alias("form"),
            F.when(frequent, -F.col("b.less")).alias("form_n"),
        ),
        "near",
    )
    ends = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
