"""Corruption of sequences for masked-token and replaced-token training.

Two forms with equal results. The long form (one row per position) is plain expressions in generated code. The array
form maps whole Arrow batches with numpy and is map-only: sequences go in and come out as arrays, so nothing is exploded
and regrouped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.functions.hashing import key_hash, position_state_np, position_uniform, wide_uniform_np
from molweave.functions.ids import IGNORE_LABEL, MASK, PAD, SPECIAL_TOKENS
from molweave.sources.scratch import stored

# Fixed value: share of positions masked.
MASK_PROB = 0.15
# Left neighbour of the back-off row: the proposals used where the neighbour was never seen.
ANY_LEFT = -1
# Positions worked on at a time inside an Arrow batch.
PIECE = 1 << 18
# Rows of the proposal table that may be broadcast, of 12 bytes each; larger tables are joined.
CANDIDATE_LIMIT = 5_000_000
# Sampling weight of a neighbour's most frequent token, at a temperature.
WEIGHT_ONE = 1 << 31
# A count is frequent from this part of all on; at most so many counts of one kind are.
HOT_PARTS = 10_000
# A left neighbour's totals are broadcast from this part of all weights on; at most so many neighbours are.
HEAD_PARTS = 500_000


def mask_state(seed, *keys) -> Column:
    """Row hash behind the mask draws."""
    return key_hash(f"{seed}:mask", *keys)


def sample_state(seed, *keys) -> Column:
    """Row hash behind the sampling draws."""
    return key_hash(f"{seed}:sample", *keys)


# ---- long form ------------------------------------------------------------------------------------------------------


def ignore_mask(token: Column, ignore=(PAD,)) -> Column:
    """True where a position must not be masked. [PAD] always is; callers may add [CLS] and [SEP]."""
    return token.isin(*sorted({PAD, *ignore}))


def bernoulli_mask(token: Column, state: Column, pos: Column, p: float = MASK_PROB, ignore=(PAD,)) -> Column:
    return ~ignore_mask(token, ignore) & (position_uniform(state, pos) < F.lit(float(p)))


def mask_positions(df: DataFrame, key: str, seed, ids: str = "input_ids", p: float = MASK_PROB, ignore=(PAD,)) -> DataFrame:
    """(key, pos, token_id, masked, mlm_label, masked_id), one row per position; no shuffle.

    The row hash is taken before the explode, once per sequence.
    """
    long = df.select(key, mask_state(seed, key).alias("_state"), F.posexplode_outer(ids).alias("pos", "token_id"))
    long = long.filter(F.col("pos").isNotNull())
    masked = long.withColumn("masked", bernoulli_mask(F.col("token_id"), F.col("_state"), F.col("pos"), p, ignore))
    return masked.select(
        key,
        "pos",
        "token_id",
        "masked",
        F.when(F.col("masked"), F.col("token_id")).otherwise(F.lit(IGNORE_LABEL)).alias("mlm_label"),
        F.when(F.col("masked"), F.lit(MASK)).otherwise(F.col("token_id")).alias("masked_id"),
    )


def non_pad_positions(positions: DataFrame, token: str = "token_id") -> DataFrame:
    return positions.filter(F.col(token) != PAD)


# ---- array form -----------------------------------------------------------------------------------------------------


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in a row, and the length of each list (0 for null)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), sizes


def _positions(sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(starts, sizes)


def _lists(values: np.ndarray, sizes: np.ndarray, like: pa.Array, kind=pa.int32()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    nulls = pc.is_null(like) if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind), mask=nulls)


def _by_pieces(fn, *columns: pa.Array) -> pa.Array:
    """Apply fn to slices of whole rows of about PIECE positions, so that working memory does not grow with the batch."""
    sizes = pc.fill_null(pc.list_value_length(columns[0]), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return fn(*columns)
    piece = np.cumsum(sizes) // PIECE
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    ends = np.append(starts[1:], len(sizes))
    return pa.concat_arrays([fn(*[c.slice(a, b - a) for c in columns]) for a, b in zip(starts, ends)])


def _draw_mask(flat, sizes, state, p, ignored) -> np.ndarray:
    rows = np.repeat(state.to_numpy(zero_copy_only=False), sizes)
    u = position_state_np(rows, _positions(sizes)) / float(1 << 32)
    return (u < p) & ~np.isin(flat, ignored)


def mask_arrays(p: float = MASK_PROB, ignore=(PAD,)):
    """Arrow function (input_ids, mask_state) -> struct(masked, mlm_labels, masked_input)."""
    ignored = sorted({PAD, *ignore})

    @F.arrow_udf("struct<masked: array<boolean>, mlm_labels: array<int>, masked_input: array<int>>")
    def run(ids: pa.Array, state: pa.Array) -> pa.Array:
        return _by_pieces(piece, ids, state)

    def piece(ids: pa.Array, state: pa.Array) -> pa.Array:
        flat, sizes = _flat(ids)
        masked = _draw_mask(flat, sizes, state, p, ignored)
        fields = [
            _lists(masked, sizes, ids, pa.bool_()),
            _lists(np.where(masked, flat, IGNORE_LABEL), sizes, ids),
            _lists(np.where(masked, MASK, flat), sizes, ids),
        ]
        return pa.StructArray.from_arrays(fields, ["masked", "mlm_labels", "masked_input"])

    return run


def mask_sequences(df: DataFrame, key: str, seed, ids: str = "input_ids", p: float = MASK_PROB, ignore=(PAD,)) -> DataFrame:
    """Add arrays masked, mlm_labels and masked_input."""
    return df.withColumn("_m", mask_arrays(p, ignore)(F.col(ids), mask_state(seed, key))).select(*df.columns, "_m.*")


def gumbel_noise_np(states: np.ndarray) -> np.ndarray:
    u = states / float(1 << 32)
    return -np.log(-np.log(u + 1e-9) + 1e-9)


def gumbel_sample(temperature: float = 1.0):
    """Arrow function (logits, row state) -> index of the largest logit / T + noise, the first one on ties."""

    @F.arrow_udf("int")
    def run(logits: pa.Array, state: pa.Array) -> pa.Array:
        return _by_pieces(piece, logits, state)

    def piece(logits: pa.Array, state: pa.Array) -> pa.Array:
        flat, sizes = _flat(logits)
        rows = np.repeat(state.to_numpy(zero_copy_only=False), sizes)
        places = _positions(sizes)
        score = flat.astype(np.float64) / temperature + gumbel_noise_np(position_state_np(rows, places))
        filled = sizes > 0
        picked = np.zeros(len(sizes), dtype=np.int32)
        if filled.any():
            starts = (np.cumsum(sizes) - sizes)[filled]
            best = np.repeat(np.maximum.reduceat(score, starts), sizes[filled])
            first = np.minimum.reduceat(np.where(score == best, places, np.iinfo(np.int64).max), starts)
            picked[filled] = first
        return pa.array(picked, mask=~filled)

    return run


def ngram_candidates(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Proposals in place of a generator network: (prev, rank, token, n, cum, most, total, followers, log_p), of written rows.

    ``ids`` are templated, unpadded sequences of the train split. For each left neighbour all its followers, the most frequent
    first, and under ANY_LEFT all tokens; cum counts up to and with this one. Counting combines on the map side, and the ranking
    sees counted rows only.
    """
    # No filter on the length: Spark would move it, and the lookup that made the ids with it, below other steps.
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    pairs = (
        df.select(F.slice(ids, F.lit(1), n).alias("prev"), F.slice(ids, F.lit(2), n).alias("token"))
        .select(F.explode_outer(F.arrays_zip("prev", "token")).alias("p"))
        .filter(F.col("p").isNotNull())
    )
    counts = pairs.groupBy(F.col("p.prev").alias("prev"), F.col("p.token").alias("token")).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy("token").agg(F.sum("n").alias("n")).select(F.lit(ANY_LEFT).alias("prev"), "token", "n")
    return rank_followers(counts.unionByName(overall))


def rank_followers(counts: DataFrame, *keep: str) -> DataFrame:
    """Add rank, cum, most and log_p to (prev, token, n): each neighbour's followers by falling n, then token.

    Rows are range-partitioned and sorted in that order, so a neighbour with many followers lies in several parts. A task numbers and
    sums the rows of its part and writes them. Only the first and the last neighbour of a part can lie in others too; what the
    parts have of these is summed up and carried over by a broadcast of two rows a part. No task sees more than a part.
    most is the neighbour's largest n, total the sum of its n and followers their number; ``keep`` names further columns that stay.
    """
    order = ["prev", F.col("n").desc(), "token"]
    rows = counts.select(F.col("prev").cast("int").alias("prev"), F.col("token").cast("int").alias("token"), F.col("n").cast("long").alias("n"), *keep)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    longs = [T.StructField(c, T.LongType()) for c in IN_PART]
    schema = T.StructType([*placed.schema.fields, T.StructField("_edge", T.BooleanType()), *longs])
    numbered = stored(placed.mapInArrow(_numbered_in_part, schema), "followers")
    pieces = numbered.filter("_edge").groupBy("prev", "_part").agg(*[F.max(c).alias(c) for c in ("_size", "_rows", "_most")])
    whole = Window.partitionBy("prev")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        "prev",
        "_part",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_size", "_rows")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("_size", "_rows")],
        F.max("_most").over(whole).alias("_most_all"),
    )
    total = F.coalesce("_size_all", "_size")
    return numbered.join(F.broadcast(carried), ["prev", "_part"], "left").select(
        "prev",
        (F.coalesce("_rows_before", F.lit(0)) + F.col("_rank")).cast("int").alias("rank"),
        "token",
        "n",
        (F.coalesce("_size_before", F.lit(0)) + F.col("_cum")).alias("cum"),
        F.coalesce("_most_all", "_most").alias("most"),
        total.alias("total"),
        F.coalesce("_rows_all", "_rows").alias("followers"),
        *(keep or [(F.log("n") - F.log(total)).alias("log_p")]),
    )


# What a task adds to its rows: place and running sum among a neighbour's rows of the part, and their sum, number and largest n.
IN_PART = ["_rank", "_cum", "_size", "_rows", "_most"]


def _numbered_in_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add _edge and IN_PART to sorted rows; a batch's last neighbour waits for its next rows."""
    waiting, first = [], None

    def numbered(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        prev, n = rows["prev"].to_numpy(), rows["n"].to_numpy()
        starts = np.flatnonzero(np.diff(prev, prepend=prev[0] - 1))
        sizes = np.diff(np.append(starts, len(prev)))
        sums = np.cumsum(n)
        before = np.repeat(sums[starts] - n[starts], sizes)
        edge = (prev == first) | (last & (prev == prev[-1]))
        ends = np.repeat(sums[starts + sizes - 1], sizes)
        values = [np.arange(len(prev)) - np.repeat(starts, sizes) + 1, sums - before, ends - before, np.repeat(sizes, sizes), np.repeat(n[starts], sizes)]
        for name, column in zip(["_edge", *IN_PART], [edge, *values]):
            rows = rows.append_column(name, pa.array(column, pa.bool_() if name == "_edge" else pa.int64()))
        yield from rows.to_batches(max_chunksize=100_000)

    for batch in batches:
        if not batch.num_rows:
            continue
        prev = batch["prev"].to_numpy()
        first = prev[0] if first is None else first
        cut = int(np.searchsorted(prev, prev[-1]))
        same = waiting and waiting[0]["prev"][0].as_py() == prev[-1]
        if same:
            waiting.append(batch)
            continue
        yield from numbered(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), False) if waiting or cut else ()
        waiting = [batch.slice(cut)]
    if waiting:
        yield from numbered(pa.Table.from_batches(waiting), True)


def tempered(candidates: DataFrame, temperature: float) -> DataFrame:
    """Proposals whose n and cum are sampling weights at a temperature; log_p stays that of the counts.

    The Gumbel rule takes a token with a probability in proportion to exp(log p / T), which is n ** (1 / T). Weights are whole
    numbers, WEIGHT_ONE for the neighbour's most frequent token and 1 at least, so their sums are the same in any order. At
    T = 1 they are the counts.
    """
    if not temperature > 0:
        raise ValueError("a temperature is above 0")
    if temperature == 1:
        return candidates
    share = F.pow(F.col("n") / F.col("most"), F.lit(1.0 / temperature))
    weight = F.greatest(F.floor(share * WEIGHT_ONE), F.lit(1)).cast("long")
    return rank_followers(candidates.select("prev", "token", weight.alias("n"), "log_p"), "log_p")


class ProposalTable(NamedTuple):
    """Left neighbours with their tokens; ``ends`` counts on over all rows, so one search finds neighbour and token."""

    tokens: np.ndarray
    ends: np.ndarray
    lefts: np.ndarray
    start: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> ProposalTable:
        prev, rank, token, n = (rows[c].to_numpy() for c in ("prev", "rank", "token", "n"))
        order = np.lexsort((rank, prev))
        ends = np.cumsum(n[order])
        lefts, first = np.unique(prev[order], return_index=True)
        bounds = np.append(first, len(prev))
        before = np.concatenate([[0], ends])
        start = before[bounds[:-1]]
        return ProposalTable(token[order].astype(np.int32), ends, lefts, start, before[bounds[1:]] - start)

    def draw(self, neighbour: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Token at the place u of each neighbour's followers; a neighbour without followers draws from all tokens."""
        row = np.minimum(np.searchsorted(self.lefts, neighbour), len(self.lefts) - 1)
        row = np.where(self.lefts[row] == neighbour, row, np.searchsorted(self.lefts, ANY_LEFT))
        target = np.minimum(np.floor(u * self.total[row]).astype(np.int64), self.total[row] - 1)
        return self.tokens[np.searchsorted(self.ends, self.start[row] + target, "right")]


class GeneratorTable(NamedTuple):
    """Log-probabilities of the stand-in generator: p(token | prev) = (n + p(token)) / (total + 1), p(token) = (n + 1) / (N + K + 1).

    N and K are the tokens and the distinct ones under ANY_LEFT. It sums to one over all tokens and one unknown one.
    """

    lefts: np.ndarray
    total: np.ndarray
    best: np.ndarray
    pairs: np.ndarray
    n: np.ndarray
    size: int

    @staticmethod
    def of(rows: pa.Table) -> GeneratorTable:
        prev, rank, token, n = (rows[c].to_numpy() for c in ("prev", "rank", "token", "n"))
        lefts, place = np.unique(prev, return_inverse=True)
        total = np.bincount(place, weights=n, minlength=len(lefts)).astype(np.int64)
        best = np.empty(len(lefts), np.int32)
        best[place[rank == 1]] = token[rank == 1]
        pairs = (place.astype(np.int64) << 32) | token
        order = np.argsort(pairs)
        return GeneratorTable(lefts, total, best, pairs[order], n[order], int((prev == ANY_LEFT).sum()))

    def _count(self, row: np.ndarray, token: np.ndarray) -> np.ndarray:
        asked = (row << 32) | token
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.n[at], 0)

    def judge(self, neighbour: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(negative log-probability of each token after its neighbour, whether it is the best proposal there)."""
        token = token.astype(np.int64)
        anywhere = int(np.searchsorted(self.lefts, ANY_LEFT))
        row = np.minimum(np.searchsorted(self.lefts, neighbour), len(self.lefts) - 1)
        seen = self.lefts[row] == neighbour
        row = np.where(seen, row, anywhere)
        alone = (self._count(np.full(len(token), anywhere), token) + 1) / (self.total[anywhere] + self.size + 1)
        after = (self._count(row, token) + alone) / (self.total[row] + 1)
        return -np.log(np.where(row == anywhere, alone, after)), self.best[row] == token


def proposal_table(candidates: DataFrame, limit: int | None = None) -> ProposalTable | None:
    """The written proposals for a broadcast, or None if they have more than ``limit`` rows (CANDIDATE_LIMIT)."""
    limit = CANDIDATE_LIMIT if limit is None else limit
    size = candidates.limit(limit + 1).count()
    if not size:
        raise ValueError("no proposals: the train split has no pair of tokens")
    return ProposalTable.of(candidates.select("prev", "rank", "token", "n").toArrow()) if size <= limit else None


CORRUPTED = {
    "masked": "boolean",
    "mlm_labels": "int",
    "masked_input": "int",
    "disc_input": "int",
    "disc_labels": "int",
}
JUDGED = {"nll": "double", "gen_hit": "boolean"}
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}


def corrupt_arrays(spark, table: ProposalTable, p: float = MASK_PROB, ignore=(PAD,), generator: GeneratorTable | None = None):
    """Arrow function (input_ids, mask_state, sample_state) -> the masked and the replaced sequence with their labels.

    A sampled token equal to the original counts as original. The left neighbour is the one the generator would see, so
    a masked neighbour falls back to the overall proposals. With a ``generator`` also the loss and the hit of each masked
    position, null elsewhere.
    """
    ignored = sorted({PAD, *ignore})
    # As bare tuples: executors need no copy of this package to read them.
    shipped = spark.sparkContext.broadcast((tuple(table), tuple(generator) if generator else None))
    fields = CORRUPTED | (JUDGED if generator else {})

    @F.arrow_udf(f"struct<{', '.join(f'{name}: array<{kind}>' for name, kind in fields.items())}>")
    def run(ids: pa.Array, mask_hash: pa.Array, sample_hash: pa.Array) -> pa.Array:
        return _by_pieces(piece, ids, mask_hash, sample_hash)

    def piece(ids: pa.Array, mask_hash: pa.Array, sample_hash: pa.Array) -> pa.Array:
        proposals, judged = shipped.value
        flat, sizes = _flat(ids)
        masked = _draw_mask(flat, sizes, mask_hash, p, ignored)
        shown = np.where(masked, MASK, flat).astype(np.int32)
        replaced = flat.astype(np.int32, copy=True)
        at = np.flatnonzero(masked)
        places = _positions(sizes)[at]
        neighbour = np.where(places > 0, shown[at - 1], ANY_LEFT) if len(at) else places
        if len(at):
            states = position_state_np(np.repeat(sample_hash.to_numpy(zero_copy_only=False), sizes)[at], places)
            replaced[at] = ProposalTable(*proposals).draw(neighbour, wide_uniform_np(states))
        values = [masked, np.where(masked, flat, IGNORE_LABEL), shown, replaced, (replaced != flat).astype(np.int32)]
        if judged:
            nll, hit = np.zeros(len(flat)), np.zeros(len(flat), bool)
            nll[at], hit[at] = GeneratorTable(*judged).judge(neighbour, flat[at])
            values += [pa.array(nll, mask=~masked), pa.array(hit, mask=~masked)]
        lists = [_lists(v, sizes, ids, _ARROW[kind]) for v, kind in zip(values, fields.values())]
        return pa.StructArray.from_arrays(lists, list(fields))

    return run


def corrupt_sequences(
    df: DataFrame,
    candidates: DataFrame,
    key: str,
    seed,
    ids: str = "input_ids",
    p: float = MASK_PROB,
    ignore=(PAD,),
    temperature: float = 1.0,
    judged: bool = False,
) -> DataFrame:
    """Add masked, mlm_labels, masked_input, disc_input and disc_labels; with ``judged`` also nll and gen_hit.

    nll is the negative log-probability that the stand-in generator gives to the token behind each mask, gen_hit whether its best
    proposal is that token; both are null at other positions. The temperature changes what is sampled, not the loss.

    Map-only with proposals that fit in a broadcast; with more (``candidates`` is a written table and its rows are counted), the
    masked positions are joined with them, with the same result.
    """
    draws = tempered(candidates, temperature)
    table = proposal_table(draws)
    if table is None:
        return _corrupt_by_join(df, candidates, draws, key, seed, ids, p, ignore, judged)
    generator = GeneratorTable.of(candidates.select("prev", "rank", "token", "n").toArrow()) if judged else None
    fn = corrupt_arrays(candidates.sparkSession, table, p, ignore, generator)
    made = df.withColumn("_c", fn(F.col(ids), mask_state(seed, key), sample_state(seed, key)))
    return made.select(*df.columns, "_c.*")


def corrupt_by_join(
    df: DataFrame,
    candidates: DataFrame,
    key: str,
    seed,
    ids: str = "input_ids",
    p: float = MASK_PROB,
    ignore=(PAD,),
    temperature: float = 1.0,
    judged: bool = False,
) -> DataFrame:
    """``corrupt_sequences`` with proposals of any size; ``key`` is unique."""
    return _corrupt_by_join(df, candidates, tempered(candidates, temperature), key, seed, ids, p, ignore, judged)


def _corrupt_by_join(df, candidates, draws, key, seed, ids, p, ignore, judged) -> DataFrame:
    """A neighbour's weights are cut into as many equal cells as it has followers, and positions meet the followers of one cell. So
    a frequent neighbour is split by its own followers, and a position meets a few rows whatever the size of the table.

    Only masked positions are exploded, and only the sequences themselves are shuffled to meet what was drawn for them.
    """
    states = [mask_state(seed, key), sample_state(seed, key)]
    spots = df.select(key, F.explode_outer(masked_spots(p, ignore)(F.col(ids), *states)).alias("_z")).filter(F.col("_z").isNotNull())
    asked = spots.select(key, *[F.col(f"_z.{c}").alias(f"_{c}") for c in ("pos", "label", "prev", "u")])
    drawn = _with_totals(asked, candidates, draws)
    target = F.least(F.floor(F.col("_u") * F.col("_total")), F.col("_total") - 1)
    drawn = drawn.withColumn("_target", target).withColumn("_cell", F.floor(F.col("_target") / F.ceil(F.col("_total") / F.col("_k"))))
    drawn = drawn.drop("_total", "_k", "_u") if judged else drawn.select(key, "_pos", "_prev", "_target", "_cell")
    width, low = F.ceil(F.col("total") / F.col("followers")), F.col("cum") - F.col("n")
    spans = F.sequence(F.floor(low / width), F.floor((F.col("cum") - 1) / width))
    cells = draws.select(F.col("prev").alias("_prev"), F.col("token").alias("_token"), low.alias("_low"), F.col("cum").alias("_cum"), F.explode(spans).alias("_cell"))
    inside = (F.col("_target") >= F.col("_low")) & (F.col("_target") < F.col("_cum"))
    picked = drawn.join(cells, ["_prev", "_cell"]).filter(inside)
    values = ["_pos", "_token"]
    if judged:
        picked, values = _judged_by_join(picked, candidates), [*values, "_nll", "_hit"]
    found = picked.groupBy(key).agg(F.collect_list(F.struct(*values)).alias("_found"))
    given = [F.col(f"_found.{c}") for c in values]
    made = df.join(found, key, "left").withColumn("_c", filled_arrays(p, ignore, judged)(F.col(ids), states[0], *given))
    return made.select(*df.columns, "_c.*")


def _with_totals(asked: DataFrame, candidates: DataFrame, draws: DataFrame) -> DataFrame:
    """Add _total and _k, the weight and number of a left neighbour's followers, and _all, its count; _prev without followers becomes
    ANY_LEFT.

    Neighbours of at least a HEAD_PARTS-th of all weights, of which there are that many at most, are broadcast, and so are special
    tokens. Positions after others are joined; there no neighbour is frequent.
    """
    first = draws.filter("rank = 1")
    totals = first.select(F.col("prev").alias("_prev"), F.struct(F.col("total").alias("_total"), F.col("followers").alias("_k"), F.col("total").alias("_all")).alias("_t"))
    if draws is not candidates:
        counted = candidates.filter("rank = 1").select(F.col("prev").alias("_prev"), F.col("total").alias("_all"))
        totals = totals.join(counted, "_prev").withColumn("_t", F.col("_t").withField("_all", F.col("_all"))).drop("_all")
    anywhere = totals.filter(F.col("_prev") == ANY_LEFT).select("_t").first()
    if anywhere is None:
        raise ValueError("no proposals: the train split has no pair of tokens")
    anywhere = anywhere["_t"]
    special = F.col("_prev") < len(SPECIAL_TOKENS)
    head = special | (F.col("_t._all") >= anywhere["_all"] / HEAD_PARTS)
    met = asked.join(F.broadcast(totals.filter(head)), "_prev", "left")
    answered = F.col("_t").isNotNull() | special
    rest = met.filter(~answered).drop("_t").join(totals.filter(~head), "_prev", "left")
    sized = met.filter(answered).unionByName(rest)
    unseen = F.col("_t").isNull()
    values = [F.when(unseen, F.lit(anywhere[c])).otherwise(F.col(f"_t.{c}")).alias(c) for c in ("_total", "_k", "_all")]
    prev = F.when(unseen, F.lit(ANY_LEFT)).otherwise(F.col("_prev")).alias("_prev")
    return sized.select(*[prev if c == "_prev" else c for c in asked.columns], *values)


def masked_spots(p: float = MASK_PROB, ignore=(PAD,)):
    """Arrow function (input_ids, mask_state, sample_state) -> pos, label, left neighbour as shown, and draw of each masked position."""
    ignored = sorted({PAD, *ignore})
    fields = {"pos": pa.int32(), "label": pa.int32(), "prev": pa.int32(), "u": pa.float64()}

    @F.arrow_udf("array<struct<pos: int, label: int, prev: int, u: double>>")
    def run(ids: pa.Array, mask_hash: pa.Array, sample_hash: pa.Array) -> pa.Array:
        return _by_pieces(piece, ids, mask_hash, sample_hash)

    def piece(ids: pa.Array, mask_hash: pa.Array, sample_hash: pa.Array) -> pa.Array:
        flat, sizes = _flat(ids)
        masked = _draw_mask(flat, sizes, mask_hash, p, ignored)
        at = np.flatnonzero(masked)
        row, places = np.repeat(np.arange(len(sizes)), sizes)[at], _positions(sizes)[at]
        shown = np.where(masked, MASK, flat)
        prev = np.where(places > 0, shown[at - 1], ANY_LEFT) if len(at) else places
        u = wide_uniform_np(position_state_np(sample_hash.to_numpy(zero_copy_only=False)[row], places))
        values = [pa.array(v, type=kind) for v, kind in zip((places, flat[at], prev, u), fields.values())]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, list(fields)))

    return run


def filled_arrays(p: float = MASK_PROB, ignore=(PAD,), judged: bool = False):
    """Arrow function (input_ids, mask_state, pos, token[, nll, hit]) -> the fields of ``corrupt_arrays``, with what was drawn filled in."""
    ignored = sorted({PAD, *ignore})
    fields = CORRUPTED | (JUDGED if judged else {})

    @F.arrow_udf(f"struct<{', '.join(f'{name}: array<{kind}>' for name, kind in fields.items())}>")
    def run(ids: pa.Array, mask_hash: pa.Array, pos: pa.Array, *drawn: pa.Array) -> pa.Array:
        return _by_pieces(piece, ids, mask_hash, pos, *drawn)

    def piece(ids: pa.Array, mask_hash: pa.Array, pos: pa.Array, *drawn: pa.Array) -> pa.Array:
        flat, sizes = _flat(ids)
        masked = _draw_mask(flat, sizes, mask_hash, p, ignored)
        places, counts = _flat(pos)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + places.astype(np.int64)
        replaced = flat.astype(np.int32, copy=True)
        replaced[at] = _flat(drawn[0])[0]
        values = [masked, np.where(masked, flat, IGNORE_LABEL), np.where(masked, MASK, flat), replaced, (replaced != flat).astype(np.int32)]
        if judged:
            empty = np.ones(len(flat), bool)
            empty[at] = False
            nll, hit = np.zeros(len(flat)), np.zeros(len(flat), bool)
            nll[at], hit[at] = (_flat(x)[0] for x in drawn[1:])
            values += [pa.array(nll, mask=empty), pa.array(hit, mask=empty)]
        lists = [_lists(v, sizes, ids, _ARROW[kind]) for v, kind in zip(values, fields.values())]
        return pa.StructArray.from_arrays(lists, list(fields))

    return run


def _judged_by_join(picked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add _nll and _hit by looking up counts of (neighbour, label); the neighbour's own count is _all.

    Pairs that are a ten-thousandth of all or more, of which there are ten thousand at most under each kind of neighbour, are
    broadcast; what they don't answer is joined, and there no pair is frequent.
    """
    anywhere = candidates.filter(F.col("prev") == ANY_LEFT)
    sums = anywhere.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).select(F.struct("n", "k")).scalar()
    pairs = candidates.select(F.col("prev").alias("_prev"), F.col("token").alias("_label"), F.col("n").alias("_n"), (F.col("rank") == 1).alias("_best"))
    alone = anywhere.select(F.col("token").alias("_label"), F.col("n").alias("_n0"))
    many = sums["n"] / HOT_PARTS
    def looked_up(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
        values = [c for c in table.columns if c not in on]
        hot = table.filter(F.col(size) >= many).select(*on, F.struct(*values).alias("_h"), F.lit(True).alias("_known"))
        rest = table.filter(F.col(size) < many).select(*on, F.struct(*values).alias("_r"))
        met = rows.join(F.broadcast(hot), on, "left")
        # A row that was answered looks on under one of many keys that nothing has.
        nowhere = (F.lit(-2) - F.pmod(F.xxhash64("_pos", "_target"), F.lit(1 << 20))).cast("int")
        cold = [F.when(F.col("_known").isNull(), F.col(c)).otherwise(nowhere).alias(f"_k{c}") for c in on]
        same = [F.col(f"_k{c}") == F.col(f"_t{c}") for c in on]
        spread = met.select("*", *cold)
        kept = rest.select(*[F.col(c).alias(f"_t{c}") for c in on], "_r")
        answered = spread.join(kept, same, "left").withColumn("_v", F.coalesce("_h", "_r"))
        return answered.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in values])

    rows = looked_up(picked, pairs, ["_prev", "_label"], "_n")
    rows = looked_up(rows, alone, ["_label"], "_n0")
    chance = (F.coalesce("_n0", F.lit(0)) + 1) / (sums["n"] + sums["k"] + 1)
    after = (F.coalesce("_n", F.lit(0)) + chance) / (F.col("_all") + 1)
    nll = -F.log(F.when(F.col("_prev") == ANY_LEFT, chance).otherwise(after))
    return rows.withColumn("_nll", nll).withColumn("_hit", F.coalesce("_best", F.lit(False)))


def positions_of(df: DataFrame, keys: list[str], arrays: dict[str, str]) -> DataFrame:
    """Long form of parallel arrays: keys, pos and one column per array (``arrays`` maps array to column)."""
    zipped = F.arrays_zip(*[F.col(a).alias(c) for a, c in arrays.items()])
    long = df.select(*keys, F.posexplode_outer(zipped).alias("pos", "_z")).filter(F.col("pos").isNotNull())
    return long.select(*keys, "pos", *[F.col(f"_z.{c}").alias(c) for c in arrays.values()])
