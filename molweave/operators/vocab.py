"""Vocabulary: training by counting, encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.ids import PAD, SPECIAL_TOKENS, UNK
from molweave.operators.ordering import dense_index
from molweave.sources.scratch import stored

# Entries a broadcast vocabulary may have. Beyond it, the rest is joined by a shuffle.
BROADCAST_LIMIT = 500_000


def count_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, n) without the special tokens.

    A hash aggregate with map-side partial sums, so a very frequent symbol costs one row per task in the shuffle. The outer form
    of explode is deliberate, here and below: for the plain one Spark infers a filter on the array's size and moves it under the
    projection, which would compute the tokens again.
    """
    tokens_only = df.select(F.explode_outer(tokens).alias("token")).filter(~F.col("token").isin(SPECIAL_TOKENS))
    return tokens_only.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def train_vocab(df: DataFrame, tokens: str = "tokens", max_size: int | None = None, min_frequency: int = 0) -> DataFrame:
    """(token, id, n): special tokens first, then by count descending and token ascending; every token unless told otherwise.

    The counts are range-partitioned to be numbered, and written once to the shared folder: no task sees all tokens.
    """
    room = None if max_size is None else max_size - len(SPECIAL_TOKENS)
    if room is not None and room < 0:
        raise ValueError("max_size is below the number of special tokens")
    counts = count_tokens(df, tokens).filter(F.col("n") >= min_frequency)
    ranked = dense_index(counts.withColumn("_rarity", -F.col("n")), "_rarity", "token")
    if room is not None:
        ranked = ranked.filter(F.col("idx") < room)
    numbered = ranked.select("token", (F.col("idx") + len(SPECIAL_TOKENS)).cast("int").alias("id"), "n")
    return special_rows(df.sparkSession).unionByName(numbered)


def special_rows(spark: SparkSession) -> DataFrame:
    ids = spark.range(0, len(SPECIAL_TOKENS), 1, 1)
    names = F.array(*[F.lit(t) for t in SPECIAL_TOKENS])
    place = F.col("id").cast("int")
    return ids.select(F.get(names, place).alias("token"), place.alias("id"), F.lit(0).cast("bigint").alias("n"))


def fits_broadcast(vocab: DataFrame, limit: int | None = None) -> bool:
    """True for a vocabulary of at most ``limit`` entries (BROADCAST_LIMIT)."""
    limit = BROADCAST_LIMIT if limit is None else limit
    return vocab.limit(limit + 1).count() <= limit


def _sized_like(values: pa.Array, lists: pa.Array) -> pa.Array:
    return _in_lists(values, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists)


def _in_lists(values: pa.Array, sizes: np.ndarray, like: pa.Array) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.is_null(like) if like.null_count else None)


def _row_of(lists: pa.Array) -> np.ndarray:
    """The row of each value of all lists."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)


def _shipped_index(vocab: DataFrame):
    table = vocab.select("token", "id").toArrow()
    return vocab.sparkSession.sparkContext.broadcast((table["token"].to_pandas(), table["id"].to_numpy().astype(np.int32)))


def token_lookup(vocab: DataFrame):
    """An Arrow function tokens -> ids for a vocabulary that fits in a broadcast.

    The entries travel once per executor; a task builds its index of them once, and looks up the different tokens of a batch.
    """
    shipped = _shipped_index(vocab)

    @F.arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, ids = shipped.value
        index = pd.Index(words)
        for tokens in batches:
            coded = tokens.flatten().dictionary_encode()
            place = index.get_indexer(coded.dictionary.to_pandas())
            known = np.where(place >= 0, ids[place], UNK).astype(np.int32)
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
            found = np.append(known, np.int32(UNK))[codes]
            yield _sized_like(pa.array(found), tokens)

    return lookup


def head_lookup(head: DataFrame):
    """An Arrow function tokens -> struct(ids, rest) for the frequent entries of a vocabulary.

    rest lists the different tokens of a row that are none of them; in ids the k-th of these, from 1, stands as -k.
    """
    shipped = _shipped_index(head)

    @F.arrow_udf("struct<ids: array<int>, rest: array<string>>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, ids = shipped.value
        index = pd.Index(words)
        for tokens in batches:
            coded = tokens.flatten().dictionary_encode()
            place = index.get_indexer(coded.dictionary.to_pandas())
            known = np.where(place >= 0, ids[place], -1).astype(np.int32)
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = np.append(known, np.int32(UNK))[codes]
            at = np.flatnonzero(found < 0)
            row, width = _row_of(tokens)[at], max(len(known), 1)
            pairs, which = np.unique(row * width + codes[at], return_inverse=True)
            sizes = np.bincount(pairs // width, minlength=len(tokens))
            before = np.cumsum(sizes) - sizes
            found[at] = before[row] - which - 1
            rest = coded.dictionary.take(pa.array(pairs % width))
            yield pa.StructArray.from_arrays([_sized_like(pa.array(found), tokens), _in_lists(rest, sizes, tokens)], ["ids", "rest"])

    return lookup


def encode(
    df: DataFrame,
    vocab: DataFrame,
    tokens: str = "tokens",
    out: str = "ids",
    key: str | None = None,
    limit: int | None = None,
    keep: bool = True,
) -> DataFrame:
    """Add the ids of ``tokens``; unknown tokens become [UNK], null stays null. Without ``keep`` the tokens themselves go.

    A map-only plan for a vocabulary that fits in a broadcast. A larger one is joined, which needs the name of a unique ``key``.
    Here and below ``vocab`` is a written table (``save_vocab``): it is read when the plan is made, and a vocabulary that is
    still a plan would be counted again each time.
    """
    if fits_broadcast(vocab, limit):
        coded = df.withColumn(out, token_lookup(vocab)(F.col(tokens)))
        return coded if keep else coded.drop(tokens)
    if key is None:
        raise ValueError("a vocabulary of this size is joined: name the unique key of the rows")
    return _encode_in_two(df, vocab, key, tokens, out, limit, keep)


def _encode_in_two(df: DataFrame, vocab: DataFrame, key: str, tokens: str, out: str, limit: int | None, keep: bool) -> DataFrame:
    """Ids of the frequent head by lookup, all others by a join of each row's different tokens with the tail of the vocabulary.

    Ids are dense and fall with the frequency, so ``id < limit`` bounds the lookup, and few tokens of a sequence are left for the
    join. The rows are written once with the ids found; a token enters the join once per row, so a tail token has few rows there,
    and an unknown one at most as many as there are sequences, which Spark's skew join splits.
    """
    limit = BROADCAST_LIMIT if limit is None else limit
    names = [c for c in df.columns if c != out and (keep or c != tokens)]
    looked = df.withColumn("_h", head_lookup(vocab.filter(F.col("id") < limit))(F.col(tokens)))
    rows = stored(looked.select(*names, F.col("_h.ids").alias("_head"), F.col("_h.rest").alias("_rest")), "encoded")
    asked = rows.select(key, F.posexplode_outer("_rest").alias("_k", "_token")).filter(F.col("_k").isNotNull())
    tail = vocab.filter(F.col("id") >= limit).select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    cell = F.struct("_k", F.coalesce("_id", F.lit(UNK)).alias("id"))
    found = asked.join(tail, "_token", "left").groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("_found"))
    filled = F.transform("_head", lambda x: F.when(x < 0, F.get("_found", -x - 1)["id"]).otherwise(x))
    ids = F.when(F.col("_found").isNull(), F.col("_head")).otherwise(filled)
    return rows.join(found, key, "left").select(*names, ids.alias(out))


def encode_by_join(
    df: DataFrame, vocab: DataFrame, key: str, tokens: str = "tokens", out: str = "ids", limit: int | None = None
) -> DataFrame:
    """(key, ids) by an explode, a left join and a regroup; for vocabularies of any size.

    ``key`` is unique, so a group is one sequence. A vocabulary that fits in a broadcast is joined with all positions, and the
    partial aggregation of the regroup sends each sequence as one array. Of a larger one the frequent head is looked up before the
    explode, and only the tokens that it doesn't know are exploded, joined and regrouped.
    """
    if not fits_broadcast(vocab, limit):
        coded = _encode_in_two(df.select(key, tokens), vocab, key, tokens, out, limit, keep=False)
        return coded.select(key, F.coalesce(out, F.array().cast("array<int>")).alias(out))
    long = df.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    coded = long.join(F.broadcast(vocab.select("token", "id")), "token", "left")
    cell = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("id", F.lit(UNK)).alias("id")))
    return coded.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("cells")).select(
        key, F.col("cells.id").alias(out)
    )


def decode_long(df: DataFrame, vocab: DataFrame, key: str, ids: str = "input_ids", limit: int | None = None) -> DataFrame:
    """(key, pos, token) of the positions before the first [PAD].

    The cut needs no join: the first [PAD] is a property of the array the row still has.
    """
    coded = decode(df, vocab, key, ids, "_tokens", limit)
    return coded.select(key, F.posexplode_outer("_tokens").alias("pos", "token")).filter(F.col("pos").isNotNull())


def decode(
    df: DataFrame, vocab: DataFrame, key: str, ids: str = "input_ids", out: str = "tokens", limit: int | None = None
) -> DataFrame:
    """(key, tokens) up to the first [PAD]: one Arrow lookup per batch (map-only), or a join for a larger vocabulary."""
    return with_tokens(df.select(key, before_padding(F.col(ids)).alias(ids)), vocab, key, ids, out, limit).select(key, out)


def with_tokens(df: DataFrame, vocab: DataFrame, key: str, ids: str, out: str, limit: int | None = None) -> DataFrame:
    """Add the tokens of ``ids``; null stays null, and ids outside the vocabulary read as [UNK].

    Of a vocabulary that is too large to broadcast the frequent head is looked up, and the other different ids of a row are joined.
    The rows are then written once, so callers select what they need.
    """
    if fits_broadcast(vocab, limit):
        none = F.lit(None)
        return df.withColumn(out, id_lookup(vocab)(F.col(ids), none.cast("array<int>"), none.cast("array<string>")))
    limit = BROADCAST_LIMIT if limit is None else limit
    rows = stored(df, "shown")
    rare = F.array_distinct(F.filter(ids, lambda x: x >= limit))
    asked = rows.select(key, F.explode_outer(rare).alias("_id")).filter(F.col("_id").isNotNull())
    tail = vocab.filter(F.col("id") >= limit).select(F.col("id").alias("_id"), F.col("token").alias("_token"))
    found = asked.join(tail, "_id").groupBy(key).agg(F.collect_list(F.struct("_id", "_token")).alias("_found"))
    tokens = id_lookup(vocab.filter(F.col("id") < limit))(F.col(ids), F.col("_found._id"), F.col("_found._token"))
    return rows.join(found, key, "left").withColumn(out, tokens).drop("_found")


def id_lookup(head: DataFrame):
    """An Arrow function (ids, more_ids, more_tokens) -> tokens.

    ``head`` has the ids from 0 on, few enough for a broadcast; the other two name further ids of the row. All others read as [UNK].
    """
    table = head.select("token", "id").toArrow()
    words = table["token"].combine_chunks().take(pc.sort_indices(table["id"].combine_chunks()))
    shipped = head.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("array<string>")
    def lookup(ids: pa.Array, more_ids: pa.Array, more_tokens: pa.Array) -> pa.Array:
        known = shipped.value
        flat = ids.flatten()
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known)))
        place = pc.fill_null(pc.if_else(inside, flat, UNK), UNK).to_numpy(zero_copy_only=False).astype(np.int64)
        named = more_ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(named):
            pairs = (_row_of(more_ids) << 32) | named
            order = np.argsort(pairs)
            at = np.flatnonzero(pc.fill_null(pc.greater_equal(flat, len(known)), False).to_numpy(zero_copy_only=False))
            asked = (_row_of(ids)[at] << 32) | flat.to_numpy(zero_copy_only=False)[at].astype(np.int64)
            near = order[np.minimum(np.searchsorted(pairs[order], asked), len(pairs) - 1)]
            hit = pairs[near] == asked
            place[at[hit]] = len(known) + near[hit]
            known = pa.concat_arrays([known.cast(pa.string()), more_tokens.flatten().cast(pa.string())])
        return _sized_like(known.take(pa.array(place)), ids)

    return lookup


def before_padding(ids: Column) -> Column:
    """The part of a sequence before its first [PAD]; all of it when there is none."""
    first = F.array_position(ids, F.lit(PAD))
    return F.when(first > 0, F.slice(ids, F.lit(1), (first - 1).cast("int"))).otherwise(ids)


def length_profile(df: DataFrame, tokens: str = "tokens", max_length: int = 512) -> DataFrame:
    """Longest sequence, number and share of sequences longer than max_length."""
    size = F.coalesce(F.size(tokens), F.lit(0))
    over = size > max_length
    return df.agg(
        F.max(size).alias("longest"),
        F.count_if(over).alias("n_over"),
        F.avg(over.cast("int")).alias("share_over"),
        F.count(F.lit(1)).alias("n_sequences"),
    )
