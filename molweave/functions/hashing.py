"""Reproducible randomness.

Nothing in this package calls ``rand()``: every draw is a hash of (seed, row key, position), so it does not depend on
partitioning, survives task retries and can be written in plain SQL.

Two levels keep it cheap. A row key of any type is hashed once per row with md5 (``key_hash``); the positions of that
row are then mixed in with 64-bit integer arithmetic that stays inside generated code (``position_state``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
# Odd multipliers of a public 32-bit integer hash and of Fibonacci hashing.
MIX_MULTIPLIER = 73244475
STEP_MULTIPLIER = 2654435761


def key_hash(seed, *keys) -> Column:
    """52-bit integer hash of the seed and any number of key columns."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """A number in [0, 1) for each key."""
    return key_hash(seed, *keys) / F.lit(float(1 << 52))


def _scramble(x: Column) -> Column:
    return (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX_MULTIPLIER)).bitwiseAND(F.lit(MASK32))


def position_state(state: Column, position: Column) -> Column:
    """32-bit state (as bigint) of one position of a row, or of one candidate of a position.

    All bits of the row hash enter: the low ones with the position, the high ones between the two rounds.
    """
    step = (position.cast("bigint") * F.lit(STEP_MULTIPLIER)).bitwiseAND(F.lit(MASK32))
    x = _scramble(state.bitwiseAND(F.lit(MASK32)).bitwiseXOR(step))
    x = _scramble(x.bitwiseXOR(F.shiftright(state, 32)))
    return x.bitwiseXOR(F.shiftright(x, 16))


def state_uniform(state: Column) -> Column:
    return state / F.lit(float(1 << 32))


def position_uniform(state: Column, position: Column) -> Column:
    """A number in [0, 1) for each (row hash, position)."""
    return state_uniform(position_state(state, position))


def wide_uniform(state: Column) -> Column:
    """A number in [0, 1) with 52 random bits, of a position's state."""
    high, low = (position_state(state, F.lit(k)) for k in (0, 1))
    return (high * F.lit(1 << 20) + F.shiftright(low, 12)) / F.lit(float(1 << 52))


def position_state_np(state: np.ndarray, position: np.ndarray) -> np.ndarray:
    """The same arithmetic as ``position_state`` on numpy arrays, for use inside Arrow functions."""
    state = state.astype(np.int64)
    x = (state & MASK32) ^ ((position.astype(np.int64) * STEP_MULTIPLIER) & MASK32)
    for late in (0, state >> 32):
        x = x ^ late
        x = ((x ^ (x >> 16)) * MIX_MULTIPLIER) & MASK32
    return x ^ (x >> 16)


def wide_uniform_np(state: np.ndarray) -> np.ndarray:
    high, low = (position_state_np(state, np.full(len(state), k)) for k in (0, 1))
    return ((high << 20) + (low >> 12)) / float(1 << 52)
