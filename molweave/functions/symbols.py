"""Splitting molecule strings and text into tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a SELFIES symbol is a bracketed group; a dot separates fragments.
SYMBOL_PATTERN = r"\[[^\]]*\]|\."
# Fixed value: one character with the Unicode White_Space property.
WHITESPACE = r"\p{IsWhite_Space}"


def split_symbols(selfies: Column) -> Column:
    """Symbols of a SELFIES string in order; text outside brackets is skipped, null stays null."""
    return F.regexp_extract_all(selfies, F.lit(SYMBOL_PATTERN), F.lit(0))


def join_symbols(symbols: Column) -> Column:
    """Symbols as one space-separated string."""
    return F.array_join(symbols, " ")


def whitespace_tokens(text: Column) -> Column:
    """Non-empty runs between whitespace."""
    return F.array_remove(F.split(text, WHITESPACE + "+"), "")


def molecule_tokens(selfies: Column) -> Column:
    """Tokens the vocabulary sees: symbols, joined by spaces and split on whitespace.

    A symbol without whitespace is its own token, so the join and second split run only on the rare string that has
    whitespace in it.
    """
    symbols = split_symbols(selfies)
    return F.when(selfies.rlike(WHITESPACE), whitespace_tokens(join_symbols(symbols))).otherwise(symbols)
