"""Fixed-length id sequences: template, truncation, padding, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special tokens take the first ids, in this order.
SPECIAL_TOKENS = ["[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]"]
UNK, CLS, SEP, PAD, MASK = range(5)
# Model input length, and the label of positions a loss leaves out.
MAX_LENGTH = 512
IGNORE_LABEL = -100


def body_length(max_length: int = MAX_LENGTH) -> int:
    """Places left for a sequence once [CLS] and [SEP] are counted."""
    if max_length < 2:
        raise ValueError("max_length must leave room for [CLS] and [SEP]")
    return max_length - 2


def truncate(items: Column, max_length: int = MAX_LENGTH) -> Column:
    """Keep what fits in max_length with [CLS] and [SEP]; works on ids and, before the lookup, on tokens."""
    return F.slice(items, 1, body_length(max_length))


def add_template(ids: Column) -> Column:
    """[CLS] ids [SEP]; a null sequence becomes [CLS] [SEP]."""
    body = F.coalesce(ids, F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)))


def pad(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    """Right-pad with [PAD]; callers truncate first."""
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size(ids)))


def attention_mask(ids: Column, max_length: int = MAX_LENGTH) -> Column:
    """1 for each id of the unpadded sequence, 0 for the padding after it."""
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.lit(max_length) - F.size(ids)))


def token_type_ids(max_length: int = MAX_LENGTH) -> Column:
    return F.array_repeat(F.lit(0), max_length)


def lm_labels(input_ids: Column) -> Column:
    """Copy of input_ids with every [PAD] as the ignored label."""
    return F.transform(input_ids, lambda x: F.when(x == PAD, F.lit(IGNORE_LABEL)).otherwise(x))
