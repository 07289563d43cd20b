"""From molecule strings to fixed-length model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.functions import ids as I
from molweave.functions.symbols import molecule_tokens
from molweave.operators.vocab import encode


def tokenize(df: DataFrame, text: str = "selfies", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, molecule_tokens(F.col(text)))


def model_inputs(df: DataFrame, max_length: int = I.MAX_LENGTH, ids: str = "ids") -> DataFrame:
    """input_ids, attention_mask and token_type_ids of untruncated ids."""
    framed = df.withColumn("_framed", I.add_template(I.truncate(F.col(ids), max_length)))
    return framed.select(
        *df.columns,
        I.pad(F.col("_framed"), max_length).alias("input_ids"),
        I.attention_mask(F.col("_framed"), max_length).alias("attention_mask"),
        I.token_type_ids(max_length).alias("token_type_ids"),
    )


def encode_text(
    df: DataFrame, vocab: DataFrame, text: str = "selfies", max_length: int = I.MAX_LENGTH, key: str | None = None
) -> DataFrame:
    """Replace a text column with model inputs; map-only with a vocabulary that fits in a broadcast, for batches and streams.

    Tokens past the limit are cut before the lookup. A larger vocabulary is joined by the unique ``key``.
    """
    cut = df.withColumn("_tokens", I.truncate(molecule_tokens(F.col(text)), max_length)).drop(text)
    coded = encode(cut, vocab, "_tokens", "_ids", key, keep=False)
    return model_inputs(coded, max_length, "_ids").drop("_ids")
