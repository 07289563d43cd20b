"""Token ids of a public byte-level BPE vocabulary.

``tokenizers`` defines the ids. The same merges in ``tiktoken`` give the same ids four times as fast (tests compare the two on
whole tables and on all code points). The vocabulary files are parameters and must lie at the same place on all executors; they are read once per worker.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np

MODEL = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


@dataclass(frozen=True)
class Vocabulary:
    model_path: str
    ranks_path: str
    pattern: str

    def encoder(self):
        """The tiktoken form, kept in that library's own table so that a reused worker builds it once."""
        import tiktoken
        from tiktoken.registry import ENCODINGS

        name = f"molweave:{self.ranks_path}"
        if name not in ENCODINGS:
            with open(self.ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            ENCODINGS[name] = tiktoken.Encoding(
                name, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
            )
        return ENCODINGS[name]

    def encode(self, text: str, encoder=None) -> np.ndarray:
        return (encoder or self.encoder()).encode_to_numpy(text, allowed_special="all")


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(MODEL), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
