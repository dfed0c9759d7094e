"""Token counts by a public tokenizer; the vocabulary file is a parameter and loaded once per worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the rank files of these vocabularies split a text before their merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = 1 << 18):
    """A very long text in parts that end at white space, so that the tokenizer's time stays linear."""
    at = 0
    while len(text) - at > size:
        z = max(text.rfind(" ", at + 1, at + size), text.rfind("\n", at + 1, at + size))
        z = z if z > at else at + size
        yield text[at:z]
        at = z
    yield text[at:]


def count(text: str | None, path: str = VOCABULARY) -> int:
    return sum(len(encoder(path).encode_ordinary(p)) for p in pieces(text)) if text else 0


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text; 0 for null and empty ones."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t, path) for t in texts], dtype="int32")

    return counted(text)
