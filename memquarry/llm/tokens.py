"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is read where it lies, once per Python worker; its folder is a
parameter.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary divides a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; null has none. The encoder's time is in proportion to the
    text, also where nothing divides it."""
    return len(encoding(folder, vocabulary).encode_ordinary(text)) if text else 0


def n_tokens(text_col: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """A column with the token count of ``text_col``."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count(t, folder, vocabulary) for t in texts], dtype="int32")

    return counted(text_col)
