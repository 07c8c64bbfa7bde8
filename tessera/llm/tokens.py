"""Sizes of texts in tokens of a public tokenizer. The vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A byte-level BPE vocabulary as ranks; any file of that form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; null for null, 0 for an empty text. No special tokens are known or added."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(text)


def sized(documents: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens`` of every document with a text; documents with a null text have no size and no row."""
    return documents.where(F.col(text).isNotNull()).select(*keep, token_count(F.col(text), path).alias("tokens"))
