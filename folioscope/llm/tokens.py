"""Sizes of texts in tokens of a public tokenizer; its vocabulary is read from a path, never copied."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default vocabulary: ranks of a byte-level BPE for many languages.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern by which byte-level BPE vocabularies of this family part a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ``.tiktoken`` file, read once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("folioscope", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text in column ``text``; a null text has none (0)."""

    def count(texts: pd.Series) -> pd.Series:
        e = encoding(vocabulary)
        return pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())(F.col(text))
