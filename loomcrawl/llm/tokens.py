"""Public tokenizers by path. Loaded once per Python worker; never copied or trained."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks file of the byte-level vocabulary; the path must exist on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str = RANKS) -> np.ndarray:
    """Length in bytes of every token."""
    enc = encoding(path)
    size = np.zeros(enc.n_vocab, np.int64)
    for token in enc._mergeable_ranks.items():
        size[token[1]] = len(token[0])
    return size


def encode(text: str, path: str = RANKS) -> list[int]:
    """Tokens of a text; a lone surrogate counts as the replacement character."""
    try:
        return encoding(path).encode_ordinary(text)
    except UnicodeEncodeError:
        return encoding(path).encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def token_count(text: Column, path: str = RANKS) -> Column:
    """Number of tokens; 0 for NULL."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(encode(t, path)) if t else 0 for t in texts], dtype="int32")

    return F.coalesce(count(text), F.lit(0))
