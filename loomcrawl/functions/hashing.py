"""64-bit hashes with wrap-around (F7-F11) and digests.

The wrapping hashes are Arrow UDFs over numpy ``uint64``: Catalyst's bigint product
raises on overflow in ANSI mode, and a fold over single bytes would be interpreted
byte by byte. Strings of a batch are hashed together, one byte position at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, djb2 and the 64-bit avalanche of Murmur3.
FNV_START = np.uint64(0xCBF29CE484222325)
FNV_PRIME = np.uint64(0x100000001B3)
DJB_START = np.uint64(5381)
DJB_FACTOR = np.uint64(33)
AVALANCHE = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
POSITIVE = 0x7FFFFFFFFFFFFFFF


def _rolling(texts: list[bytes], start: np.uint64, step) -> np.ndarray:
    """Apply ``step(h, byte)`` along every string; strings are sorted so that the live ones are a prefix."""
    if not texts:
        return np.zeros(0, np.uint64)
    size = np.array([len(t) for t in texts])
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8).astype(np.uint64)
    begin = np.concatenate([[0], np.cumsum(size[order])[:-1]])
    live = np.searchsorted(-size[order], -np.arange(int(size.max())), side="left")
    h = np.full(len(texts), start, np.uint64)
    for k, n in enumerate(live):
        h[:n] = step(h[:n], flat[begin[:n] + k])
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a64_array(texts: list[bytes]) -> np.ndarray:
    return _rolling(texts, FNV_START, lambda h, b: (h ^ b) * FNV_PRIME)


def djb2_array(texts: list[bytes]) -> np.ndarray:
    return _rolling(texts, DJB_START, lambda h, b: h * DJB_FACTOR + b)


def avalanche(h: np.ndarray) -> np.ndarray:
    s = np.uint64(33)
    h = (h ^ (h >> s)) * AVALANCHE[0]
    h = (h ^ (h >> s)) * AVALANCHE[1]
    return h ^ (h >> s)


def mix64_array(texts: list[bytes]) -> np.ndarray:
    return avalanche(fnv1a64_array(texts))


def _udf(array):
    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        values = array([t.encode("utf-8", "replace") for t in texts[known]]).view(np.int64)
        out = pd.Series(pd.array([None] * len(texts), dtype="Int64"))
        out[known] = values
        return out

    return hashed


def fnv1a64(text: Column) -> Column:
    """F7 as a signed bigint; NULL for NULL."""
    return _udf(fnv1a64_array)(text)


def djb2_64(text: Column) -> Column:
    """F8."""
    return _udf(djb2_array)(text)


def mix64(text: Column) -> Column:
    """F9."""
    return _udf(mix64_array)(text)


def hex64(value: Column) -> Column:
    """Sixteen hexadecimal digits of a 64-bit value."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hex_short(value: Column) -> Column:
    """unsigned, without padding."""
    return F.lower(F.hex(value))


def bucket_of(fnv: Column, buckets: int = 256) -> Column:
    """F10."""
    return (fnv.bitwiseAND(F.lit(POSITIVE)) % buckets).cast("int")


def bloom_indexes(fnv: Column, djb: Column, bits: int, k: int) -> Column:
    """``((h1 + i*h2) & MAX) % bits`` for i < k, with wrap-around.

    The sum is formed in two 32-bit halves, so it wraps without overflowing bigint.
    """
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda x: F.shiftrightunsigned(x, 32)

    def index(i: Column) -> Column:
        lo = low(fnv) + i * low(djb)
        hi = low(high(fnv) + i * high(djb) + high(lo))
        return (F.shiftleft(hi.bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(low(lo)) % bits).cast("bigint")

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), index)


def bloom_slots(text: Column, bits: int, k: int) -> Column:
    """F11 from the text itself: array of its k bit positions; NULL for NULL."""

    @F.pandas_udf("array<bigint>")
    def slots(texts: pd.Series) -> pd.Series:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        a, b = fnv1a64_array(raw), djb2_array(raw)
        at = [((a + np.uint64(i) * b) & np.uint64(POSITIVE)) % np.uint64(bits) for i in range(k)]
        rows = np.stack(at, axis=1).astype(np.int64) if len(raw) else np.zeros((0, k), np.int64)
        return pd.Series([row if ok else None for row, ok in zip(rows, texts.notna())], dtype=object)

    return slots(text)
