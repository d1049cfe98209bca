"""Evaluation texts inside training text (problem 9): a prefix-filtered set join.

An item is cut into windows of 13 words; a window is the set of its nine 5-word
shingles at fixed positions. A document contains the window when it has all nine, so it
is enough to look for one of them, the window's prefix: the shingle that is rarest in
the corpus. One pass over the corpus counts the items' shingles; a second one probes
each document for prefixes only, checks the position and length bounds and the other
eight shingles where a prefix stands, and compares the thirteen words themselves. Words
and shingles are hashed for a whole Arrow batch at once; no corpus row is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 13
SHINGLE = 5
#: Shingles of a window.
PARTS = WORDS - SHINGLE + 1
#: Characters of items that one probe of the corpus holds (about 100 MB). More items are
#: probed in so many blocks, each against all documents.
BLOCK_CHARS = 4_000_000
#: Characters that are hashed together; a longer text is hashed whole by itself.
CHUNK_CHARS = 500_000
_FILTER_BITS = 22
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)])


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        table = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            table.append(np.cumprod(steps, dtype=np.uint64))
        _powers.clear()
        _powers[size] = tuple(table)
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of several texts: their places, texts and hashes, and the hash of every shingle."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts).lower()
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff(_letters()[code].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(self.start)
        # A line feed is no word, so the k-th text ends at its k-th own separator; lower-casing may change lengths.
        lengths = np.array([len(t.lower()) + 1 for t in texts], np.int64)
        self.owner = np.searchsorted(np.cumsum(lengths), self.start, side="right")
        power, inverse = _power_table(len(code))
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], out=sums[1:])
        word = _mix((sums[self.end] - sums[self.start]) * inverse[self.start])
        if n < SHINGLE:
            self.shingle, self.whole = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        h = word[: n - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            h = h * _STEP + word[k : n - SHINGLE + 1 + k]
        self.shingle = _mix(h)
        self.whole = self.owner[: n - SHINGLE + 1] == self.owner[SHINGLE - 1 :]

    def window(self, first: int) -> tuple[str, ...]:
        return tuple(self.text[a:b] for a, b in zip(self.start[first : first + WORDS], self.end[first : first + WORDS]))

    def window_starts(self) -> np.ndarray:
        """Words at which a window of one text begins."""
        n = len(self.start) - WORDS + 1
        return np.flatnonzero(self.owner[:n] == self.owner[WORDS - 1 :]) if n > 0 else np.zeros(0, np.int64)


class KeySet:
    """Place of 64-bit keys in a sorted array, behind a bit table that stops nearly all others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[self.keys & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``hashes``, place of the key) of the hashes that are keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.table[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        place = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[place] == hashes[maybe]
        return maybe[hit], place[hit]


class Windows:
    """Distinct windows of a block of items: their words, shingles and items."""

    def __init__(self, texts: list[str]):
        words = Words(texts)
        number: dict[tuple[str, ...], int] = {}
        owners: list[set[int]] = []
        first = []
        for at in words.window_starts():
            key = words.window(at)
            k = number.setdefault(key, len(owners))
            if k == len(owners):
                owners.append(set())
                first.append(at)
            owners[k].add(int(words.owner[at]))
        self.words = list(number)
        self.items = [np.array(sorted(x)) for x in owners]
        at = np.array(first, np.int64)
        self.parts = words.shingle[at[:, None] + np.arange(PARTS)] if len(at) else np.zeros((0, PARTS), np.uint64)

    def prefixes(self, keys: KeySet, counts: np.ndarray) -> Prefixes:
        return Prefixes(self, counts[np.searchsorted(keys.keys, self.parts)])


class Prefixes:
    """For each window its rarest shingle (the first of equals); windows none of whose shingles is missing from the corpus."""

    def __init__(self, windows: Windows, counts: np.ndarray):
        possible = np.flatnonzero((counts > 0).all(axis=1))
        offset = counts[possible].argmin(axis=1) if len(possible) else np.zeros(0, np.int64)
        key = windows.parts[possible, offset] if len(possible) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.window, self.offset = possible[order], offset[order]
        self.keys = KeySet(key)
        self.first = np.searchsorted(key[order], self.keys.keys, side="left")
        self.last = np.searchsorted(key[order], self.keys.keys, side="right")
        self.windows = windows

    def matches(self, words: Words) -> list[tuple[int, int]]:
        """(text, window) of every window that stands in a text, once each."""
        at, place = self.keys.find(words.shingle)
        inside = words.whole[at]
        at, place = at[inside], place[inside]
        many = self.last[place] - self.first[place]
        entry = np.repeat(self.first[place] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else np.zeros(0, np.int64)
        start = np.repeat(at, many) - self.offset[entry]
        ok = (start >= 0) & (start + WORDS <= len(words.start))
        start, window = start[ok], self.window[entry[ok]]
        same = words.owner[start] == words.owner[start + WORDS - 1]
        start, window = start[same], window[same]
        for k in range(PARTS):
            same = words.shingle[start + k] == self.windows.parts[window, k]
            start, window = start[same], window[same]
        found = {}
        for s, w in zip(start.tolist(), window.tolist()):
            key = (int(words.owner[s]), w)
            if key not in found and words.window(s) == self.windows.words[w]:
                found[key] = None
        return list(found)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, texts) of parts of about ``CHUNK_CHARS``; NULL is empty."""
    first, part, size = 0, [], 0
    for k, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > CHUNK_CHARS:
            yield first, part
            first, part, size = k, [], 0
        part.append(text)
        size += len(text)
    if part:
        yield first, part


def shingle_counts(documents: DataFrame, keys: KeySet) -> np.ndarray:
    """How often each key stands in all documents; the driver gets one number per key."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys.keys), np.int64)
        for frame in frames:
            for _, part in _chunks(frame["text"].to_pylist()):
                words = Words(part)
                at, place = keys.find(words.shingle)
                total += np.bincount(place[words.whole[at]], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["place", "n"])

    counts = np.zeros(len(keys.keys), np.int64)
    partial = documents.select("text").mapInArrow(run, "place bigint, n bigint")
    frame: pd.DataFrame = partial.groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts[frame["place"].to_numpy(np.int64)] = frame["n"].to_numpy(np.int64)
    return counts


def _probe(documents: DataFrame, prefixes: Prefixes, ids: pa.Array, schema: T.StructType) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows, items = [], []
            for first, part in _chunks(frame["text"].to_pylist()):
                pairs = {(k, i) for k, w in prefixes.matches(Words(part)) for i in prefixes.windows.items[w].tolist()}
                for k, i in sorted(pairs):
                    rows.append(first + k)
                    items.append(i)
            if rows:
                yield pa.record_batch([frame["doc_id"].take(pa.array(rows, pa.int64())), ids.take(pa.array(items, pa.int64()))], names=["doc_id", "item_id"])

    return documents.mapInArrow(run, schema)


def leaked_items(documents: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id), once each: the document holds 13 consecutive words of the item.

    NULL and short texts on either side give no row, nor do rows without an id; an empty
    table gives none. A document id that occurs with several texts has the items of each
    of them: a passage must stand in one text. The driver holds one block of items at a
    time; items are spread over blocks by hash.
    """
    held = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", held.schema["item_id"].dataType)])
    total = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    found = documents.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        own = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else held
        part = own.toArrow()
        windows = Windows(part["text"].to_pylist())
        if not windows.words:
            continue
        keys = KeySet(windows.parts.ravel())
        prefixes = windows.prefixes(keys, shingle_counts(docs, keys))
        found = found.unionByName(_probe(docs, prefixes, part["item_id"].combine_chunks(), schema))
    return found.distinct()


def leak_report(found: DataFrame) -> DataFrame:
    """(item_id, n_docs): how many documents each leaked item stands in."""
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
