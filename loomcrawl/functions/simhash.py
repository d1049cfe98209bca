"""Simhash fingerprints and near-duplicate search.

A fingerprint is the sign of 64 weighted votes over the text's word trigrams. The
search never compares all pairs: two fingerprints within distance k agree wholly on at
least ``blocks - k`` of ``blocks`` bit blocks. They are sent to groups by one block each and
sorted there by every choice of the others. Equal fingerprints are one row, so copies cost nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcrawl.functions.hashing import mix64_array

_DELIMITERS = re.compile(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+")
SHINGLE = 3
#: Fingerprints of a group, or of small groups together, that are searched at once; pairs that are looked at at once.
GROUP = UNIT = 500_000
PAIRS = 1_000_000


def tokens(text: str) -> list[str]:
    """lower case, split at blanks and ASCII punctuation; a leading empty token stays, trailing ones go."""
    found = _DELIMITERS.split(text.lower())
    if len(found) == 1:
        return found
    while found and not found[-1]:
        found.pop()
    return found


def shingles(words: list[str], n: int = SHINGLE) -> list[str]:
    """word n-grams, or the words themselves when there are fewer than n."""
    if len(words) < n:
        return words
    return [" ".join(x) for x in zip(*(words[i:] for i in range(n)))]


def simhash_array(texts: list[str]) -> np.ndarray:
    """A1: fingerprints of many texts, every text whole."""
    lists = [shingles(tokens(t)) for t in texts]
    out = np.zeros(len(texts), np.uint64)
    at = 0
    while at < len(lists):  # parts of about a million shingles, to bound the vote matrix
        end, total = at, 0
        while end < len(lists) and (total == 0 or total + len(lists[end]) <= 200_000):
            total += len(lists[end])
            end += 1
        part = lists[at:end]
        flat = [s.encode("utf-8", "replace") for x in part for s in x]
        if flat:
            hashes = mix64_array(flat)
            owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
            acc = np.zeros((len(part), 64), np.int64)
            for bit in range(64):
                ones = ((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.float64)
                acc[:, bit] = np.bincount(owner, 2 * ones - 1, len(part)).astype(np.int64)
            out[at:end] = ((acc > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        at = end
    return out


def simhash64(text: Column) -> Column:
    """Fingerprint as a signed bigint; a NULL text counts as empty."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(simhash_array([t if t is not None else "" for t in texts]).view(np.int64))

    return run(text)


def hamming(a: Column, b: Column) -> Column:
    """F14."""
    return F.bit_count(a.bitwiseXOR(b))


def is_near_duplicate(a: Column, b: Column, k: int) -> Column:
    """F15."""
    return hamming(a, b) <= k


def lane(fp: Column, index: int, k: int) -> Column:
    """F16: one of k + 1 lanes; no wider than a lane, so that flipped bits never spoil two."""
    width = 64 // (k + 1)
    return F.shiftrightunsigned(fp, index * width).bitwiseAND(F.lit((1 << min(16, width)) - 1))


def block_masks(blocks: int, low: int = 0, high: int = 64) -> list[int]:
    """The bits from ``low`` to ``high`` cut into so many blocks."""
    cuts = [low + round(i * (high - low) / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def _exact_blocks(bits: int, errors: int, group: int) -> int:
    """How many of errors + n blocks to ask for: more choices to sort by, or more pairs a choice to look at."""

    def cost(n: int) -> float:
        return comb(errors + n, n) * (2 + group / 2 ** (1 + bits * n / (errors + n)))

    return min(range(1, max(2, min(9, bits - errors + 1))), key=cost)


def _near_in(fps: np.ndarray, second: np.ndarray | None, block: int, k: int, blocks: int, group: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of ``fps`` whose first equal block is ``block``, each once; with ``second`` pairs of one inside and one outside it.

    The blocks below differ, so the bits above differ in at most k - block places: of k - block + n
    smaller blocks there at least n are equal. A pair belongs to the first n.
    """
    routes = block_masks(blocks)
    start, errors = sum(routes[: block + 1]).bit_length(), k - block
    n = _exact_blocks(64 - start, errors, group)
    masks = block_masks(errors + n, start)
    for chosen in combinations(range(errors + n), n):
        keys = fps & np.uint64(routes[block] | sum(masks[i] for i in chosen))
        order = np.argsort(keys)
        keys, sorted_fps = keys[order], fps[order]
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        after = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(keys)) - 1  # later ones with this key
        total = np.cumsum(after)
        differ = [np.uint64(m) for m in routes[:block] + [masks[i] for i in range(chosen[-1]) if i not in chosen]]
        at = 0
        while at < len(keys):  # parts of about a million pairs, or one fingerprint's
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            many = after[at:to]
            left = np.repeat(np.arange(at, to), many)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
            at = to
            x = sorted_fps[left] ^ sorted_fps[right]
            distance = np.bitwise_count(x)
            keep = np.flatnonzero(distance <= k)
            if second is not None:
                keep = keep[second[order[left[keep]]] != second[order[right[keep]]]]
            for m in differ:
                keep = keep[(x[keep] & m) != 0]
            if len(keep):
                yield sorted_fps[left[keep]], sorted_fps[right[keep]], distance[keep]


def _search(k: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search of rows (fp, block, key, lo, hi, second) in the order of their groups; small groups of a block go together."""

    def search(held: list[tuple], largest: int) -> Iterator[pa.RecordBatch]:
        fps = np.concatenate([x[1] for x in held])
        block, _, lo, hi = held[0][0]
        second = np.concatenate([x[2] for x in held]) if lo < hi else None
        for a, b, distance in _near_in(fps, second, block, k, blocks, largest):
            a, b = a.view(np.int64), b.view(np.int64)
            arrays = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(distance.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["fp_a", "fp_b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (group, fingerprints, second) of whole groups, then of the one being read
        rows = size = largest = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("block", "key", "lo", "hi")]
            fps, second = batch.column("fp").to_numpy().view(np.uint64), batch.column("second").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                group = tuple(int(c[i]) for c in names)
                last = held[-1][0] if held else group
                if group != last:
                    size = 0
                    if group[0] != last[0] or rows >= UNIT or group[2] >= 0 or last[2] >= 0:  # slices are searched by themselves
                        yield from search(held, largest)
                        held, rows, largest = [], 0, 0
                held.append((group, fps[i:j].copy(), second[i:j].copy()))
                rows, size = rows + j - i, size + j - i
                largest = max(largest, size)
        if held:
            yield from search(held, largest)

    return run


def near_pairs(fingerprints: DataFrame, k: int = 3, blocks: int | None = None) -> DataFrame:
    """(fp_a, fp_b, distance) of distinct fingerprints, fp_a < fp_b, at most k bits apart.

    ``fingerprints`` has a column fp. A fingerprint goes to k + 1 groups, one for each of its first
    k + 1 of ``blocks`` blocks (k + 3 by default), and is compared there by choices of smaller
    blocks. A group of more than GROUP is cut into slices and each slice searched against each,
    so no task holds more than two slices, whatever the group.
    """
    blocks = blocks or k + 3
    one = fingerprints.select("fp").where(F.col("fp").isNotNull()).distinct()
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks)[: k + 1]]
    keyed = one.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("block", "key"))
    heavy = keyed.groupBy("block", "key").count().where(F.col("count") > GROUP).select("block", "key", F.ceil(F.col("count") / GROUP).cast("int").alias("slices"))
    own = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi"), (own > other).alias("second")))
    whole = F.array(F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(False).alias("second")))
    # heavy has at most (k + 1) / GROUP of the rows; what is exploded is never broadcast: Spark expects it as small as its source
    routed = keyed.join(F.broadcast(heavy), ["block", "key"], "left").select("fp", "block", "key", F.explode(F.when(F.col("slices").isNull(), whole).otherwise(cells)).alias("c")).select("fp", "block", "key", "c.*")
    group = ["block", "key", "lo", "hi"]
    return routed.repartition(*group).sortWithinPartitions(*group).mapInArrow(_search(k, blocks), "fp_a bigint, fp_b bigint, distance int")


def nearest(fingerprints: DataFrame, k: int = 3, blocks: int | None = None) -> DataFrame:
    """(fp, nearest, distance) of every fingerprint that has another within k bits; ties go to the smaller."""
    pairs = near_pairs(fingerprints, k, blocks)
    ways = F.array(F.struct(F.col("fp_a").alias("fp"), F.col("fp_b").alias("other")), F.struct(F.col("fp_b").alias("fp"), F.col("fp_a").alias("other")))
    both = pairs.select(F.explode(ways).alias("way"), "distance").select("way.*", "distance")  # a union would search twice
    return both.groupBy("fp").agg(F.min(F.struct("distance", "other")).alias("m")).select("fp", F.col("m.other").alias("nearest"), F.col("m.distance").alias("distance"))


def lane_candidates(queries: DataFrame, index: DataFrame, k: int = 3) -> DataFrame:
    """Distinct (fp, candidate) that share at least one lane, without the fingerprint itself."""
    lanes = lambda: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), lane(F.col("fp"), i, k).alias("v")) for i in range(k + 1)])).alias("lane")
    a = queries.select("fp").distinct().select("fp", lanes())
    b = index.select("fp").distinct().select(F.col("fp"), lanes()).withColumnRenamed("fp", "candidate")
    return a.join(b, "lane").where(F.col("fp") != F.col("candidate")).select("fp", "candidate").distinct()
