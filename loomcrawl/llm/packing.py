"""Filling fixed-capacity containers with items (problem 8).

Only the length histogram, bounded by the capacity, comes to the driver. There the
configuration linear program is solved by multiplicative weights: every round prices
the lengths, a knapsack dynamic program finds the best filled container at those
prices, and weights of lengths it covers fall. Now and then all lengths are priced: the
prices are then a dual solution and give a lower bound. Full containers of the
fractional plan are rounded, what is left is placed best-fit by length, and the program
is solved again for what is left as long as that closes the gap to the bound. Plain best
fit is the start, so the result never has more containers than that. The plan is a list
of (pattern, number of containers); documents find their container from their rank
among items of equal size, without any of them passing through the driver.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcrawl.llm.tokens import RANKS, token_count
from loomcrawl.session import materialize

CAPACITY = 2048
#: Most size classes of a container: beyond, an item counts as its length rounded up to a class.
CLASSES = 4096
ETA = 0.5
#: Lengths that are priced in a round, half of them those covered least; all every ``CHECK`` rounds.
COLUMNS = 48
CHECK = 100
#: Exponents of the length in its price: a little over 1 packs long items first and keeps
#: short ones for the last containers.
TILTS = (1.02, 1.08, 1.2)
#: Gap to the lower bound at which the search ends.
GOAL = 0.0005


def best_pattern(price: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Bounded knapsack over sizes 1..capacity: the dearest filling with at most ``most[size]`` copies.

    Copies of a size enter as bundles of 1, 2, 4, ... so each is one vectorised step over
    all rooms; ``taken`` remembers the choices for the walk back.
    """
    bundles = []
    for size in np.flatnonzero((price > 0) & (most > 0)):
        left, k = min(int(most[size]), capacity // int(size)), 1
        while left > 0:
            bundles.append((int(size), min(k, left)))
            left, k = left - k, 2 * k
    value = np.zeros(capacity + 1)
    taken = np.zeros((len(bundles), capacity + 1), bool)
    for i, (size, k) in enumerate(bundles):
        total = value[: capacity + 1 - size * k] + k * price[size]
        better = total > value[size * k :]
        taken[i, size * k :] = better
        value[size * k :][better] = total[better]
    pattern, room = Counter(), capacity
    for i in range(len(bundles) - 1, -1, -1):
        if taken[i, room]:
            size, k = bundles[i]
            pattern[size] += k
            room -= size * k
    return dict(pattern)


def solve_configuration_lp(counts: np.ndarray, capacity: int, tilt: float = 1.0, eta: float = ETA) -> tuple[dict[tuple, float], float]:
    """(fractional plan {pattern: containers}, lower bound) for ``counts[size]`` items of each size.

    Ends when the plan's containers hold the volume of all items. The bound is that of the
    best dual prices met: no plan has fewer containers than prices of all items over the
    price of the dearest container.
    """
    sizes = np.arange(len(counts))
    wanted = np.flatnonzero(counts > 0)
    plan: dict[tuple, float] = defaultdict(float)
    if not len(wanted):
        return plan, 0.0
    random = np.random.default_rng(len(wanted))  # the same plan for the same histogram
    base = np.zeros(len(counts))
    base[wanted] = (sizes[wanted] / capacity) ** tilt
    volume = float((counts * sizes).sum()) / capacity
    bound, filled, covered, rounds = volume, 0.0, np.zeros(len(counts)), 0
    while filled < volume:
        done = covered[wanted]
        price = np.zeros(len(counts))
        price[wanted] = base[wanted] * np.exp(-eta * (done - done.min()))
        whole = rounds % CHECK == 0
        if not whole:
            half = min(COLUMNS // 2, len(wanted) - 1)
            some = np.concatenate([wanted[np.argpartition(done, half)[: half + 1]], random.choice(wanted, min(len(wanted), COLUMNS // 2), replace=False)])
            kept = np.zeros(len(counts), bool)
            kept[some] = True
            price[~kept] = 0
        pattern = best_pattern(price, counts, capacity)
        if whole:
            bound = max(bound, float((counts * price).sum()) / sum(price[s] * n for s, n in pattern.items()))
        step = min(counts[s] / n for s, n in pattern.items())
        plan[tuple(sorted(pattern.items()))] += step
        for s, n in pattern.items():
            covered[s] += n * step / counts[s]
            filled += s * n * step / capacity
        rounds += 1
    return {p: x * volume / filled for p, x in plan.items()}, bound


@dataclass
class Packing:
    """Plan [(pattern, containers)], of which the first ``n_program`` come from the program."""

    plan: list[tuple[dict[int, int], int]]
    n_program: int
    n_best_fit: int
    bound: int

    @property
    def n_containers(self) -> int:
        return sum(n for _, n in self.plan)

    @property
    def gap(self) -> float:
        return self.n_containers / self.bound - 1 if self.bound else 0.0


def pack_histogram(counts: np.ndarray, capacity: int) -> Packing:
    """Whole plan that holds exactly ``counts[size]`` items of each size.

    For every tilt the program is solved, its full containers are rounded to whole ones as
    far as items last, and the rest is solved again. The best total counts, and of equal
    ones that with most containers from the program.
    """
    counts = counts.astype(np.int64)
    plain = best_fit(counts, capacity)
    n_plain = sum(n for _, n in plain)
    lower = float((counts * np.arange(len(counts))).sum()) / capacity
    best = (n_plain, 0, plain, 0)
    for tilt in TILTS:
        left, placed, n = counts.copy(), [], 0
        while left.any():
            fractional, bound = solve_configuration_lp(left.astype(float), capacity, tilt)
            if not n:
                lower = max(lower, bound)
            added = 0
            for pattern, x in sorted(fractional.items(), key=lambda t: (-t[1], t[0])):
                if sum(s * k for s, k in pattern) < capacity:
                    continue
                whole = min([max(1, int(x)), *(int(left[s]) // k for s, k in pattern)])
                if whole > 0:
                    placed.append((dict(pattern), whole))
                    added += whole
                    for s, k in pattern:
                        left[s] -= k * whole
            n += added
            if not added:
                break
            rest = best_fit(left, capacity)
            total = n + sum(k for _, k in rest)
            if (total, -n) < best[:2]:
                best = (total, -n, placed + rest, n)
            if total > best[0] or (total <= math.ceil(lower - 1e-6) * (1 + GOAL) and 2 * n > total):
                break
        if best[3] and best[0] <= math.ceil(lower - 1e-6) * (1 + GOAL):
            break
    return Packing(best[2], best[3], n_plain, math.ceil(lower - 1e-6))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit by falling size over a histogram; containers with equal contents move as one."""
    open_bins: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    for size in range(len(left) - 1, 0, -1):
        n = int(left[size])
        while n > 0:
            room = min((r for r, b in open_bins.items() if r >= size and b), default=None)
            if room is None:
                each = capacity // size
                if n >= each:
                    open_bins[capacity - each * size].append((((size, each),), n // each))
                    n %= each
                else:
                    open_bins[capacity - n * size].append((((size, n),), 1))
                    n = 0
                continue
            pattern, k = open_bins[room].pop()
            fill = min(room // size, max(1, n // k))
            take = min(k, n // fill)
            if take < k:
                open_bins[room].append((pattern, k - take))
            grown = Counter(dict(pattern))
            grown[size] += fill
            open_bins[room - fill * size].append((tuple(sorted(grown.items())), take))
            n -= fill * take
    return [(dict(p), k) for bins in open_bins.values() for p, k in bins]


def slot_table(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """(size, first, each, container): items of a size from rank ``first`` on go ``each`` to a container."""
    rows, first, container = [], Counter(), 0
    for pattern, n in plan:
        for size, each in sorted(pattern.items()):
            rows.append((size, first[size], each, container))
            first[size] += each * n
        container += n
    return pd.DataFrame(rows, columns=["size", "first", "each", "container"]).sort_values(["size", "first"], ignore_index=True)


def document_sizes(documents: DataFrame, tokenizer: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens); NULL and empty texts have 0."""
    return documents.select("doc_id", token_count(F.col("text"), tokenizer).alias("n_tokens"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """(doc_id, piece_no, n_tokens, container) for every item of (doc_id, n_tokens).

    An item is whole unless it alone exceeds the capacity; then it is cut into full pieces
    and a rest. Items of size 0 need no room and are put into container 0. Repeated rows
    are packed each for itself. No items give no rows. Items of one size are ranked in
    ``shards`` groups (by default the shuffle partitions), so a size that a third of all
    items have is not one task's work.
    """
    spark = sizes.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    unit = -(-capacity // CLASSES)
    room = capacity // unit
    n = F.col("n_tokens")
    pieces = F.greatest(F.ceil(n / capacity).cast("int"), F.lit(1))
    items = sizes.select("doc_id", n, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no"))
    items = items.select("doc_id", "piece_no", F.least(n - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    items = items.withColumn("size", F.least(F.ceil(F.col("n_tokens") / unit), F.lit(room)).cast("int"))
    items = materialize(items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int")), "pack-items")
    per_shard = items.groupBy("size", "shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_shard.select("size", "shard", before.alias("start"))

    counts = np.zeros(room + 1, np.int64)
    for row in items.groupBy("size").agg(F.count("*").alias("n")).collect():  # at most room + 1 rows
        counts[row["size"]] = row["n"]
    counts[0] = 0
    slots = slot_table(pack_histogram(counts, room).plan)
    key = slots["size"].to_numpy(np.int64) * 2**48 + slots["first"].to_numpy(np.int64)
    first, each, base = (slots[c].to_numpy(np.int64) for c in ("first", "each", "container"))

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        s, r = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        if not len(key):
            return pd.Series(np.zeros(len(s), np.int64))
        at = np.maximum(np.searchsorted(key, s * 2**48 + r, side="right") - 1, 0)
        return pd.Series(np.where(s == 0, 0, base[at] + (r - first[at]) // each[at]))

    within = F.row_number().over(Window.partitionBy("size", "shard").orderBy("doc_id", "piece_no"))
    ranked = items.withColumn("k", within).join(starts, ["size", "shard"])
    return ranked.select("doc_id", "piece_no", "n_tokens", container(F.col("size"), F.col("start") + F.col("k") - 1).alias("container"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible, the unused share, and
    how many containers come from the program and plain best fit would need."""
    sizes = packed.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    unit = -(-capacity // CLASSES)
    counts = np.zeros(capacity // unit + 1, np.int64)
    for row in sizes:
        counts[min(-(-row["n_tokens"] // unit), capacity // unit)] += row["n"]
    plan = pack_histogram(counts, capacity // unit)
    total = packed.agg(F.count_distinct(F.when(F.col("n_tokens") > 0, F.col("container"))).alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    room = F.col("n_containers") * capacity
    unused = F.when(room > 0, 1 - F.col("n_tokens") / room).otherwise(0.0)
    return total.select("n_containers", "n_tokens", F.lit(plan.bound).cast("bigint").alias("least"), unused.alias("unused"), F.lit(plan.n_program).cast("bigint").alias("n_from_program"), F.lit(plan.n_best_fit).cast("bigint").alias("n_best_fit"))
