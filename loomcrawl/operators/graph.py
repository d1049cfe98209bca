"""Link graph and importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcrawl.session import materialize


def opic_round(state: DataFrame, visits: DataFrame, edges: DataFrame, seed_cash: float = 1.0) -> DataFrame:
    """One round of visits at once, as (url, cash, history).

    Every visited url banks its cash as history and shares it equally among its
    outlinks, repeated ones counted. A visited url that is not in ``state`` starts with
    ``seed_cash``, a target that is not starts with none. Equal to visiting one after
    another unless a visited page links to a page visited later in the same round.
    """
    visited = visits.select("url").where(F.col("url").isNotNull()).distinct().withColumn("visited", F.lit(True))
    base = state.select("url", "cash", "history").join(visited, "url", "full")
    base = base.select(
        "url",
        F.coalesce("visited", F.lit(False)).alias("visited"),
        F.coalesce("cash", F.when(F.col("visited"), F.lit(seed_cash)).otherwise(0.0)).alias("cash"),
        F.coalesce("history", F.lit(0.0)).alias("history"),
    )
    # One row per (source, target), written once: degree and gains read 8-byte counts, not links.
    pairs = edges.where(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy("source", "target").agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "opic-pairs")
    degree = pairs.groupBy("source").agg(F.sum("n").alias("degree"))
    spent = base.where("visited").select(F.col("url").alias("source"), "cash").join(degree, "source").select("source", (F.col("cash") / F.col("degree")).alias("share"))
    gains = pairs.join(spent, "source").groupBy(F.col("target").alias("url")).agg(F.sum(F.col("share") * F.col("n")).alias("gain"))
    merged = base.join(gains, "url", "full")
    kept = F.when(F.coalesce("visited", F.lit(False)), 0.0).otherwise(F.coalesce("cash", F.lit(0.0)))
    banked = F.coalesce("history", F.lit(0.0)) + F.when(F.coalesce("visited", F.lit(False)), F.col("cash")).otherwise(0.0)
    return merged.select("url", (kept + F.coalesce("gain", F.lit(0.0))).alias("cash"), banked.alias("history"))


def seed(state: DataFrame, urls: DataFrame, cash: float = 1.0) -> DataFrame:
    """The state with every url that it has not yet, at ``cash``."""
    new = urls.select("url").where(F.col("url").isNotNull()).distinct().join(state.select("url"), "url", "left_anti")
    return state.select("url", "cash", "history").unionByName(new.select("url", F.lit(cash).alias("cash"), F.lit(0.0).alias("history")))


def top_by_history(state: DataFrame, n: int) -> DataFrame:
    """T1."""
    return state.orderBy(F.desc("history"), F.desc("cash"), "url").limit(n)


def frontier_positions(entries: DataFrame, order: list[str]) -> DataFrame:
    """Place of every entry in its host's queue and when it can be claimed first.

    Positions come from counts per (host, slice) and a rank within the slice, so a host
    with a third of all entries is not ranked by one task. ``order`` must end in a key.
    """
    slices = entries.where(F.col("host").isNotNull()).withColumn("__slice", F.floor(F.col(order[0]) / 3_600_000))
    counts = slices.groupBy("host", "__slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("host", "__slice", before.alias("__start"))
    rank = F.row_number().over(Window.partitionBy("host", "__slice").orderBy(*order))
    return slices.withColumn("__k", rank).join(starts, ["host", "__slice"]).withColumn("position", (F.col("__start") + F.col("__k")).cast("bigint")).drop("__k", "__start", "__slice")


def claim_order(entries: DataFrame, order: list[str], limit: int, delay_ms: int = 1000) -> DataFrame:
    """T4: the first ``limit`` claims of all hosts, by eligible time and host."""
    placed = frontier_positions(entries, order).where(F.col("position") <= limit)
    due = (F.col("position") - 1) * delay_ms
    return placed.select("host", "entry_id", due.cast("bigint").alias("due_ms")).orderBy("due_ms", "host", "entry_id").limit(limit)


def frontier_stats(entries: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """Totals per priority class and number of hosts, in one row."""
    per_class = [F.count(F.when(F.col("priority_class") == c, 1)).alias(f"n_{c.lower()}") for c in classes]
    return entries.agg(F.count("*").alias("n_entries"), F.count_distinct("host").alias("n_hosts"), F.min("discovered_at_epoch_ms").alias("oldest_ms"), *per_class)


def batches(rows: DataFrame, target: str, order: str, size: int = 100) -> DataFrame:
    """Batch number and place of each row of a target; ``order`` is a unique bigint.

    The rank is made of two stages like in :func:`frontier_positions`.
    """
    wide = rows.where(F.col(target).isNotNull()).withColumn("__slice", F.floor(F.col(order) / 4096))
    counts = wide.groupBy(target, "__slice").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(target).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(target, "__slice", before.alias("__start"))
    k = F.row_number().over(Window.partitionBy(target, "__slice").orderBy(order)) - 1
    placed = wide.withColumn("__k", k).join(starts, [target, "__slice"]).withColumn("__at", F.col("__start") + F.col("__k"))
    return placed.withColumn("batch_no", F.floor(F.col("__at") / size).cast("bigint")).withColumn("place", (F.col("__at") % size).cast("bigint")).drop("__slice", "__start", "__k", "__at")
