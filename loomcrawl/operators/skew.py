"""Per-key results when a few keys hold most rows (problem 3).

Two-stage salted aggregation. A bounded sketch names the keys that may be heavy;
their rows get a salt, partial results are made per (key, salt), and the partials
are merged by the original key. Light keys keep salt 0, so the long tail pays
nothing. The salt is a hash of the row, not a random number: a task that is run
again after the loss of an executor gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcrawl.functions.url import canon_host
from loomcrawl.session import materialize

#: Heavy-key candidates kept by the sketch. Its size never grows with the data.
SKETCH_KEYS = 256
SKETCH_TRACKED = 4096
CLASSES = ("URGENT_RECRAWL", "HIGH_OPIC", "MEDIUM_OPIC", "BFS_DISCOVERY", "LOW_OPIC")


def heavy_keys(df: DataFrame, key: str, share: float) -> list:
    """Keys that may hold at least ``share`` of all rows, from a one-pass frequency sketch.

    The sketch is mergeable and holds at most ``SKETCH_TRACKED`` counters per task. A
    key it misses is only left unsalted; the results stay right either way.
    """
    row = df.select(F.expr(f"approx_top_k({key}, {SKETCH_KEYS}, {SKETCH_TRACKED})").alias("top"), F.count("*").alias("n")).first()
    if not row or not row["n"] or not row["top"]:
        return []
    return [x["item"] for x in row["top"] if x["item"] is not None and x["count"] >= share * row["n"]]


def salted_aggregate(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    salt_from: list[str],
    share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """Aggregate by ``key`` in two stages.

    ``partial`` names the aggregates of the first stage, ``merge`` gives for each the
    aggregate that joins its partial values. NULL keys form one group of their own,
    salted like a heavy one. Repeated rows each count; an empty table gives no row.
    Extra columns are ignored and cannot clash: internal names start with ``__``.
    """
    rows = df.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__in_{c}") for c in df.columns if c != key])
    heavy = heavy_keys(rows.select("__key"), "__key", share)
    spread = F.pmod(F.xxhash64(*[F.col(f"__in_{c}") for c in salt_from]), F.lit(salts)).cast("int")
    is_heavy = F.col("__key").isNull() | (F.col("__key").isin(heavy) if heavy else F.lit(False))
    salted = rows.withColumn("__salt", F.when(is_heavy, spread).otherwise(0))
    first = salted.groupBy("__key", "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy("__key").agg(*[merge[n](n).alias(n) for n in partial]).withColumnRenamed("__key", key)


def host_figures(entries: DataFrame, classes: tuple[str, ...] = CLASSES, salts: int = 32) -> DataFrame:
    """Queue figures of every host: rows, oldest discovery, rows per priority class.

    Hosts are compared in canonical spelling; entries without a valid host are one row
    with a NULL host. Entries are counted as they stand, repeated rows included. A
    priority class outside ``classes``, or none, counts as ``other_class``.
    """
    host = F.explode(F.array(canon_host(F.col("host_name"))))  # computed once, whatever reads it later
    slim = entries.select(host.alias("host"), "entry_id", "url", "priority_class", "discovered_at_epoch_ms")
    name = lambda c: f"n_{c.lower()}"
    known = F.col("__in_priority_class").isin(*classes)
    partial = {"n_rows": F.count("*"), "oldest_ms": F.min("__in_discovered_at_epoch_ms")}
    partial |= {name(c): F.count(F.when(F.col("__in_priority_class") == c, 1)) for c in classes}
    partial |= {"n_other_class": F.count(F.when(~F.coalesce(known, F.lit(False)), 1))}
    merge = {n: (F.min if n == "oldest_ms" else F.sum) for n in partial}
    return salted_aggregate(slim, "host", partial, merge, ["entry_id", "url"], salts=salts)


def with_policy(figures: DataFrame, policies: DataFrame) -> DataFrame:
    """Add the hot-host policy of each host, if any; the latest policy of a host wins."""
    order = F.struct(F.col("configured_at"), F.col("owning_agent"), F.col("split_factor"))
    latest = (
        policies.select(canon_host(F.col("host")).alias("host"), "owning_agent", "split_factor", "configured_at")
        .where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.max(order).alias("p"))
        .select("host", F.col("p.owning_agent").alias("policy_agent"), F.col("p.split_factor").alias("policy_split"))
    )
    return figures.join(latest, "host", "left")


def frequent_hosts(figures: DataFrame, percent: int = 2) -> DataFrame:
    """Hosts with at least ``percent`` of all rows, rows without a host in the total.

    The figures are written once and read for the total and for the hosts.
    """
    figures = materialize(figures.select("host", "n_rows"), "host-figures")
    total = figures.agg(F.sum("n_rows").alias("n")).scalar()
    return figures.where(F.col("host").isNotNull() & (F.col("n_rows") * 100 >= total * percent)).select("host")
