"""A lossy, slow network as a table of messages.

Loss and delay come from a hash of the seed and the message, so a run is the same at
every parallelism and after every retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / float(1 << 30)


def send(messages: DataFrame, key: str, seed: int, loss: float, least_ms: int, most_ms: int) -> DataFrame:
    """Add deliver_at_ms to messages (key, sent_at_ms), NULL when the message is lost."""
    delay = F.floor(chance(seed + 1, F.col(key)) * (most_ms - least_ms + 1)) + least_ms
    return messages.withColumn("deliver_at_ms", F.when(chance(seed, F.col(key)) >= loss, F.col("sent_at_ms") + delay))


def delivered(network: DataFrame, now_ms: int, since_ms: int | None = None) -> DataFrame:
    """Messages that arrive up to ``now_ms``, after ``since_ms`` where given."""
    due = network.where(F.col("deliver_at_ms") <= now_ms)
    return due if since_ms is None else due.where(F.col("deliver_at_ms") > since_ms)


def traffic(network: DataFrame, now_ms: int) -> DataFrame:
    """One row: messages sent, delivered, under way and lost."""
    at = F.col("deliver_at_ms")
    return network.agg(F.count("*").alias("n_sent"), F.count(F.when(at <= now_ms, 1)).alias("n_delivered"), F.count(F.when(at > now_ms, 1)).alias("n_under_way"), F.count(F.when(at.isNull(), 1)).alias("n_lost"))
