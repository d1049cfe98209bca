"""The frontier's host states as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcrawl.operators.folds import DELAY_MS, MIN_BACKOFF


def depths(entries: DataFrame) -> DataFrame:
    """M3: (host, depth): entries that wait in each host's queue."""
    return entries.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("depth"))


def host_states(entries: DataFrame, backoff: DataFrame, quarantined: DataFrame, delays: DataFrame | None = None) -> DataFrame:
    """(host, next_fetch_ms, crawl_delay_ms, backoff, errors, last_success_ms, depth, quarantined).

    Every host with waiting entries or a back-off state is a row; what is not known of it
    has its first value. ``delays`` (host, delay_ms) overrides the crawl delay, M1: only by
    a positive one.
    """
    known = depths(entries).join(backoff, "host", "full")
    held = quarantined.select("host").distinct().withColumn("held", F.lit(True))
    known = known.join(held, "host", "left")
    delay: Column = F.lit(DELAY_MS).cast("bigint")
    if delays is not None:
        least = delays.where(F.col("delay_ms") > 0).groupBy("host").agg(F.max("delay_ms").alias("own"))
        known = known.join(least, "host", "left")
        delay = F.coalesce("own", delay)
    return known.select(
        "host",
        F.coalesce("next_fetch_ms", F.lit(0)).cast("bigint").alias("next_fetch_ms"),
        delay.alias("crawl_delay_ms"),
        F.coalesce("backoff", F.lit(MIN_BACKOFF)).alias("backoff"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        "last_success_ms",
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("held", F.lit(False)).alias("quarantined"),
    )


def claimable(states: DataFrame, now_ms: int) -> DataFrame:
    """P5: hosts with waiting entries, not quarantined, whose time has come."""
    return states.where(~F.col("quarantined") & (F.col("depth") > 0) & (F.col("next_fetch_ms") <= now_ms))


def latest_generation(heap: DataFrame) -> DataFrame:
    """Of the heap rows (host, generation, next_ms) the newest of each host; older ones are void."""
    return heap.groupBy("host").agg(F.max("generation").alias("generation"), F.max_by("next_ms", "generation").alias("next_ms"))


def set_quarantine(states: DataFrame, hosts: DataFrame, on: bool) -> DataFrame:
    """M2: the states with the flag of ``hosts`` set or taken away."""
    named = hosts.select("host").distinct().withColumn("__named", F.lit(True))
    return states.join(named, "host", "left").withColumn("quarantined", F.when(F.col("__named"), F.lit(on)).otherwise(F.col("quarantined"))).drop("__named")


def change_depth(states: DataFrame, changes: DataFrame) -> DataFrame:
    """M2: depths after ``changes`` (host, change), never below zero."""
    total = changes.groupBy("host").agg(F.sum("change").alias("__change"))
    return states.join(total, "host", "left").withColumn("depth", F.greatest(F.col("depth") + F.coalesce("__change", F.lit(0)), F.lit(0)).cast("bigint")).drop("__change")
