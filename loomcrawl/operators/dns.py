"""The resolver's cache as a table.

A cache row is (host, family, kind, ips, error, expires_ms); kind is HIT or MISS. One call
answers the lookups of a micro-batch: fresh rows answer at once, of the other lookups
the first of each (host, family) goes upstream and the rest wait for its answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcrawl.operators.metrics import MINUTE_MS, clamp_negative, clamp_positive

CACHE = "host string, family string, kind string, ips array<string>, error string, expires_ms bigint"
FAMILIES = ("IPV4", "IPV6")
#: Upstream lookups of one host that may run at a time.
PERMITS = 4


def fresh(expires_ms: Column, now_ms: Column) -> Column:
    """An answer lasts until before its expiry."""
    return expires_ms > now_ms


def lookup_verdicts(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """Lookups (seq, host, family, now_ms) with verdict POSITIVE_HIT, NEGATIVE_HIT, UPSTREAM or COALESCED.

    A fresh positive row wins over a negative one. The first lookup of a key is found by an
    aggregate with map-side combine, so a host that everybody asks for is one row a task.
    """
    kept = cache.groupBy("host", "family").agg(*[F.max(F.when(F.col("kind") == k, F.col("expires_ms"))).alias(k) for k in ("HIT", "MISS")])
    known = lookups.select("seq", "host", "family", "now_ms").join(kept, ["host", "family"], "left")
    hit = F.when(fresh(F.col("HIT"), F.col("now_ms")), "POSITIVE_HIT").when(fresh(F.col("MISS"), F.col("now_ms")), "NEGATIVE_HIT")
    judged = known.select("seq", "host", "family", "now_ms", hit.alias("hit"))
    first = judged.where(F.col("hit").isNull()).groupBy("host", "family").agg(F.min("seq").alias("seq")).select("host", "family", "seq", F.lit("UPSTREAM").alias("up"))
    return judged.join(first, ["host", "family", "seq"], "left").select("seq", "host", "family", "now_ms", F.coalesce("hit", "up", F.lit("COALESCED")).alias("verdict"))


def permit_waves(verdicts: DataFrame, permits: int = PERMITS) -> DataFrame:
    """(host, family, wave) of the upstream lookups; at most ``permits`` of a host are in one wave."""
    w = Window.partitionBy("host").orderBy("seq")
    return verdicts.where(F.col("verdict") == "UPSTREAM").select("host", "family", F.floor((F.row_number().over(w) - 1) / permits).cast("int").alias("wave"))


def refreshed(cache: DataFrame, verdicts: DataFrame, upstream: DataFrame) -> DataFrame:
    """The cache after the upstream answers (host, family, ips, error, expires_ms).

    Expiry is clamped; a lookup without an answer is a miss TIMEOUT for five minutes. A new
    answer replaces the old rows of its kind; rows that the lookups found expired go.
    """
    asked = verdicts.where(F.col("verdict") == "UPSTREAM").select("host", "family", "now_ms")
    now = F.col("now_ms")
    got = asked.join(upstream.select("host", "family", "ips", "error", "expires_ms"), ["host", "family"], "left")
    good = F.col("ips").isNotNull()
    expires = F.when(good, clamp_positive(now, F.col("expires_ms"))).when(F.col("error").isNull(), now + 5 * MINUTE_MS).otherwise(clamp_negative(now, F.col("expires_ms")))
    made = got.select("host", "family", F.when(good, "HIT").otherwise("MISS").alias("kind"), "ips", F.when(~good, F.coalesce("error", F.lit("TIMEOUT"))).alias("error"), expires.alias("expires_ms"))
    return cache.join(asked.select("host", "family"), ["host", "family"], "left_anti").select(made.columns).unionByName(made)


def invalidate(cache: DataFrame, hosts: DataFrame) -> DataFrame:
    """M5, U4: the cache without both families of ``hosts``; the reverse index is derived from what is left."""
    return cache.join(hosts.select("host").distinct(), "host", "left_anti")


def hosts_sharing(cache: DataFrame) -> DataFrame:
    """A10: (ip, host) of all positive rows."""
    return cache.where(F.col("kind") == "HIT").select(F.explode("ips").alias("ip"), "host").distinct()


def stats(verdicts: DataFrame, cache: DataFrame, timeouts: int | Column = 0) -> DataFrame:
    """The resolver's counters in one row, with the ratios of hits and of coalesced lookups."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    counted = verdicts.agg(F.count("*").alias("n_lookups"), n("POSITIVE_HIT").alias("n_positive"), n("NEGATIVE_HIT").alias("n_negative"), n("COALESCED").alias("n_coalesced"), n("UPSTREAM").alias("n_upstream"))
    sizes = cache.agg(F.count(F.when(F.col("kind") == "HIT", 1)).alias("n_cached_hits"), F.count(F.when(F.col("kind") == "MISS", 1)).alias("n_cached_misses"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 9))
    both = F.col("n_upstream") + F.col("n_coalesced")
    return counted.join(sizes).select("*", ratio(F.col("n_positive") + F.col("n_negative"), F.col("n_lookups")).alias("hit_ratio"), ratio(F.col("n_coalesced"), both).alias("saved_ratio"))  # one row each
