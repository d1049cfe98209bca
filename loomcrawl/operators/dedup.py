"""Seen-set checks, Bloom filters and their figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcrawl.functions.hashing import bloom_slots


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The least order of each key; an aggregate with map-side combine, not a window."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("first")).select(key, *[F.col(f"first.{c}") for c in order])


def dedup_verdicts(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """NEW for the first row of a key, DUPLICATE for the others. ``order`` names a row."""
    firsts = first_by_key(rows, key, order).select(*order, F.lit("NEW").alias("verdict"))
    valid = rows.where(F.col(key).isNotNull())
    return valid.join(firsts, order, "left").select(*order, key, F.coalesce("verdict", F.lit("DUPLICATE")).alias("verdict"))


def net_new(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are not in ``seen``."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(seen.select(key), key, "left_anti")


def probe(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Each distinct key with DUPLICATE when it is in ``seen``, else NEW."""
    known = seen.select(key).distinct().withColumn("known", F.lit(True))
    found = rows.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left")
    return found.select(key, F.when(F.col("known"), "DUPLICATE").otherwise("NEW").alias("verdict"))


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """F32: bits and number of hashes."""
    bits = max(8, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / n * math.log(2)))


def bloom_fpr(adds: Column, bits: int, k: int) -> Column:
    """F33."""
    return F.pow(1 - F.exp(-F.lit(float(k)) * adds / F.lit(float(bits))), F.lit(float(k)))


def bloom_bits(keys: DataFrame, key: str, bits: int, k: int) -> DataFrame:
    """A2: (bit) for every set bit. Distributed: at most ``bits`` rows, whatever the number of keys."""
    return keys.select(key).distinct().select(F.explode(bloom_slots(F.col(key), bits, k)).alias("bit")).distinct()


def bloom_probe(keys: DataFrame, filter_bits: DataFrame, key: str, bits: int, k: int) -> DataFrame:
    """A3: (key, might_contain): whether all k bits are set."""
    hashed = keys.select(key).distinct().select(key, F.explode(bloom_slots(F.col(key), bits, k)).alias("bit"))
    met = hashed.join(filter_bits.withColumn("set", F.lit(1)), "bit", "left")
    return met.groupBy(key).agg(F.min(F.coalesce("set", F.lit(0))).alias("all_set")).select(key, (F.col("all_set") == 1).alias("might_contain"))


def dedup_stats(verdicts: DataFrame) -> DataFrame:
    """Counters of the verdicts in one row."""
    new = F.count(F.when(F.col("verdict") == "NEW", 1))
    n = F.count("*")
    return verdicts.agg(n.alias("n_queries"), new.alias("n_new"), (n - new).alias("n_duplicate"), F.when(n == 0, 0.0).otherwise(F.round((n - new) / n, 6)).alias("duplicate_rate"))
