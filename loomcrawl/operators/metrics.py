"""Counters, timers, DNS cache figures and control events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcrawl.functions.codec import metric_name

LAST = 1024
MINUTE_MS = 60_000


def last_rows(samples: DataFrame, key: str, order: list[str], n: int = LAST) -> DataFrame:
    """The newest n rows of each key. ``row_number() <= n`` prunes each task's rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return samples.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def at_index(values: Column, p: float) -> Column:
    """Element ``floor(n * p)`` of a sorted array, the last one at most."""
    n = F.size(values)
    return F.element_at(values, (F.least(F.floor(n * F.lit(p)), n - 1) + 1).cast("int"))


def timer_percentiles(samples: DataFrame, key: str, value: str, order: list[str], n: int = LAST) -> DataFrame:
    """p50 and p99 over the newest n samples of a key, and the count of all."""
    kept = last_rows(samples, key, order, n).groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("__v"))  # at most n values a key
    total = samples.groupBy(key).agg(F.count("*").alias("n_samples"))
    return kept.join(total, key).select(key, "n_samples", at_index(F.col("__v"), 0.5).alias("p50"), at_index(F.col("__v"), 0.99).alias("p99"), F.element_at("__v", -1).alias("max"))


def prometheus(counters: DataFrame) -> DataFrame:
    """Text lines of counters (name, value)."""
    name = metric_name(F.col("name"))
    return counters.select("name", F.concat(F.lit("# TYPE "), name, F.lit(" counter\n"), name, F.lit(" "), F.col("value").cast("string"), F.lit("\n")).alias("text"))


def gauges(samples: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(name, value): the newest value of each gauge."""
    return samples.groupBy(F.col(key).alias("name")).agg(F.max_by(value, F.struct(*order)).alias("value"))


def prometheus_gauges(values: DataFrame) -> DataFrame:
    """Text lines of gauges (name, value)."""
    name = metric_name(F.col("name"))
    return values.select("name", F.concat(F.lit("# TYPE "), name, F.lit(" gauge\n"), name, F.lit(" "), F.col("value").cast("double").cast("string"), F.lit("\n")).alias("text"))


def prometheus_timers(timers: DataFrame) -> DataFrame:
    """Text lines of timers (name, n_samples, p50, p99), nanoseconds in and seconds out."""
    base = F.concat(metric_name(F.col("name")), F.lit("_seconds"))
    seconds = lambda c: (F.col(c).cast("double") / 1e9).cast("string")
    return timers.select(
        "name",
        F.concat(
            F.lit("# TYPE "), base, F.lit(" summary\n"), base, F.lit('{quantile="0.5"} '), seconds("p50"), F.lit("\n"), base, F.lit('{quantile="0.99"} '), seconds("p99"), F.lit("\n"),
            base, F.lit("_count "), F.col("n_samples").cast("string"), F.lit("\n"),
        ).alias("text"),
    )


def metric(values: DataFrame, name: str) -> DataFrame:
    """One metric's rows."""
    return values.where(F.col("name") == name)


def bench_results(samples: DataFrame, key: str, nanos: str, failed: str, wall_ms: Column) -> DataFrame:
    """Per benchmark operations, errors, wall time, throughput and the latencies at ``floor(n * p)``.

    Ranks come from counts per distinct latency, so no benchmark's samples are collected.
    """
    total = samples.groupBy(key).agg(F.count("*").alias("n_ops"), F.count(F.when(F.col(failed), 1)).alias("n_errors"), wall_ms.cast("bigint").alias("wall_ms"), F.max(nanos).alias("max_ns"))
    per_value = samples.groupBy(key, nanos).agg(F.count("*").alias("n"))
    upto = per_value.withColumn("upto", F.sum("n").over(Window.partitionBy(key).orderBy(nanos))).join(total.select(key, "n_ops"), key)
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n_ops") * F.lit(p)), F.col(nanos)))
    ranks = upto.groupBy(key).agg(at(0.5).alias("p50_ns"), at(0.99).alias("p99_ns"))
    return total.join(ranks, key).withColumn("per_second", F.col("n_ops") / F.greatest(F.lit(0.001), F.col("wall_ms") / 1000.0))


def bench_summary(results: DataFrame, key: str) -> DataFrame:
    """one line per benchmark."""
    micros = lambda c: F.floor(F.col(c) / 1000)
    line = F.format_string("%s: %d ops in %d ms → %.0f ops/s | p50=%dµs p99=%dµs max=%dµs | %d errors", F.col(key), "n_ops", "wall_ms", "per_second", micros("p50_ns"), micros("p99_ns"), micros("max_ns"), "n_errors")
    return results.select(key, line.alias("summary"))


def clamp_positive(now_ms: Column, expires_ms: Column) -> Column:
    """expiry of an answer, between a minute and an hour from now."""
    return F.least(F.greatest(expires_ms, now_ms + MINUTE_MS), now_ms + 60 * MINUTE_MS)


def clamp_negative(now_ms: Column, expires_ms: Column) -> Column:
    return F.least(expires_ms, now_ms + 5 * MINUTE_MS)


def hosts_by_address(answers: DataFrame) -> DataFrame:
    """A10, U4: (ip, host) of every distinct pair; kept as rows, so a shared address has no size limit."""
    return answers.select(F.explode("ips").alias("ip"), "host").distinct()


def latest_action(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest action of each key."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by("action", F.struct(*order)).alias("action"))
