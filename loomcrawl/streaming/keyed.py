"""Streaming forms of keyed operators.

Each takes a streaming (or plain) DataFrame. State lives in the session's state store;
a bounded delay lets it expire.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomcrawl.operators.folds import DELAY_MS, MAX_BACKOFF, MIN_BACKOFF, ON_ERROR, ON_SUCCESS
from loomcrawl.session import fresh_path

GRANTS = "host string, seq bigint, granted boolean, wait_ms bigint"
CLAIMS = "host string, url string, claimed_ms bigint, delay_ms bigint"
CLAIM_STATE = "next_ms bigint, backoff double, urls array<string>"
_BAD = frozenset(["SERVER_ERROR_5XX", "RATE_LIMITED_429", "NETWORK_ERROR", "TIMEOUT"])
_GOOD = frozenset(["SUCCESS_200", "NOT_MODIFIED_304"])


def new_urls(stream: DataFrame, key: str = "url", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once. With an event time and a delay the state expires, else it grows with the keys."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def politeness_stream(stream: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """Verdict on every claim (host, at_ms, seq), the host's clock being the state."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = state.get[0] if state.exists else None
        rows = []
        for at, seq in sorted(x for f in frames for x in zip(f["at_ms"], f["seq"])):
            granted = clock is None or clock <= at
            rows.append((key[0], seq, granted, 0 if granted else clock - at))
            clock = at + delay_ms if granted else clock
        state.update((int(clock),))
        yield pd.DataFrame(rows, columns=["host", "seq", "granted", "wait_ms"])

    return stream.select("host", "at_ms", "seq").groupBy("host").applyInPandasWithState(run, GRANTS, "clock bigint", "append", GroupStateTimeout.NoTimeout)


def frontier_stream(stream: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """A host's queue and politeness state, driven by events.

    Events (host, at_ms, seq, kind, url, outcome): ``enqueue`` adds a url, ``claim`` asks
    for the next one at that time, ``verdict`` reports an outcome. A claim gives a row
    when the host has a url and its time has come. An idle host becomes eligible when a
    url is added; a host that waits keeps its time.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_ms, backoff, urls = state.get if state.exists else (0, MIN_BACKOFF, [])
        urls, out = list(urls), []
        events = sorted((x for f in frames for x in zip(f["at_ms"], f["seq"], f["kind"], f["url"], f["outcome"])), key=lambda x: x[:2])
        for at, _, kind, url, outcome in events:
            if kind == "enqueue":
                if not urls:
                    next_ms = max(next_ms, at)
                urls.append(url)
            elif kind == "claim" and urls and next_ms <= at:
                delay = int(delay_ms * backoff)
                out.append((key[0], urls.pop(0), at, delay))
                next_ms = at + delay
            elif kind == "verdict":
                if outcome in _BAD:
                    backoff = min(MAX_BACKOFF, backoff * ON_ERROR)
                elif outcome in _GOOD:
                    backoff = max(MIN_BACKOFF, backoff * ON_SUCCESS)
                next_ms = at + int(delay_ms * backoff)
        state.update((int(next_ms), float(backoff), urls))
        yield pd.DataFrame(out, columns=["host", "url", "claimed_ms", "delay_ms"])

    events = stream.select("host", "at_ms", "seq", "kind", "url", "outcome")
    return events.groupBy("host").applyInPandasWithState(run, CLAIMS, CLAIM_STATE, "append", GroupStateTimeout.NoTimeout)


def forward_stream(stream: DataFrame, size: int = 100, age_ms: int = 50) -> DataFrame:
    """Batches (target, batch_no, urls) of up to ``size`` urls, or of all that wait once the oldest is ``age_ms`` old.

    Rows are (target, at_ms, seq, url). What is not due stays in the state, and goes out
    with a later row or, at the latest, with a row of NULL url that only tells the time.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, times, urls = state.get if state.exists else (0, [], [])
        times, urls, out = list(times), list(urls), []
        for at, _, url in sorted(((x for f in frames for x in zip(f["at_ms"], f["seq"], f["url"]))), key=lambda x: x[:2]):
            if times and at - times[0] >= age_ms:
                out.append((key[0], number, urls))
                number, times, urls = number + 1, [], []
            if url is not None:
                times.append(int(at))
                urls.append(url)
            if len(urls) >= size:
                out.append((key[0], number, urls))
                number, times, urls = number + 1, [], []
        state.update((int(number), times, urls))
        yield pd.DataFrame(out, columns=["target", "batch_no", "urls"])

    rows = stream.select("target", "at_ms", "seq", "url")
    return rows.groupBy("target").applyInPandasWithState(run, "target string, batch_no bigint, urls array<string>", "number bigint, times array<bigint>, urls array<string>", "append", GroupStateTimeout.NoTimeout)


def deliver_with_retries(send: Callable[[DataFrame, int], DataFrame], dead_letters: Callable[[DataFrame], None], retries: int = 3) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that sends a micro-batch and retries what failed.

    ``send(batch, attempt)`` gives the rows that failed; after ``retries`` more attempts
    they go to ``dead_letters``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        left = batch
        for attempt in range(retries + 1):
            left = send(left, attempt)
            if left.isEmpty():
                return
        dead_letters(left)

    return each


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run what there is to an in-memory table and read it; for tests and small streams."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run what there is to a committed file sink in the shared folder and read it."""
    spark = stream.sparkSession
    out, log = fresh_path(spark, name), fresh_path(spark, f"{name}-log")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def arrivals_per_stream(events: DataFrame) -> DataFrame:
    """Published events per stream."""
    return events.groupBy("stream").agg(F.count("*").alias("n_published"))
