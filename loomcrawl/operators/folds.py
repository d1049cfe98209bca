"""Folds over the ordered rows of a key.

``stream_fold`` hash-partitions by key, sorts within partitions (Spark spills), and
streams through the rows with the state of one key at a time, so a key may have any
number of rows. Where steps compose, as in the back-off of a host, rows are
range-partitioned by key and time instead, so that even one key is split over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcrawl.functions.codec import is_backoff, is_success

MIN_BACKOFF, MAX_BACKOFF, ON_ERROR, ON_SUCCESS = 1.0, 64.0, 2.0, 0.95
DELAY_MS = 1000
MIN_INTERVAL_MS, MAX_INTERVAL_MS, FIRST_INTERVAL_MS = 900_000, 2_592_000_000, 3_600_000
DAY_MS = 86_400_000
#: Changes per day of a url that was never fetched.
FIRST_RATE = 1.0


def stream_fold(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable, finish: Callable | None = None) -> DataFrame:
    """Fold the rows of each key in order.

    ``step(state, row)`` gives (state, output row or None); ``finish(key, state)`` gives
    a last row or None. Rows come as tuples in the order of ``df``'s columns. Rows
    with a NULL key are left out.
    """
    columns = df.columns
    at = columns.index(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, out = None, None, []
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if current is None or row[at] != current:
                    if current is not None and finish and (last := finish(current, state)) is not None:
                        out.append(last)
                    current, state = row[at], start()
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=fields)
                out = []
        if current is not None and finish and (last := finish(current, state)) is not None:
            out.append(last)
        if out:
            yield pd.DataFrame(out, columns=fields)

    fields = [x.strip().split(" ")[0] for x in schema.split(",")]
    return df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def host_backoff(fetches: DataFrame) -> DataFrame:
    """Back-off state of every host after all its fetches.

    ``fetches``: host, at_ms, seq, outcome. A step scales the factor and clamps it; such
    steps compose to one scale and clamp, so each task folds its slice of a host and the
    slices are joined in order. (host, backoff, errors, last_success_ms, next_fetch_ms)
    """
    flags = fetches.where(F.col("host").isNotNull()).select("host", "at_ms", "seq", is_backoff(F.col("outcome")).alias("bad"), is_success(F.col("outcome")).alias("good"))

    def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s = None, None
        for frame in frames:
            out = []
            for host, at, _, bad, good in frame.itertuples(index=False, name=None):
                if host != current:
                    if s is not None:
                        out.append(tuple(s))
                    # host, first time, scale, low, high, errors since the last success, any success, last success, last time
                    current, s = host, [host, at, 1.0, 0.0, float("inf"), 0, False, None, at]
                if bad:
                    s[2], s[3], s[4] = s[2] * ON_ERROR, min(MAX_BACKOFF, s[3] * ON_ERROR), min(MAX_BACKOFF, s[4] * ON_ERROR)
                    s[5] += 1
                elif good:
                    s[2], s[3], s[4] = s[2] * ON_SUCCESS, max(MIN_BACKOFF, s[3] * ON_SUCCESS), max(MIN_BACKOFF, s[4] * ON_SUCCESS)
                    s[5], s[6], s[7] = 0, True, at
                s[8] = at
            if out:
                yield pd.DataFrame(out, columns=names)
        if s is not None:
            yield pd.DataFrame([tuple(s)], columns=names)

    names = ["host", "first_ms", "scale", "low", "high", "errors", "reset", "success_ms", "last_ms"]
    made = (
        flags.repartitionByRange("host", "at_ms", "seq")
        .sortWithinPartitions("host", "at_ms", "seq")
        .mapInPandas(slices, "host string, first_ms bigint, scale double, low double, high double, errors int, reset boolean, success_ms bigint, last_ms bigint")
    )
    parts = F.array_sort(F.collect_list(F.struct("first_ms", "last_ms", "scale", "low", "high", "errors", "reset", "success_ms")))  # at most one per task
    start = F.struct(F.lit(MIN_BACKOFF).alias("x"), F.lit(0).alias("errors"), F.lit(None).cast("bigint").alias("success_ms"), F.lit(None).cast("bigint").alias("last_ms"))

    def join(a, p):
        x = F.least(F.greatest(a["x"] * p["scale"], p["low"]), p["high"])
        errors = F.when(p["reset"], p["errors"]).otherwise(a["errors"] + p["errors"])
        return F.struct(x.alias("x"), errors.alias("errors"), F.coalesce(p["success_ms"], a["success_ms"]).alias("success_ms"), p["last_ms"].alias("last_ms"))

    state = made.groupBy("host").agg(F.aggregate(parts, start, join).alias("s"))
    delay = (F.lit(DELAY_MS * 1_000_000) * F.col("s.x")).cast("bigint")
    return state.select("host", F.col("s.x").alias("backoff"), F.col("s.errors").alias("errors"), F.col("s.success_ms").alias("last_success_ms"), (F.col("s.last_ms") + F.floor(delay / 1_000_000)).cast("bigint").alias("next_fetch_ms"))


def recrawl_state(fetches: DataFrame) -> DataFrame:
    """Recrawl state of every url after its fetches (url, at_ms, seq, changed).

    A change halves the interval, no change doubles it, within fixed bounds; the rate is
    smoothed from changes per day since the last change.
    """
    schema = "url string, interval_ms bigint, rate double, n_fetches int, n_changes int, n_unchanged int, last_changed_ms bigint, next_ms bigint"

    def step(s, row):
        _, at, _, changed = row
        if s is None:
            s = [FIRST_INTERVAL_MS, FIRST_RATE, 0, 0, 0, at, at]
        s[2] += 1
        if changed:
            s[3], s[4], s[5] = s[3] + 1, 0, at
            s[0] = max(MIN_INTERVAL_MS, s[0] // 2)
        else:
            s[4] += 1
            s[0] = min(MAX_INTERVAL_MS, s[0] * 2)
        s[1] = 0.7 * s[1] + 0.3 * (s[3] / max(1.0, abs(at - s[5]) / DAY_MS))
        s[6] = at + s[0]
        return s, None

    return stream_fold(fetches.select("url", "at_ms", "seq", "changed"), "url", ["at_ms", "seq"], schema, lambda: None, step, lambda url, s: (url, *s))


def register_recrawls(state: DataFrame, urls: DataFrame, now_ms: int) -> DataFrame:
    """M7: the state with a first entry for every url that has none; others stay."""
    new = urls.select("url").where(F.col("url").isNotNull()).distinct().join(state.select("url"), "url", "left_anti")
    zero = F.lit(0)
    made = new.select("url", F.lit(FIRST_INTERVAL_MS).cast("bigint").alias("interval_ms"), F.lit(FIRST_RATE).alias("rate"), zero.alias("n_fetches"), zero.alias("n_changes"), zero.alias("n_unchanged"), F.lit(now_ms).cast("bigint").alias("last_changed_ms"), F.lit(now_ms + FIRST_INTERVAL_MS).cast("bigint").alias("next_ms"))
    return state.select(made.columns).unionByName(made)


def clock_peek(grants: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """(host, clock_ms): the time before which a host grants no claim, from its grants (host, at_ms, granted)."""
    return grants.where("granted").groupBy("host").agg((F.max("at_ms") + delay_ms).cast("bigint").alias("clock_ms"))


def due_recrawls(state: DataFrame, importance: DataFrame, now_ms: int, limit: int) -> DataFrame:
    """Overdue urls by history times log1p(rate), the url breaking ties."""
    ranked = state.where(F.col("next_ms") <= now_ms).join(importance.select("url", "history"), "url", "left")
    score = F.log1p("rate") * F.coalesce("history", F.lit(0.0))
    return ranked.select("url", F.round(score, 9).alias("priority")).orderBy(F.desc("priority"), "url").limit(limit)


def politeness_grants(claims: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """Each claim (host, at_ms, seq) granted when the host's clock has passed, else its waiting time.

    One host's clock is sequential by nature; a task streams through its claims.
    """

    def step(clock, row):
        host, at, seq = row
        if clock is None or clock <= at:
            return at + delay_ms, (host, seq, True, 0)
        return clock, (host, seq, False, clock - at)

    return stream_fold(claims.select("host", "at_ms", "seq"), "host", ["at_ms", "seq"], "host string, seq bigint, granted boolean, wait_ms bigint", lambda: None, step)


def audit_chain(events: DataFrame) -> DataFrame:
    """Hash chain of every log (log, seq, digest), genesis of 64 zeros."""
    import hashlib

    def step(last, row):
        log, seq, digest = row
        made = hashlib.sha256(f"{last}:{digest}".encode()).hexdigest()
        return made, (log, seq, digest, last, made)

    return stream_fold(events.select("log", "seq", "digest"), "log", ["seq"], "log string, seq bigint, digest string, prev_hash string, hash string", lambda: "0" * 64, step)


def first_tampered(chain: DataFrame) -> DataFrame:
    """(log, index) of the first event whose link or hash is wrong, -1 for none; index from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("log").orderBy("seq")
    expected = F.coalesce(F.lag("hash").over(w), F.lit("0" * 64))
    bad = (F.col("prev_hash") != expected) | (F.col("hash") != F.sha2(F.concat_ws(":", "prev_hash", "digest"), 256))
    marked = chain.select("log", (F.row_number().over(w) - 1).alias("index"), F.coalesce(bad, F.lit(True)).alias("bad"))
    return marked.groupBy("log").agg(F.coalesce(F.min(F.when(F.col("bad"), F.col("index"))), F.lit(-1)).cast("bigint").alias("index"))


def roll_files(records: DataFrame, max_bytes: int) -> DataFrame:
    """K3: file number of each record (part, seq, size): a new file when the size would be exceeded."""

    def step(s, row):
        part, seq, size = row
        number, used = s
        if used and used + size > max_bytes:
            number, used = number + 1, 0
        return (number, used + size), (part, seq, number)

    return stream_fold(records.select("part", "seq", "size"), "part", ["seq"], "part string, seq bigint, file_no bigint", lambda: (0, 0), step)
