"""Control events that the crawl obeys.

Events are rows of an append-only table (seq, occurred_at, actor, action, subject, detail);
the state is the latest event of a subject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _latest(events: DataFrame, *actions: str) -> DataFrame:
    """(subject, action, seq): the newest of ``actions`` of each subject."""
    return events.where(F.col("action").isin(*actions) & F.col("subject").isNotNull()).groupBy("subject").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))


def quarantined(events: DataFrame) -> DataFrame:
    """(host) of the hosts that were quarantined and not released since."""
    return _latest(events, "quarantine", "release").where("action = 'quarantine'").select(F.col("subject").alias("host"))


def taken_down(events: DataFrame) -> DataFrame:
    """(url) of every takedown; there is no way back."""
    return events.where((F.col("action") == "takedown") & F.col("subject").isNotNull()).select(F.col("subject").alias("url")).distinct()


def is_paused(events: DataFrame) -> bool:
    last = events.where(F.col("action").isin("pause", "resume")).agg(F.max_by("action", "seq").alias("action")).first()
    return last.action == "pause"


def admitted(urls: DataFrame, events: DataFrame) -> DataFrame:
    """The rows of ``urls`` (url, host, ...) that neither a takedown nor a quarantine holds back."""
    return urls.join(taken_down(events), "url", "left_anti").join(quarantined(events), "host", "left_anti")


def scope_history(events: DataFrame) -> DataFrame:
    """(seq, occurred_at, actor, detail) of the scope updates; the permissive scope at the start is not among them."""
    return events.where(F.col("action") == "scope").select("seq", "occurred_at", "actor", "detail")


def current_scope(events: DataFrame) -> str | None:
    """The newest scope's text, None while the permissive one holds."""
    return events.where(F.col("action") == "scope").agg(F.max_by("detail", "seq").alias("detail")).first().detail


def last_action(events: DataFrame) -> DataFrame:
    """One row with the time of the newest event and the number of seeds."""
    return events.agg(F.max("occurred_at").alias("last_action_at"), F.count(F.when(F.col("action") == "seed", 1)).alias("n_seeds"))
