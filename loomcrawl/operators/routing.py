"""Consistent-hash routing and hot hosts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.functions.hashing import POSITIVE, mix64, mix64_array
from loomcrawl.functions.url import canon_host


def ring_positions(agents: list[str], vnodes: int) -> tuple[np.ndarray, list[str]]:
    """Signed positions in order and their agents; a later agent wins a shared position.

    Agents are configuration: their number does not grow with the data.
    """
    names = [f"{a}:{i}" for a in agents for i in range(vnodes)]
    positions = mix64_array([n.encode() for n in names]).view(np.int64)
    ring = dict(zip(positions.tolist(), [a for a in agents for _ in range(vnodes)]))
    order = sorted(ring)
    return np.array(order, np.int64), [ring[p] for p in order]


def ring_table(spark: SparkSession, agents: list[str], vnodes: int) -> DataFrame:
    positions, owners = ring_positions(agents, vnodes)
    return spark.createDataFrame(pd.DataFrame({"position": positions, "agent": owners}), "position bigint, agent string")


def ring_owner(host: Column, agents: list[str], vnodes: int) -> Column:
    """Agent at the first position at or after the host's hash, the first one after the last."""
    positions, owners = ring_positions(agents, vnodes)
    names = np.array(owners, object)

    @F.pandas_udf("string")
    def owner(hashes: pd.Series) -> pd.Series:
        known = hashes.notna().to_numpy()
        out = np.full(len(hashes), None, object)
        at = np.searchsorted(positions, hashes[known].to_numpy(np.int64), side="left") % len(positions)
        out[known] = names[at]
        return pd.Series(out)

    return owner(mix64(host))


def ring_owners(host: Column, agents: list[str], vnodes: int, n: int) -> Column:
    """The first n different agents clockwise."""
    positions, owners = ring_positions(agents, vnodes)

    def walk(at: int) -> list[str]:
        found: dict[str, None] = {}
        for k in range(len(owners)):
            found[owners[(at + k) % len(owners)]] = None
            if len(found) == min(n, len(agents)):
                break
        return list(found)

    table = [walk(i) for i in range(len(owners))]

    @F.pandas_udf("array<string>")
    def owner(hashes: pd.Series) -> pd.Series:
        at = np.searchsorted(positions, hashes.fillna(0).to_numpy(np.int64), side="left") % len(positions)
        return pd.Series([table[i] if ok else None for i, ok in zip(at, hashes.notna())])

    return owner(mix64(host))


def participants(policies: DataFrame) -> DataFrame:
    """Latest policy of each host with owner and spill-over agents in order."""
    latest = policies.withColumn("host", canon_host(F.col("host"))).where(F.col("host").isNotNull()).groupBy("host").agg(F.max_by(F.struct("owning_agent", "spillover_agents", "split_factor"), F.struct("configured_at", "owning_agent")).alias("p"))
    return latest.select("host", F.concat(F.array("p.owning_agent"), F.coalesce("p.spillover_agents", F.array().cast("array<string>"))).alias("agents"), F.col("p.split_factor").alias("split"))


def hot_executor(url: Column, agents: Column, split: Column) -> Column:
    """Participant chosen by the url's hash; NULL when there are fewer participants than parts."""
    return F.try_element_at(agents, (mix64(url).bitwiseAND(F.lit(POSITIVE)) % split + 1).cast("int"))


def merge_members(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per agent the snapshot with the higher generation, then the worse status; ties keep the known."""
    rank = F.when(F.col("status") == "DEAD", 2).when(F.col("status") == "SUSPECT", 1).otherwise(0)
    both = known.withColumn("mine", F.lit(1)).unionByName(incoming.withColumn("mine", F.lit(0)))
    columns = known.columns
    best = both.groupBy("agent_id").agg(F.max_by(F.struct(*columns), F.struct("generation", rank.alias("rank"), "mine")).alias("s"))
    return best.select("s.*")


def evaluate_liveness(members: DataFrame, now_ms: int, suspect_ms: int = 5000, dead_ms: int = 15000, self_id: str | None = None) -> DataFrame:
    """One step of ALIVE to SUSPECT to DEAD by age of the heartbeat; a step stamps it anew."""
    age = F.lit(now_ms) - F.col("heartbeat_ms")
    other = F.col("agent_id") != F.lit(self_id) if self_id else F.lit(True)
    status = F.when(other & (F.col("status") == "ALIVE") & (age > suspect_ms), "SUSPECT").when(other & (F.col("status") == "SUSPECT") & (age > dead_ms), "DEAD").otherwise(F.col("status"))
    return members.withColumn("new_status", status).select(*[c for c in members.columns if c not in ("status", "heartbeat_ms")], F.col("new_status").alias("status"), F.when(F.col("new_status") != F.col("status"), F.lit(now_ms)).otherwise(F.col("heartbeat_ms")).alias("heartbeat_ms"))


def with_status(members: DataFrame, status: str) -> DataFrame:
    """P9."""
    return members.where(F.col("status") == status)


def heartbeat(members: DataFrame, agent_id: str, now_ms: int) -> DataFrame:
    """The agent's own row with a new heartbeat; others as they are."""
    return members.withColumn("heartbeat_ms", F.when(F.col("agent_id") == agent_id, F.lit(now_ms)).otherwise(F.col("heartbeat_ms")).cast("bigint"))


def anchor_get(anchor: DataFrame, agent_id: str) -> DataFrame:
    """M11; the anchor is a members table that :func:`merge_members` puts into."""
    return anchor.where(F.col("agent_id") == agent_id)


def anchor_remove(anchor: DataFrame, agents: list[str]) -> DataFrame:
    """M11."""
    return anchor.where(~F.col("agent_id").isin(*agents)) if agents else anchor


def remove_policies(policies: DataFrame, hosts: list[str]) -> DataFrame:
    """M8: the hot-host policies without those of ``hosts``."""
    return policies.where(~F.coalesce(canon_host(F.col("host")).isin(*hosts), F.lit(False))) if hosts else policies


def inbox(batches: DataFrame) -> DataFrame:
    """What waits for each target: (target_agent, n_messages, n_urls)."""
    waiting = batches.where(F.col("target_agent").isNotNull())
    return waiting.groupBy("target_agent").agg(F.count("*").alias("n_messages"), F.sum(F.greatest(F.size("urls"), F.lit(0))).alias("n_urls"))


def drain(batches: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(a target's messages, what is left)."""
    own = F.coalesce(F.col("target_agent") == target, F.lit(False))
    return batches.where(own), batches.where(~own)
