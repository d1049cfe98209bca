"""Queries of the general data problems (3 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcrawl.operators import skew
from loomcrawl.plans.duck import canon_host
from loomcrawl.sources.tables import table
from loomcrawl.streaming import dedup


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.frequent_hosts(skew.host_figures(table(spark, d, "back_queue_entries")))


def p3_host_figures(spark: SparkSession, d: str) -> DataFrame:
    return skew.with_policy(skew.host_figures(table(spark, d, "back_queue_entries")), table(spark, d, "hot_host_policies"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeated_deliveries(spark, f"{d}/forwarding_batches.parquet")


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.kept_deliveries(spark, f"{d}/forwarding_batches.parquet").select("delivery_id")


QUERIES = {"p3_found": p3_found, "p3_host_figures": p3_host_figures, "p6_found": p6_found, "p6_kept": p6_kept}

_HOSTS = f"SELECT {canon_host('host_name')} AS host, * FROM back_queue_entries"
_MESSAGE = r"""SELECT delivery_id, coalesce(lower(regexp_replace(source_agent, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), '|') AS agent,
  batch_sequence AS seq, date_trunc('millisecond', emitted_at) AS sent_at FROM forwarding_batches"""
_FIRST = f"SELECT min(delivery_id) AS delivery_id FROM ({_MESSAGE}) GROUP BY agent, seq, sent_at"
_COUNTS = ",\n  ".join(f"count(*) FILTER (WHERE priority_class = '{c}') AS n_{c.lower()}" for c in skew.CLASSES)
_KNOWN = ", ".join(f"'{c}'" for c in skew.CLASSES)

SQL = {
    "p3_found": f"SELECT host FROM ({_HOSTS}) WHERE host IS NOT NULL GROUP BY host HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM back_queue_entries)",
    "p3_host_figures": f"""WITH f AS (SELECT host, count(*) AS n_rows, min(discovered_at_epoch_ms) AS oldest_ms, {_COUNTS},
  count(*) FILTER (WHERE priority_class IS NULL OR priority_class NOT IN ({_KNOWN})) AS n_other_class FROM ({_HOSTS}) GROUP BY host),
p AS (SELECT {canon_host('host')} AS host, owning_agent AS policy_agent, split_factor AS policy_split,
  row_number() OVER (PARTITION BY {canon_host('host')} ORDER BY configured_at DESC, owning_agent DESC, split_factor DESC) AS k FROM hot_host_policies)
SELECT f.*, p.policy_agent, p.policy_split FROM f LEFT JOIN p ON f.host = p.host AND p.k = 1""",
    "p6_found": f"SELECT delivery_id FROM forwarding_batches WHERE delivery_id NOT IN ({_FIRST})",
    "p6_kept": _FIRST,
}
