"""Operator commands, written as rows of an append-only control table.

    python -m loomcrawl.cli CONTROL_DIR seed URL...
    python -m loomcrawl.cli CONTROL_DIR takedown URL REASON
    python -m loomcrawl.cli CONTROL_DIR quarantine|release HOST
    python -m loomcrawl.cli CONTROL_DIR pause|resume|status
    python -m loomcrawl.cli CONTROL_DIR audit [LIMIT]

Exit codes: 0 done, 64 wrong usage, 70 failed.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.functions.url import canon_host, canon_url
from loomcrawl.operators.control import quarantined

KIND = "seq bigint, occurred_at timestamp, actor string, action string, subject string, detail string"
USAGE = 64
FAILED = 70


def control(spark: SparkSession, folder: str) -> DataFrame:
    """All control rows, an empty table before the first."""
    try:
        return spark.read.schema(KIND).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KIND)


def record(spark: SparkSession, folder: str, action: str, subjects: list[str], detail: str = "") -> None:
    at = time.time()
    first = control(spark, folder).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("n")).first().n + 1
    actor = os.environ.get("USER", "operator")
    rows = [(first + i, s) for i, s in enumerate(subjects)]
    df = spark.createDataFrame(rows, "seq bigint, subject string").select("seq", F.timestamp_seconds(F.lit(at)).alias("occurred_at"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), "subject", F.lit(detail).alias("detail"))
    df.write.mode("append").parquet(folder)


def _valid(spark: SparkSession, values: list[str], rule) -> list[str] | None:
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(rule(F.col("v")).alias("c")).collect()
    found = [r.c for r in rows]
    return None if not found or None in found else found


def main(args: list[str], spark: SparkSession | None = None, out=print) -> int:
    if len(args) < 2 or args[1] in ("help", "--help"):
        out(__doc__)
        return 0 if len(args) > 1 else USAGE
    folder, command, rest = args[0], args[1], args[2:]
    from loomcrawl.session import local_session

    spark = spark or local_session(1, 1)
    try:
        if command == "seed" and rest:
            urls = _valid(spark, rest, canon_url)
            if urls is None:
                out("not a valid http(s) url")
                return USAGE
            record(spark, folder, "seed", urls)
            out(f"{len(urls)} seeds")
        elif command == "takedown" and len(rest) >= 1:
            urls = _valid(spark, rest[:1], canon_url)
            if urls is None:
                return USAGE
            record(spark, folder, "takedown", urls, " ".join(rest[1:]))
        elif command in ("quarantine", "release") and len(rest) == 1:
            hosts = _valid(spark, rest, canon_host)
            if hosts is None:
                return USAGE
            record(spark, folder, command, hosts)
        elif command in ("pause", "resume") and not rest:
            record(spark, folder, command, ["crawl"])
        elif command == "status" and not rest:
            last = control(spark, folder).where(F.col("action").isin("pause", "resume")).orderBy(F.desc("seq")).first()
            out("paused" if last and last.action == "pause" else "running")
            out(f"{quarantined(control(spark, folder)).count()} hosts in quarantine")
        elif command == "audit" and len(rest) <= 1:
            limit = int(rest[0]) if rest else 50
            for r in reversed(control(spark, folder).orderBy(F.desc("seq")).limit(limit).collect()):
                out(f"{r.seq} {r.occurred_at:%Y-%m-%dT%H:%M:%S} {r.actor} {r.action} {r.subject} {r.detail}".rstrip())
        else:
            out(__doc__)
            return USAGE
    except ValueError as e:
        out(str(e))
        return USAGE
    except Exception as e:  # noqa: BLE001 - an operator sees the message, not a trace
        out(f"failed: {e}")
        return FAILED
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
