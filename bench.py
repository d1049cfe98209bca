"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from loomcrawl.plans import registry
from loomcrawl.session import local_session

HEADLINE = [
    "url_canonicalize", "url_dedup_verdict", "url_net_new", "simhash64", "near_dup_pairs_k3", "page_outlinks", "link_indegree",
    "opic_top", "host_backoff", "recrawl_state", "politeness_grants", "robots_verdicts", "ring_owner", "cdxj_lines", "audit_chain",
    "frontier_positions", "p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_pack", "p9_found", "p10_pieces",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in every]
    every[names[0]](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM's and Python's workers
    seconds = {}
    for name in names:
        began = time.time()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
