"""The crawl as waves of DataFrames.

A wave claims the open frontier, asks the robots rules, fetches, parses, and admits new
urls. Every wave is written to the shared folder, so a wave depends only on files and
the plan does not grow. The driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcrawl.functions.codec import is_success
from loomcrawl.functions.htmlparse import parse_html
from loomcrawl.functions.url import canon_url, present, url_parts
from loomcrawl.operators import control, robots
from loomcrawl.session import fresh_path, materialize


@dataclass
class CrawlStats:
    """Figures of a crawl; reason 0 is an empty frontier, 1 the cap, 2 the depth, 3 a pause."""

    fetched: int = 0
    succeeded: int = 0
    failed: int = 0
    disallowed: int = 0
    documents: int = 0
    links: int = 0
    deduplicated: int = 0
    waves: int = 0
    stop_reason: int = 0


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], robots_bodies: DataFrame, max_urls: int, agent: str = "loomcrawl", max_depth: int | None = None, control_events: Callable[[], DataFrame] | None = None) -> tuple[CrawlStats, dict[str, DataFrame]]:
    """Crawl from ``seeds`` (url) until the frontier is empty or ``max_urls`` were fetched.

    ``fetch`` maps (url) to responses; ``robots_bodies`` has host and body. Gives the
    figures and the tables documents (url, doc) and links (source, target, ...). The cap
    takes the urls of a wave in the order of their text. ``max_depth`` bounds the links
    from a seed; there is no bound by default. ``control_events`` gives the control table as
    it is at the start of a wave: a pause ends the crawl, urls that were taken down and
    hosts in quarantine are not fetched.
    """
    stats = CrawlStats()
    rules, agents = robots.rule_table(robots_bodies), robots.agent_table(robots_bodies)
    rules, agents = materialize(rules, "crawl-rules"), materialize(agents, "crawl-agents")
    frontier = materialize(seeds.select(present(canon_url(F.col("url"))).alias("url")).distinct(), "crawl-frontier")
    spark = seeds.sparkSession
    known = fresh_path(spark, "crawl-seen")  # every wave adds its files; none is written twice
    frontier.write.parquet(known)
    tables: dict[str, DataFrame] = {}
    paths = {name: fresh_path(spark, f"crawl-all-{name}") for name in ("documents", "links")}  # the plan does not grow with the waves
    while not frontier.isEmpty():
        if max_depth is not None and stats.waves > max_depth:
            stats.stop_reason = 2
            break
        events = control_events() if control_events else None
        if events is not None and control.is_paused(events):
            stats.stop_reason = 3
            break
        room = max_urls - stats.fetched
        if room <= 0:
            stats.stop_reason = 1
            break
        asked = frontier.select("url", present(url_parts(F.col("url"))).alias("p")).select("url", F.col("p.host").alias("host"), F.lit(agent).alias("agent"), F.col("p.path").alias("path"))
        if events is not None:
            asked = control.admitted(asked, events)
        verdicts = robots.verdicts(asked, rules, agents)
        judged = materialize(asked.join(verdicts, ["host", "agent", "path"]).select("url", "verdict"), "crawl-judged")
        allowed = judged.where(F.col("verdict") == "ALLOWED").select("url")
        stats.disallowed += judged.where(F.col("verdict") != "ALLOWED").count()
        capped = allowed.count() > room
        claimed = materialize(allowed.orderBy("url").limit(room), "crawl-claimed") if capped else allowed
        responses = materialize(fetch(claimed), "crawl-responses")
        counts = responses.agg(F.count("*").alias("n"), F.count(F.when(is_success(F.col("outcome")), 1)).alias("good")).first()
        stats.fetched += counts.n
        stats.succeeded += counts.good
        stats.failed += counts.n - counts.good
        good = responses.where(is_success(F.col("outcome")) & F.col("body").isNotNull())
        parsed = materialize(good.select("url", parse_html(F.col("final_url"), F.col("body"), F.col("content_type")).alias("doc")), "crawl-parsed")
        documents = parsed.where("doc.indexable")
        links = parsed.select(F.col("url").alias("source"), F.explode("doc.outlinks").alias("o")).select("source", present(canon_url(F.col("o.target"))).alias("target"), "o.anchor", "o.rel", "o.section")
        links = materialize(links, "crawl-links")
        stats.documents += documents.count()
        found = links.count()
        stats.links += found
        fresh = materialize(links.select(F.col("target").alias("url")).distinct().join(spark.read.schema("url string").parquet(known), "url", "left_anti"), "crawl-fresh")
        stats.deduplicated += found - fresh.count()
        for name, df in (("documents", documents), ("links", links)):
            df.write.mode("append").parquet(paths[name])
            tables[name] = spark.read.schema(df.schema).parquet(paths[name])
        fresh.write.mode("append").parquet(known)
        frontier = fresh
        stats.waves += 1
        if capped:
            stats.stop_reason = 1
            break
    return stats, tables
