"""Robots rules and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcrawl.functions.url import java_trim

HOUR_MS = 3_600_000


def directives(bodies: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, line_no, directive, value) of every well-formed line, comments removed."""
    line = java_trim(F.regexp_replace("line", "#.*$", ""))
    each = bodies.where(F.col(body).isNotNull()).select(key, F.posexplode(F.split(body, r"\r?\n", -1)).alias("line_no", "line")).select(key, "line_no", line.alias("line"))
    colon = F.instr("line", ":")
    return each.where(colon > 1).select(key, "line_no", F.lower(java_trim(F.substring_index("line", ":", 1))).alias("directive"), java_trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


def rule_table(bodies: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, agent, kind, pattern) of every rule, agents in lower case.

    A group starts at a user-agent line that follows any other directive but a sitemap.
    Windows run over the lines of one file only.
    """
    lines = directives(bodies, key, body).where(F.col("directive") != "sitemap")
    w = Window.partitionBy(key).orderBy("line_no")
    is_agent = F.col("directive") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag("directive").over(w) == "user-agent", F.lit(False))
    grouped = lines.withColumn("starts", starts.cast("int")).withColumn("group_no", F.sum("starts").over(w)).where(F.col("group_no") > 0)
    agents = grouped.where(F.col("directive") == "user-agent").select(key, "group_no", F.lower("value").alias("agent")).distinct()
    rules = grouped.where(F.col("directive").isin("allow", "disallow") & (F.col("value") != "")).select(key, "group_no", F.col("directive").alias("kind"), F.col("value").alias("pattern"))
    return agents.join(rules, [key, "group_no"]).select(key, "agent", "kind", "pattern").distinct()


def crawl_delays(bodies: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, agent, delay_s): the delay that a file asks of each agent.

    Within a group the last well-formed line counts, among groups of one agent the first
    group that has one.
    """
    lines = directives(bodies, key, body).where(F.col("directive") != "sitemap")
    w = Window.partitionBy(key).orderBy("line_no")
    is_agent = F.col("directive") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag("directive").over(w) == "user-agent", F.lit(False))
    grouped = lines.withColumn("starts", starts.cast("int")).withColumn("group_no", F.sum("starts").over(w)).where(F.col("group_no") > 0)
    seconds = F.when(F.col("value").rlike("^[+-]?[0-9]+$"), F.col("value").try_cast("bigint"))
    asked = grouped.where((F.col("directive") == "crawl-delay") & seconds.isNotNull()).groupBy(key, "group_no").agg(F.max_by(seconds, "line_no").alias("delay_s"))
    agents = grouped.where(is_agent).select(key, "group_no", F.lower("value").alias("agent")).distinct()
    return agents.join(asked, [key, "group_no"]).groupBy(key, "agent").agg(F.min_by("delay_s", "group_no").alias("delay_s"))


def sitemaps(bodies: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, line_no, sitemap) of every sitemap line."""
    return directives(bodies, key, body).where(F.col("directive") == "sitemap").select(key, "line_no", F.col("value").alias("sitemap"))


def fresh(cache: DataFrame, now_ms: int) -> DataFrame:
    """Cached answers (host, source, fetched_ms, expires_ms) that still hold; the last moment counts."""
    return cache.where(F.col("expires_ms") >= now_ms)


def peek(cache: DataFrame, hosts: DataFrame) -> DataFrame:
    """M4: the cached answers of ``hosts``, fresh or not; nothing is fetched."""
    return cache.join(hosts.select("host").distinct(), "host", "left_semi")


def invalidate(cache: DataFrame, hosts: DataFrame) -> DataFrame:
    """M4."""
    return cache.join(hosts.select("host").distinct(), "host", "left_anti")


def refresh(cache: DataFrame, responses: DataFrame, now_ms: int) -> DataFrame:
    """The cache after answers (host, status, error) of one time.

    A failed answer keeps the previous rules for an hour when they were fetched in the last
    seven days; a stale entry keeps the time at which it was fetched.
    """
    old = cache.select("host", F.col("source").alias("old_source"), F.col("fetched_ms").alias("old_fetched_ms"))
    met = responses.select("host", "status", "error").join(old, "host", "left")
    source, ttl = cache_policy(F.col("status"), F.col("error"), F.col("old_source"), F.lit(now_ms) - F.col("old_fetched_ms"))
    made = met.select("host", source.alias("source"), F.col("old_fetched_ms"), ttl.alias("ttl_ms"))
    fetched = F.when(F.col("source") == "STALE_SERVE", F.col("old_fetched_ms")).otherwise(F.lit(now_ms)).cast("bigint")
    new = made.select("host", "source", fetched.alias("fetched_ms"), (F.lit(now_ms) + F.col("ttl_ms")).cast("bigint").alias("expires_ms"))
    return invalidate(cache, responses).select(new.columns).unionByName(new)


def agent_table(bodies: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, agent) of every user-agent line, with or without rules."""
    return directives(bodies, key, body).where(F.col("directive") == "user-agent").select(key, F.lower("value").alias("agent")).distinct()


def verdicts(probes: DataFrame, rules: DataFrame, agents: DataFrame, key: str = "host") -> DataFrame:
    """ALLOWED or DISALLOWED for each probe (key, agent, path).

    The agent's own group counts, else ``*``; the longest prefix wins, a tie allows.
    """
    asked = probes.select(key, "agent", "path").distinct()
    own = agents.select(key, "agent").distinct().withColumn("own", F.lit(True))
    chosen = asked.join(own, [key, "agent"], "left").withColumn("group_agent", F.when(F.col("own"), F.col("agent")).otherwise("*")).drop("own")
    # The rules of one group are one row, bounded by the size of a robots file, so a probe is
    # joined once however many rules its host has; AQE splits the probes of a hot host.
    rule = F.struct(F.length("pattern").alias("size"), (F.col("kind") == "allow").alias("allow"), "pattern")
    groups = rules.groupBy(key, F.col("agent").alias("group_agent")).agg(F.sort_array(F.collect_list(rule), asc=False).alias("rules"))
    met = chosen.join(groups, [key, "group_agent"], "left")
    first = F.try_element_at(F.filter("rules", lambda r: F.col("path").startswith(r["pattern"])), F.lit(1))  # longest first, allow before disallow
    return met.select(key, "agent", "path", F.when(~first["allow"], "DISALLOWED").otherwise("ALLOWED").alias("verdict"))


def cache_policy(status: Column, error: Column, previous: Column, previous_age_ms: Column) -> tuple[Column, Column]:
    """(source, time to live in ms) of a robots answer, given the previous entry."""
    stale = (previous == "FETCHED") & (previous_age_ms < 7 * 24 * HOUR_MS)
    failed = error.isNotNull() | (status >= 500)
    source = (
        F.when(failed & stale, "STALE_SERVE")
        .when(failed, "DISALLOW_ALL_5XX")
        .when(status.between(200, 299), "FETCHED")
        .when(status.between(400, 499), "ALLOW_ALL_4XX")
        .otherwise("DISALLOW_ALL_5XX")
    )
    return source, F.when(source.isin("FETCHED", "ALLOW_ALL_4XX"), 24 * HOUR_MS).otherwise(HOUR_MS)


def host_matches(host: Column, rule: str) -> Column:
    """F35."""
    return host.endswith(rule[1:]) if rule.startswith("*.") else host == rule


def scope_verdict(host: Column, allow: list[str], deny: list[str]) -> Column:
    """A deny match denies; without allow rules all else is allowed; rules are configuration."""
    any_of = lambda rules: F.coalesce(F.greatest(F.lit(False), F.lit(False), *[host_matches(host, r) for r in rules]), F.lit(False))
    allowed = any_of(allow) if allow else F.lit(True)
    return F.when(any_of(deny), "DENY").when(allowed, "ALLOW").otherwise("DENY")
