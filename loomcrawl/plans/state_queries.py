"""Queries of the operators that keep tables of state (DNS, control, frontier, caches, metrics) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.functions import codec, simhash, url
from loomcrawl.operators import control, dns, folds, frontier, graph, metrics, robots, routing
from loomcrawl.plans import core_queries as core
from loomcrawl.plans.duck import url_table
from loomcrawl.session import fresh_path
from loomcrawl.sources import archive, fetch
from loomcrawl.sources.tables import table
from loomcrawl.streaming import keyed
from loomcrawl.streaming.dedup import parquet_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW_MS = core.NOW_MS


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- DNS -----------------------------------------------------------------------

_HOSTS = f"(SELECT DISTINCT host FROM {core._URLS} WHERE host IS NOT NULL)"


def _lookups(spark: SparkSession, d: str) -> DataFrame:
    """Every link asks for the address of its target's host, links of even and odd ids in different families."""
    links = table(spark, d, "extracted_links").select(F.col("link_id").alias("seq"), url.present(url.url_parts(F.col("target_url"))["host"]).alias("host")).dropDuplicates(["seq"])
    return links.select("seq", "host", F.when(F.col("seq") % 2 == 0, "IPV4").otherwise("IPV6").alias("family"), F.lit(NOW_MS).alias("now_ms"))


def _cache(spark: SparkSession, d: str) -> DataFrame:
    """What earlier lookups left: by the length of a host's name a positive, a negative or no row."""
    h = core.targets(spark, d).select(url.url_parts(F.col("target_url"))["host"].alias("host")).where(F.col("host").isNotNull()).distinct()
    size, hit = F.length("host"), F.length("host") % 3 == 0
    rows = h.where(size % 3 < 2).select("host", F.explode(F.array(*[F.lit(f) for f in dns.FAMILIES])).alias("family"), hit.alias("hit"))
    ips = F.when(F.col("hit"), F.array(F.concat(F.lit("10.0.0."), (size % 8).cast("string"))))
    return rows.select("host", "family", F.when(F.col("hit"), "HIT").otherwise("MISS").alias("kind"), ips.alias("ips"), F.when(~F.col("hit"), "NXDOMAIN").alias("error"), (F.lit(NOW_MS) + (size % 5 - 2) * 60_000).cast("bigint").alias("expires_ms"))


def _upstream(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the upstream: none for names of a length that 7 divides."""
    h = core.targets(spark, d).select(url.url_parts(F.col("target_url"))["host"].alias("host")).where(F.col("host").isNotNull()).distinct().where(F.length("host") % 7 != 0)
    size = F.length("host")
    rows = h.select("host", F.explode(F.array(*[F.lit(f) for f in dns.FAMILIES])).alias("family"))
    bad = size % 11 == 0
    return rows.select("host", "family", F.when(~bad, F.array(F.concat(F.lit("10.0.2."), (size % 6).cast("string")))).alias("ips"), F.when(bad, "SERVFAIL").alias("error"), (F.lit(NOW_MS) + size * 100_000 - 1_000_000).cast("bigint").alias("expires_ms"))


_CACHE = f"""(SELECT host, family, CASE WHEN length(host) % 3 = 0 THEN 'HIT' ELSE 'MISS' END AS kind, CASE WHEN length(host) % 3 = 0 THEN ['10.0.0.' || length(host) % 8] END AS ips,
  CASE WHEN length(host) % 3 <> 0 THEN 'NXDOMAIN' END AS error, {NOW_MS}::BIGINT + (length(host) % 5 - 2) * 60000 AS expires_ms FROM {_HOSTS}, (VALUES ('IPV4'), ('IPV6')) v(family) WHERE length(host) % 3 < 2)"""
_VERDICTS = f"""(WITH l AS (SELECT DISTINCT ON (link_id) link_id AS seq, host, CASE WHEN link_id % 2 = 0 THEN 'IPV4' ELSE 'IPV6' END AS family FROM {url_table('extracted_links', 'target_url', 'link_id')} WHERE host IS NOT NULL),
h AS (SELECT seq, l.host, l.family, CASE WHEN kind = 'HIT' THEN 'POSITIVE_HIT' WHEN kind = 'MISS' THEN 'NEGATIVE_HIT' END AS hit FROM l LEFT JOIN {_CACHE} c ON c.host = l.host AND c.family = l.family AND c.expires_ms > {NOW_MS})
SELECT seq, host, family, coalesce(hit, CASE WHEN row_number() OVER (PARTITION BY host, family, hit ORDER BY seq) = 1 THEN 'UPSTREAM' ELSE 'COALESCED' END) AS verdict FROM h)"""
_ANSWERED = f"""(SELECT u.host, u.family, CASE WHEN length(u.host) % 7 = 0 OR length(u.host) % 11 = 0 THEN 'MISS' ELSE 'HIT' END AS kind,
  CASE WHEN length(u.host) % 7 <> 0 AND length(u.host) % 11 <> 0 THEN ['10.0.2.' || length(u.host) % 6] END AS ips,
  CASE WHEN length(u.host) % 7 = 0 THEN 'TIMEOUT' WHEN length(u.host) % 11 = 0 THEN 'SERVFAIL' END AS error,
  CASE WHEN length(u.host) % 7 = 0 THEN {NOW_MS}::BIGINT + 300000 WHEN length(u.host) % 11 = 0 THEN least({NOW_MS}::BIGINT + length(u.host) * 100000 - 1000000, {NOW_MS}::BIGINT + 300000)
    ELSE least(greatest({NOW_MS}::BIGINT + length(u.host) * 100000 - 1000000, {NOW_MS}::BIGINT + 60000), {NOW_MS}::BIGINT + 3600000) END AS expires_ms FROM {_VERDICTS} u WHERE verdict = 'UPSTREAM')"""
_REFRESHED = f"(SELECT host, family, kind, ips, error, expires_ms FROM {_CACHE} c WHERE NOT EXISTS (SELECT 1 FROM {_ANSWERED} a WHERE a.host = c.host AND a.family = c.family) UNION ALL SELECT host, family, kind, ips, error, expires_ms FROM {_ANSWERED})"


@query("dns_lookups", f"SELECT seq, host, family, {NOW_MS}::BIGINT AS now_ms, verdict FROM {_VERDICTS}")
def dns_lookups(spark, d):
    return dns.lookup_verdicts(_lookups(spark, d), _cache(spark, d))


def _refreshed(spark, d):
    cache = _cache(spark, d)
    return dns.refreshed(cache, dns.lookup_verdicts(_lookups(spark, d), cache), _upstream(spark, d))


@query("dns_cache", f"SELECT * FROM {_REFRESHED}")
def dns_cache(spark, d):
    return _refreshed(spark, d)


@query("dns_permits", f"SELECT host, family, ((row_number() OVER (PARTITION BY host ORDER BY seq) - 1) // 1)::INTEGER AS wave FROM {_VERDICTS} WHERE verdict = 'UPSTREAM'")
def dns_permits(spark, d):
    return dns.permit_waves(dns_lookups(spark, d), 1)


@query(
    "dns_stats",
    f"""WITH v AS (SELECT count(*) AS n_lookups, count(*) FILTER (WHERE verdict = 'POSITIVE_HIT') AS n_positive, count(*) FILTER (WHERE verdict = 'NEGATIVE_HIT') AS n_negative,
  count(*) FILTER (WHERE verdict = 'COALESCED') AS n_coalesced, count(*) FILTER (WHERE verdict = 'UPSTREAM') AS n_upstream FROM {_VERDICTS}),
c AS (SELECT count(*) FILTER (WHERE kind = 'HIT') AS n_cached_hits, count(*) FILTER (WHERE kind = 'MISS') AS n_cached_misses FROM {_REFRESHED})
SELECT *, round((n_positive + n_negative) / n_lookups, 9) AS hit_ratio, round(n_coalesced / (n_upstream + n_coalesced), 9) AS saved_ratio FROM v, c""",
)
def dns_stats(spark, d):
    cache = _cache(spark, d)
    verdicts = dns.lookup_verdicts(_lookups(spark, d), cache)
    return dns.stats(verdicts, dns.refreshed(cache, verdicts, _upstream(spark, d)))


@query("dns_invalidated", f"SELECT DISTINCT unnest(ips) AS ip, host FROM {_REFRESHED} WHERE kind = 'HIT' AND length(host) % 2 = 0")
def dns_invalidated(spark, d):
    cache = _refreshed(spark, d)
    return dns.hosts_sharing(dns.invalidate(cache, cache.where(F.length("host") % 2 == 1).select("host")))


# --- Control -------------------------------------------------------------------

_ACTIONS = {"view": "quarantine", "signup": "release", "click": "takedown", "error": "scope", "purchase": "seed"}
_CONTROL = f"(SELECT event_id AS seq, ts AS occurred_at, 'operator' AS actor, CASE event_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _ACTIONS.items())} END AS action, 'host-' || user_id || '.test' AS subject, value::DECIMAL(18,2)::VARCHAR AS detail FROM events)"


def _control(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    action = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _ACTIONS.items()])
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("occurred_at"), F.lit("operator").alias("actor"), action.alias("action"), F.concat(F.lit("host-"), F.col("user_id").cast("string"), F.lit(".test")).alias("subject"), F.col("value").cast("decimal(18,2)").cast("string").alias("detail"))


_QUARANTINED = f"(SELECT subject AS host FROM {_CONTROL} WHERE action IN ('quarantine', 'release') GROUP BY subject HAVING arg_max(action, seq) = 'quarantine')"


@query("control_quarantined", f"SELECT host FROM {_QUARANTINED}")
def control_quarantined(spark, d):
    return control.quarantined(_control(spark, d))


@query("control_admitted", f"SELECT url, host FROM (SELECT 'host-' || user_id || '.test' AS url, 'host-' || (user_id + 1) || '.test' AS host FROM (SELECT DISTINCT user_id FROM events)) WHERE url NOT IN (SELECT subject FROM {_CONTROL} WHERE action = 'takedown' AND seq % 40 = 0) AND host NOT IN (SELECT host FROM {_QUARANTINED})")
def control_admitted(spark, d):
    e = _control(spark, d).where((F.col("action") != "takedown") | (F.col("seq") % 40 == 0))
    name = lambda k: F.concat(F.lit("host-"), (F.col("user_id") + k).cast("string"), F.lit(".test"))
    urls = table(spark, d, "events").select("user_id").distinct().select(name(0).alias("url"), name(1).alias("host"))
    return control.admitted(urls, e).select("url", "host")


@query("control_scope", f"SELECT count(*) AS n_updates, arg_max(detail, seq) AS scope FROM {_CONTROL} WHERE action = 'scope'")
def control_scope(spark, d):
    return control.scope_history(_control(spark, d)).agg(F.count("*").alias("n_updates"), F.max_by("detail", "seq").alias("scope"))


@query("control_last_action", f"SELECT epoch_us(max(occurred_at)) // 1000 AS last_ms, count(*) FILTER (WHERE action = 'seed') AS n_seeds FROM {_CONTROL}")
def control_last_action(spark, d):
    return control.last_action(_control(spark, d)).select(F.unix_millis("last_action_at").alias("last_ms"), "n_seeds")


# --- Frontier ------------------------------------------------------------------

_BACKOFF = core.SQL["host_backoff"]
_STATES = f"""(SELECT coalesce(q.host, b.host) AS host, coalesce(next_fetch_ms, 0)::BIGINT AS next_fetch_ms, 1000::BIGINT AS crawl_delay_ms, coalesce(backoff, 1.0)::DOUBLE AS backoff, coalesce(errors, 0)::INTEGER AS errors, last_success_ms,
  coalesce(depth, 0)::BIGINT AS depth, coalesce(q.host, b.host) IN (SELECT host FROM (SELECT host FROM {core._QUEUE} WHERE host IS NOT NULL) WHERE length(host) % 5 = 0) AS quarantined
  FROM (SELECT host, count(*) AS depth FROM {core._QUEUE} WHERE host IS NOT NULL GROUP BY host) q FULL JOIN ({_BACKOFF}) b ON q.host = b.host)"""


def _states(spark, d) -> DataFrame:
    q = core._queue(spark, d)
    held = q.where(F.length("host") % 5 == 0).select("host")
    return frontier.host_states(q.select("host"), core.host_backoff(spark, d), held)


@query("frontier_hosts", f"SELECT * FROM {_STATES}")
def frontier_hosts(spark, d):
    return _states(spark, d)


@query("frontier_claimable", f"SELECT host, depth FROM {_STATES} WHERE NOT quarantined AND depth > 0 AND next_fetch_ms <= {NOW_MS - 10 * folds.DAY_MS}")
def frontier_claimable(spark, d):
    return frontier.claimable(_states(spark, d), NOW_MS - 10 * folds.DAY_MS).select("host", "depth")


@query("frontier_generations", f"SELECT host, max(fetch_id) AS generation, arg_max(at_ms, fetch_id) AS next_ms FROM {core._FETCH} WHERE host IS NOT NULL GROUP BY host")
def frontier_generations(spark, d):
    heap = core.fetches(spark, d).where(F.col("host").isNotNull()).select("host", F.col("fetch_id").alias("generation"), F.col("at_ms").alias("next_ms"))
    return frontier.latest_generation(heap)


@query("frontier_snapshot", f"SELECT host, depth, quarantined FROM {_STATES}")
def frontier_snapshot(spark, d):
    """Saved to the shared folder and loaded again."""
    path = fresh_path(spark, "snapshot")
    archive.save_snapshot({"hosts": _states(spark, d)}, path)
    return archive.load_snapshot(spark, path, ["hosts"])["hosts"].select("host", "depth", "quarantined")


@query("politeness_clock", f"SELECT g.host, max(at_ms) + 60000 AS clock_ms FROM ({core.SQL['politeness_grants']}) g JOIN {core._FETCH} f ON f.fetch_id = g.seq WHERE granted GROUP BY g.host")
def politeness_clock(spark, d):
    asked = core.fetches(spark, d)
    grants = folds.politeness_grants(asked, 60_000).join(asked.select("seq", "at_ms"), "seq")
    return folds.clock_peek(grants, 60_000)


# --- Robots --------------------------------------------------------------------

_ROBOTS = core._ROBOTS


#: The files of the tables ask for no delay and name no map; each gets a group and a map of its own at the end.
_TAIL = "chr(10) || 'User-agent: DelayBot' || chr(10) || 'Crawl-delay: ' || (doc_id % 7) || chr(10) || 'Crawl-delay: none' || chr(10) || 'Sitemap: http://maps.test/' || doc_id"
_ASKING = _ROBOTS.replace("SELECT doc_id, text FROM documents", f"SELECT doc_id, text || {_TAIL} AS text FROM documents")


def _asking(spark, d) -> DataFrame:
    number = F.col("doc_id").cast("string")
    tail = F.concat(F.lit("\nUser-agent: DelayBot\nCrawl-delay: "), (F.col("doc_id") % 7).cast("string"), F.lit("\nCrawl-delay: none\nSitemap: http://maps.test/"), number)
    return core._robots(spark, d).select("doc_id", F.concat("text", tail).alias("text"))


@query(
    "robots_crawl_delays",
    f"""WITH {_ASKING}, s AS (SELECT doc_id, g, arg_max(try_cast(value AS BIGINT), line_no) AS delay_s FROM g WHERE directive = 'crawl-delay' AND g > 0 AND regexp_full_match(value, '[+-]?[0-9]+') GROUP BY doc_id, g)
SELECT doc_id, agent, arg_min(delay_s, g) AS delay_s FROM a JOIN s USING (doc_id, g) GROUP BY doc_id, agent""",
)
def robots_crawl_delays(spark, d):
    return robots.crawl_delays(_asking(spark, d), "doc_id", "text")


@query("robots_sitemaps", f"WITH {_ASKING} SELECT doc_id, line_no::INTEGER AS line_no, value AS sitemap FROM d WHERE directive = 'sitemap'")
def robots_sitemaps(spark, d):
    return robots.sitemaps(_asking(spark, d), "doc_id", "text")


def _robots_state(spark, d) -> tuple[DataFrame, DataFrame]:
    """(cache, responses): the last fetch of each host stands for its robots answer, the host's name for its past."""
    last = core.fetches(spark, d).join(table(spark, d, "fetch_results").select("fetch_id", "http_status", "error_message").dropDuplicates(["fetch_id"]), "fetch_id").where(F.col("host").isNotNull())
    responses = last.groupBy("host").agg(F.max_by(F.struct("http_status", "error_message"), "fetch_id").alias("r")).select("host", F.col("r.http_status").alias("status"), F.col("r.error_message").alias("error"))
    size = F.length("host")
    age = (size % 10) * folds.DAY_MS
    cache = responses.where(size % 4 != 0).select("host", F.when(size % 4 == 1, "STALE_SERVE").otherwise("FETCHED").alias("source"), (F.lit(NOW_MS) - age).cast("bigint").alias("fetched_ms"), (F.lit(NOW_MS) - age + folds.DAY_MS).cast("bigint").alias("expires_ms"))
    return cache, responses.where(size % 3 != 0)


_RESPONSES = f"(SELECT f.host, arg_max({{'s': r.http_status, 'e': r.error_message}}, f.fetch_id) AS r FROM {core._FETCH} f JOIN (SELECT DISTINCT ON (fetch_id) * FROM fetch_results) r USING (fetch_id) WHERE f.host IS NOT NULL GROUP BY f.host)"
_ROBOTS_CACHE = f"(SELECT host, CASE WHEN length(host) % 4 = 1 THEN 'STALE_SERVE' ELSE 'FETCHED' END AS source, {NOW_MS}::BIGINT - (length(host) % 10) * 86400000 AS fetched_ms, {NOW_MS}::BIGINT - (length(host) % 10) * 86400000 + 86400000 AS expires_ms FROM {_RESPONSES} WHERE length(host) % 4 <> 0)"
_ROBOTS_REFRESH = f"""(SELECT * FROM {_ROBOTS_CACHE} WHERE length(host) % 3 = 0 UNION ALL
SELECT host, source, CASE WHEN source = 'STALE_SERVE' THEN old_ms ELSE {NOW_MS}::BIGINT END AS fetched_ms, {NOW_MS}::BIGINT + CASE WHEN source IN ('FETCHED', 'ALLOW_ALL_4XX') THEN 86400000 ELSE 3600000 END AS expires_ms FROM (
 SELECT x.host, c.fetched_ms AS old_ms, CASE WHEN (x.r.e IS NOT NULL OR x.r.s >= 500) AND c.source = 'FETCHED' AND {NOW_MS} - c.fetched_ms < 604800000 THEN 'STALE_SERVE' WHEN x.r.e IS NOT NULL OR x.r.s >= 500 THEN 'DISALLOW_ALL_5XX'
   WHEN x.r.s BETWEEN 200 AND 299 THEN 'FETCHED' WHEN x.r.s BETWEEN 400 AND 499 THEN 'ALLOW_ALL_4XX' ELSE 'DISALLOW_ALL_5XX' END AS source
 FROM {_RESPONSES} x LEFT JOIN {_ROBOTS_CACHE} c USING (host) WHERE length(x.host) % 3 <> 0))"""


@query("robots_cache_refresh", f"SELECT host, source, fetched_ms, expires_ms FROM {_ROBOTS_REFRESH}")
def robots_cache_refresh(spark, d):
    return robots.refresh(*_robots_state(spark, d), NOW_MS)


@query("robots_cache_fresh", f"SELECT host, source FROM {_ROBOTS_CACHE} WHERE expires_ms >= {NOW_MS} AND length(host) % 2 = 0")
def robots_cache_fresh(spark, d):
    cache, _ = _robots_state(spark, d)
    odd = cache.where(F.length("host") % 2 == 1).select("host")
    return robots.fresh(robots.invalidate(cache, odd), NOW_MS).select("host", "source")


# --- Metrics -------------------------------------------------------------------


@query("gauges", "SELECT 'queue.' || event_type AS name, '# TYPE queue_' || event_type || ' gauge' || chr(10) || 'queue_' || event_type || ' ' || arg_max(value, event_id)::VARCHAR || chr(10) AS text FROM events GROUP BY event_type")
def gauges(spark, d):
    e = table(spark, d, "events").withColumn("gauge", F.concat(F.lit("queue."), "event_type"))
    return metrics.prometheus_gauges(metrics.gauges(e, "gauge", "value", ["event_id"]))


@query(
    "prometheus_timers",
    f"""SELECT 'op.' || event_type AS name, '# TYPE op_' || event_type || '_seconds summary' || chr(10) || 'op_' || event_type || '_seconds{{quantile="0.5"}} ' || (v[least(floor(len(v) * 0.5), len(v) - 1)::INT + 1] / 1e9)::VARCHAR || chr(10)
  || 'op_' || event_type || '_seconds{{quantile="0.99"}} ' || (v[least(floor(len(v) * 0.99), len(v) - 1)::INT + 1] / 1e9)::VARCHAR || chr(10) || 'op_' || event_type || '_seconds_count ' || n || chr(10) AS text
FROM (SELECT event_type, count(*) AS n, list((value * 100)::BIGINT * 100000000 ORDER BY value) FILTER (WHERE k <= 1024) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY event_type)""",
)
def prometheus_timers(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("op."), "event_type").alias("name"), (F.round(F.col("value") * 100).cast("bigint") * 100_000_000).alias("nanos"), "ts", "event_id")
    return metrics.prometheus_timers(metrics.timer_percentiles(e, "name", "nanos", ["ts", "event_id"]))


_BENCH = """(SELECT content_type AS bench, count(*) AS n_ops, count(*) FILTER (WHERE error_message IS NOT NULL) AS n_errors, (epoch_us(max(fetched_at)) - epoch_us(min(fetched_at))) // 1000 AS wall_ms, max(ns) AS max_ns,
  list(ns ORDER BY ns)[floor(count(*) * 0.5)::INT + 1] AS p50_ns, list(ns ORDER BY ns)[floor(count(*) * 0.99)::INT + 1] AS p99_ns FROM (SELECT DISTINCT ON (fetch_id) *, fetch_duration_ms * 1000000 AS ns FROM fetch_results) WHERE content_type IS NOT NULL GROUP BY content_type)"""


def _bench(spark, d) -> DataFrame:
    f = table(spark, d, "fetch_results").where(F.col("content_type").isNotNull()).select("fetch_id", F.col("content_type").alias("bench"), (F.col("fetch_duration_ms") * 1_000_000).alias("ns"), F.col("error_message").isNotNull().alias("failed"), "fetched_at").dropDuplicates(["fetch_id"])
    wall = F.floor((F.unix_micros(F.max("fetched_at")) - F.unix_micros(F.min("fetched_at"))) / 1000)
    return metrics.bench_results(f, "bench", "ns", "failed", wall)


@query("bench_results", f"SELECT bench, n_ops, n_errors, wall_ms, max_ns, p50_ns, p99_ns, round(n_ops / greatest(0.001, wall_ms / 1000.0), 9) AS per_second FROM {_BENCH}")
def bench_results(spark, d):
    return _bench(spark, d).withColumn("per_second", F.round("per_second", 9))


@query("bench_summary", f"SELECT bench, printf('%s: %d ops in %d ms → %.0f ops/s | p50=%dµs p99=%dµs max=%dµs | %d errors', bench, n_ops, wall_ms, n_ops / greatest(0.001, wall_ms / 1000.0), p50_ns // 1000, p99_ns // 1000, max_ns // 1000, n_errors) AS summary FROM {_BENCH}")
def bench_summary(spark, d):
    return metrics.bench_summary(_bench(spark, d), "bench")


# --- Importance and recrawl ----------------------------------------------------


@query("opic_seeded", f"SELECT cash, history, count(*) AS n FROM (SELECT url, cash, history FROM ({core._OPIC}) UNION ALL SELECT DISTINCT value, 1.0, 0.0 FROM {core._PAGE_URLS} WHERE value IS NOT NULL AND value NOT IN (SELECT url FROM ({core._OPIC}))) GROUP BY cash, history")
def opic_seeded(spark, d):
    pages = table(spark, d, "parsed_documents").select(url.present(url.canon_url(F.col("url"))).alias("url"))
    return graph.seed(core._opic(spark, d), pages).groupBy("cash", "history").agg(F.count("*").alias("n"))


@query("recrawl_registered", f"SELECT n_fetches, count(*) AS n, min(next_ms) AS least_ms FROM (SELECT url, n_fetches, next_ms FROM {core._RECRAWL} UNION ALL SELECT DISTINCT value, 0, {NOW_MS}::BIGINT + 3600000 FROM {core._PAGE_URLS} WHERE value IS NOT NULL AND value NOT IN (SELECT url FROM {core._RECRAWL})) GROUP BY n_fetches")
def recrawl_registered(spark, d):
    pages = table(spark, d, "parsed_documents").select(url.present(url.canon_url(F.col("url"))).alias("url"))
    return folds.register_recrawls(core._recrawl(spark, d), pages, NOW_MS).groupBy("n_fetches").agg(F.count("*").alias("n"), F.min("next_ms").alias("least_ms"))


# --- Members and forwarding ----------------------------------------------------

_MEMBERS = "(SELECT source_agent AS agent_id, count(*)::INTEGER AS generation, CASE count(*) % 3 WHEN 0 THEN 'ALIVE' WHEN 1 THEN 'SUSPECT' ELSE 'DEAD' END AS status, epoch_us(max(emitted_at)) // 1000 AS heartbeat_ms FROM forwarding_batches WHERE source_agent IS NOT NULL GROUP BY source_agent)"


def _members(spark, d) -> DataFrame:
    """An agent's batches stand for its generation and status."""
    b = table(spark, d, "forwarding_batches").where(F.col("source_agent").isNotNull()).groupBy(F.col("source_agent").alias("agent_id")).agg(F.count("*").cast("int").alias("generation"), F.unix_millis(F.max("emitted_at")).alias("heartbeat_ms"))
    n = F.col("generation") % 3
    return b.select("agent_id", "generation", F.when(n == 0, "ALIVE").when(n == 1, "SUSPECT").otherwise("DEAD").alias("status"), "heartbeat_ms")


@query("membership_status", f"SELECT * FROM {_MEMBERS} WHERE status = 'ALIVE'")
def membership_status(spark, d):
    return routing.with_status(_members(spark, d), "ALIVE")


@query("membership_heartbeat", f"SELECT agent_id, generation, status, CASE WHEN agent_id = 'agent-01' THEN {NOW_MS} ELSE heartbeat_ms END::BIGINT AS heartbeat_ms FROM {_MEMBERS}")
def membership_heartbeat(spark, d):
    return routing.heartbeat(_members(spark, d), "agent-01", NOW_MS)


@query("membership_anchor", f"SELECT * FROM {_MEMBERS} WHERE agent_id <> 'agent-01'")
def membership_anchor(spark, d):
    """Put twice, the older snapshot last, and one agent removed."""
    members = _members(spark, d)
    older = members.withColumn("generation", F.col("generation") - 1)
    return routing.anchor_remove(routing.merge_members(members, older), ["agent-01"])


@query("hot_policies_left", "SELECT host, owning_agent FROM hot_host_policies WHERE NOT (lower(trim(host, ' ' || chr(9) || chr(10) || chr(13))) IN ('videonest.example')) OR host IS NULL")
def hot_policies_left(spark, d):
    return routing.remove_policies(table(spark, d, "hot_host_policies"), ["videonest.example"]).select("host", "owning_agent")


@query("forward_inbox", "SELECT target_agent, count(*) AS n_messages, sum(coalesce(len(urls), 0))::BIGINT AS n_urls FROM forwarding_batches WHERE target_agent IS NOT NULL GROUP BY target_agent")
def forward_inbox(spark, d):
    return routing.inbox(table(spark, d, "forwarding_batches"))


@query("forward_left", "SELECT target_agent, count(*) AS n_messages FROM forwarding_batches WHERE target_agent IS DISTINCT FROM (SELECT min(target_agent) FROM forwarding_batches) GROUP BY target_agent")
def forward_left(spark, d):
    b = table(spark, d, "forwarding_batches")
    _, left = routing.drain(b, b.agg(F.min("target_agent")).first()[0])
    return left.groupBy("target_agent").agg(F.count("*").alias("n_messages"))


@query(
    "stream_forward",
    """WITH r AS (SELECT target_agent AS target, delivery_id AS seq, epoch_us(delivered_at) // 1000 AS at_ms FROM forwarding_batches WHERE target_agent IS NOT NULL AND delivered_at IS NOT NULL),
s AS (SELECT target, list_reduce(list_prepend({'no': 0::BIGINT, 'first': NULL::BIGINT, 'n': 0::BIGINT, 't': 0::BIGINT, 'out': []::BIGINT[]}, list({'no': 0::BIGINT, 'first': NULL::BIGINT, 'n': 0::BIGINT, 't': at_ms, 'out': []::BIGINT[]} ORDER BY at_ms, seq)),
  lambda a, b: CASE WHEN a.n > 0 AND b.t - a.first >= 3600000 THEN {'no': a.no + 1, 'first': b.t, 'n': 1::BIGINT, 't': b.t, 'out': list_append(a.out, a.n)}
    WHEN a.n + 1 >= 20 THEN {'no': a.no + 1, 'first': NULL::BIGINT, 'n': 0::BIGINT, 't': b.t, 'out': list_append(a.out, a.n + 1)}
    ELSE {'no': a.no, 'first': coalesce(a.first, b.t), 'n': a.n + 1, 't': b.t, 'out': a.out} END) AS x FROM r GROUP BY target)
SELECT target, (unnest(range(len(x.out))))::BIGINT AS batch_no, unnest(x.out) AS n_urls FROM s""",
)
def stream_forward(spark, d):
    """Batches of 20 messages, or of an hour; what is not due at the end stays in the state."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("delivery_id", T.LongType()), T.StructField("target_agent", T.StringType()), T.StructField("delivered_at", T.TimestampType())])
    arriving = parquet_stream(spark, f"{d}/forwarding_batches.parquet", schema, 1000).where(F.col("target_agent").isNotNull() & F.col("delivered_at").isNotNull())
    rows = arriving.select(F.col("target_agent").alias("target"), F.unix_millis("delivered_at").alias("at_ms"), F.col("delivery_id").alias("seq"), F.col("delivery_id").cast("string").alias("url"))
    return keyed.run_to_files(keyed.forward_stream(rows, 20, 3_600_000), "forwarded").select("target", "batch_no", F.size("urls").cast("bigint").alias("n_urls"))


# --- Fingerprints --------------------------------------------------------------

_LANES = "unnest([{'i': 0, 'v': u & 65535}, {'i': 1, 'v': (u >> 16) & 65535}, {'i': 2, 'v': (u >> 32) & 65535}, {'i': 3, 'v': (u >> 48) & 65535}])"
_LANED = f"(SELECT fp, {_LANES} AS lane FROM (SELECT fp, CASE WHEN fp < 0 THEN (fp::HUGEINT + 18446744073709551616)::UBIGINT ELSE fp::UBIGINT END AS u FROM {core._FPS}))"


@query("lane_candidates", f"SELECT DISTINCT a.fp AS fp, b.fp AS candidate FROM {_LANED} a JOIN {_LANED} b USING (lane) WHERE a.fp <> b.fp")
def lane_candidates(spark, d):
    fps = core._fingerprints(spark, d)
    return simhash.lane_candidates(fps, fps, 3)


@query("near_dup_checks", f"SELECT fp, candidate, bit_count(xor(fp, candidate)) <= 3 AS is_near FROM ({SQL['lane_candidates']})")
def near_dup_checks(spark, d):
    return lane_candidates(spark, d).select("fp", "candidate", simhash.is_near_duplicate(F.col("fp"), F.col("candidate"), 3).alias("is_near"))


# --- Archive -------------------------------------------------------------------


@query("http_dates", "SELECT DISTINCT strftime(last_modified AT TIME ZONE 'UTC', '%a, %-d %b %Y %H:%M:%S GMT') AS header, epoch_us(last_modified) // 1000000 AS parsed_s FROM fetch_results WHERE last_modified IS NOT NULL")
def http_dates(spark, d):
    f = table(spark, d, "fetch_results").where(F.col("last_modified").isNotNull()).select(codec.format_http_date(F.col("last_modified")).alias("header")).distinct()
    return f.select("header", F.unix_seconds(codec.http_date(F.col("header"))).alias("parsed_s"))


@query("cdxj_index", f"SELECT line FROM ({core.SQL['cdxj_lines']})")
def cdxj_index(spark, d):
    """The sorted index as written to the shared folder."""
    path = fresh_path(spark, "cdxj")
    archive.write_sorted_index(table(spark, d, "cdxj_entries"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("cdxj_appended", f"SELECT line, count(*) AS n FROM (SELECT line FROM ({core.SQL['cdxj_lines']}) UNION ALL SELECT line FROM ({core.SQL['cdxj_lines']})) GROUP BY line")
def cdxj_appended(spark, d):
    path = fresh_path(spark, "cdxj-log")
    for _ in range(2):
        archive.append_index(table(spark, d, "cdxj_entries"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


_UUID = "'00000000-0000-4000-8000-' || lpad(fetch_id::VARCHAR, 12, '0')"
_ASK = "encode('GET ' || value || ' HTTP/1.1' || crlf || crlf)"
_REQUEST = f"""encode('WARC/1.1' || crlf || 'WARC-Type: request' || crlf || 'WARC-Target-URI: ' || value || crlf || 'WARC-Date: ' || {core._duck_instant('fetched_at')} || crlf || 'WARC-Record-ID: <urn:uuid:' || {_UUID} || '>' || crlf
  || 'Content-Type: application/http; msgtype=request' || crlf || 'Content-Length: ' || octet_length({_ASK}) || crlf || 'WARC-Payload-Digest: sha1:' || sha1({_ASK}) || crlf || 'WARC-Block-Digest: sha1:' || sha1({_ASK}) || crlf
  || 'WARC-Concurrent-To: <urn:uuid:' || {_UUID} || '>' || crlf || crlf) || {_ASK} || encode(crlf || crlf)"""


@query("warc_requests", f"SELECT fetch_id, sha256(record) AS sha256 FROM (SELECT DISTINCT ON (fetch_id) fetch_id, {_REQUEST} AS record FROM (SELECT *, chr(13) || chr(10) AS crlf FROM {url_table('fetch_results', 'url', 'fetch_id, fetched_at')}) WHERE value IS NOT NULL AND fetched_at IS NOT NULL)")
def warc_requests(spark, d):
    f = table(spark, d, "fetch_results").where(F.col("fetched_at").isNotNull()).select("fetch_id", "url", "fetched_at").dropDuplicates(["fetch_id"]).select("fetch_id", "fetched_at", url.present(url.canon_url(F.col("url"))).alias("value"))
    record_id = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("fetch_id").cast("string"), 12, "0"))
    payload = F.encode(F.concat(F.lit("GET "), F.col("value"), F.lit(" HTTP/1.1\r\n\r\n")), "US-ASCII")
    extra = F.create_map(F.lit("WARC-Concurrent-To"), F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">")))
    return f.select("fetch_id", F.sha2(archive.warc_record("request", F.col("value"), F.col("fetched_at"), record_id, payload, extra), 256).alias("sha256"))


@query(
    "warc_files",
    f"""WITH z AS (SELECT fetch_id % 4 AS part, fetch_id AS k, octet_length(record) AS z FROM (SELECT DISTINCT ON (fetch_id) fetch_id, {core._RECORD} AS record FROM (SELECT *, chr(13) || chr(10) AS crlf FROM {url_table('fetch_results', 'final_url', 'fetch_id, body, fetched_at')} WHERE body IS NOT NULL)) WHERE record IS NOT NULL),
s AS (SELECT part, list_reduce(list_prepend({{'n': 0::BIGINT, 'u': 0::BIGINT, 'z': 0::BIGINT, 'out': []::STRUCT(n BIGINT, z BIGINT)[]}}, list({{'n': 0::BIGINT, 'u': 0::BIGINT, 'z': z::BIGINT, 'out': []::STRUCT(n BIGINT, z BIGINT)[]}} ORDER BY k)),
  lambda a, b: CASE WHEN a.n = 0 OR a.u + b.z > 100000 THEN {{'n': a.n + 1, 'u': b.z, 'z': b.z, 'out': list_append(a.out, {{'n': a.n + 1, 'z': b.z}})}} ELSE {{'n': a.n, 'u': a.u + b.z, 'z': b.z, 'out': list_append(a.out, {{'n': a.n, 'z': b.z}})}} END) AS x FROM z GROUP BY part)
SELECT 'crawl-20300201-000000-' || part || '-' || lpad(o.n::VARCHAR, 5, '0') || '.warc' AS file, count(*) AS n_records, sum(o.z)::BIGINT AS n_bytes FROM s, unnest(x.out) u(o) GROUP BY part, o.n""",
)
def warc_files(spark, d):
    f = table(spark, d, "fetch_results").where(F.col("body").isNotNull()).select("fetch_id", "final_url", "body", "fetched_at").dropDuplicates(["fetch_id"])
    record_id = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("fetch_id").cast("string"), 12, "0"))
    record = archive.warc_record("response", url.canon_url(F.col("final_url")), F.col("fetched_at"), record_id, F.col("body"))
    records = f.select((F.col("fetch_id") % 4).alias("part"), F.col("fetch_id").alias("seq"), record.alias("record"))
    return archive.write_warc_files(records, fresh_path(spark, "warc"), "crawl", "20300201-000000", 100_000)


@query("render_requests", f"SELECT reason, count(*) AS n FROM ({core.SQL['page_render_reason']}) WHERE reason IS NOT NULL GROUP BY reason")
def render_requests(spark, d):
    return fetch.render_counts(fetch.as_rendered(core.page_render_reason(spark, d)))
