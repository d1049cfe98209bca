from __future__ import annotations

import http.server
import threading
from pathlib import Path

from pyspark.sql import functions as F

from loomcrawl.functions import codec
from loomcrawl.operators import control, dns, folds, frontier, graph, metrics, robots, routing
from loomcrawl.sources import archive, fetch

ROBOTS = """Sitemap: http://a.test/map.xml
Crawl-delay: 99
User-agent: One
User-agent: two
Crawl-delay: 4
crawl-delay: 7
Crawl-delay: soon
Disallow: /x

User-agent: one
Crawl-delay: 30
sitemap: http://a.test/more.xml
User-agent: *
Allow: /
"""


def test_delays_and_sitemaps_of_a_file(spark):
    df = spark.createDataFrame([("a.test", ROBOTS), ("b.test", None), ("c.test", "")], "host string, body string")
    got = {(r.host, r.agent): r.delay_s for r in robots.crawl_delays(df).collect()}
    # The sitemap line ends no run of agents, so the star belongs to no new group's delay.
    assert got == {("a.test", "one"): 7, ("a.test", "two"): 7}
    assert sorted(r.sitemap for r in robots.sitemaps(df).collect()) == ["http://a.test/map.xml", "http://a.test/more.xml"]
    assert robots.crawl_delays(df.limit(0)).count() == 0


def test_robots_cache_serves_stale_rules_once(spark):
    day = 86_400_000
    cache = spark.createDataFrame([("a", "FETCHED", 0, day), ("b", "STALE_SERVE", 0, day), ("c", "FETCHED", 0, day)], "host string, source string, fetched_ms bigint, expires_ms bigint")
    answers = spark.createDataFrame([("a", 503, None), ("b", 503, None), ("d", 404, None)], "host string, status int, error string")
    got = {r.host: (r.source, r.fetched_ms, r.expires_ms) for r in robots.refresh(cache, answers, 2 * day).collect()}
    assert got == {"a": ("STALE_SERVE", 0, 2 * day + 3_600_000), "b": ("DISALLOW_ALL_5XX", 2 * day, 2 * day + 3_600_000), "c": ("FETCHED", 0, day), "d": ("ALLOW_ALL_4XX", 2 * day, 3 * day)}
    assert [r.host for r in robots.fresh(cache, day).orderBy("host").collect()] == ["a", "b", "c"] and robots.fresh(cache, day + 1).count() == 0
    assert [r.host for r in robots.peek(cache, spark.createDataFrame([("b",), ("x",)], "host string")).collect()] == ["b"]


def test_resolver(spark):
    now = 1_000_000
    cache = spark.createDataFrame([("a", "IPV4", "HIT", ["1.1.1.1"], None, now + 1), ("b", "IPV4", "MISS", None, "NXDOMAIN", now + 5), ("c", "IPV4", "HIT", ["1.1.1.1"], None, now)], dns.CACHE)
    asked = spark.createDataFrame([(1, "a", "IPV4", now), (2, "b", "IPV4", now), (3, "c", "IPV4", now), (4, "c", "IPV4", now), (5, "a", "IPV6", now), (6, "c", "IPV4", now)], "seq bigint, host string, family string, now_ms bigint")
    verdicts = dns.lookup_verdicts(asked, cache)
    assert [r.verdict for r in verdicts.orderBy("seq").collect()] == ["POSITIVE_HIT", "NEGATIVE_HIT", "UPSTREAM", "COALESCED", "UPSTREAM", "COALESCED"]
    upstream = spark.createDataFrame([("c", "IPV4", ["2.2.2.2", "1.1.1.1"], None, now)], "host string, family string, ips array<string>, error string, expires_ms bigint")
    after = dns.refreshed(cache, verdicts, upstream)
    got = {(r.host, r.family): (r.kind, r.error, r.expires_ms - now) for r in after.collect()}
    assert got == {("a", "IPV4"): ("HIT", None, 1), ("b", "IPV4"): ("MISS", "NXDOMAIN", 5), ("c", "IPV4"): ("HIT", None, 60_000), ("a", "IPV6"): ("MISS", "TIMEOUT", 300_000)}
    gone = dns.invalidate(after, spark.createDataFrame([("c",)], "host string"))
    assert {tuple(r) for r in dns.hosts_sharing(gone).collect()} == {("1.1.1.1", "a")}
    row = dns.stats(verdicts, after).first()
    assert (row.n_lookups, row.n_upstream, row.n_coalesced, row.saved_ratio) == (6, 2, 2, 0.5)
    assert dns.stats(verdicts.limit(0), after.limit(0)).first().hit_ratio == 0.0


EVENTS = "seq bigint, occurred_at timestamp, actor string, action string, subject string, detail string"


def test_control_state(spark):
    rows = [(1, "quarantine", "a.test"), (2, "quarantine", "b.test"), (3, "release", "a.test"), (4, "takedown", "http://c.test/x"), (5, "scope", None), (6, "pause", "crawl"), (7, "quarantine", None)]
    e = spark.createDataFrame([(s, None, "me", a, x, f"d{s}") for s, a, x in rows], EVENTS)
    urls = spark.createDataFrame([("http://a.test/", "a.test"), ("http://b.test/", "b.test"), ("http://c.test/x", "c.test"), ("http://c.test/y", "c.test")], "url string, host string")
    assert sorted(r.url for r in control.admitted(urls, e).collect()) == ["http://a.test/", "http://c.test/y"]
    assert control.is_paused(e) and not control.is_paused(e.limit(0)) and not control.is_paused(e.where("action <> 'pause'"))
    assert control.current_scope(e) == "d5" and control.current_scope(e.limit(0)) is None
    assert control.scope_history(e).count() == 1 and control.last_action(e).first().n_seeds == 0


def test_frontier_states(spark):
    entries = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "host string")
    backoff = spark.createDataFrame([("a", 4.0, 2, None, 500), ("z", 1.0, 0, 9, 10)], "host string, backoff double, errors int, last_success_ms bigint, next_fetch_ms bigint")
    held = spark.createDataFrame([("b",)], "host string")
    delays = spark.createDataFrame([("a", 2500), ("b", 0), ("z", -5)], "host string, delay_ms bigint")
    states = frontier.host_states(entries, backoff, held, delays)
    got = {r.host: (r.next_fetch_ms, r.crawl_delay_ms, r.depth, r.quarantined) for r in states.collect()}
    assert got == {"a": (500, 2500, 2, False), "b": (0, 1000, 1, True), "z": (10, 1000, 0, False)}
    assert [r.host for r in frontier.claimable(states, 500).collect()] == ["a"] and frontier.claimable(states, 499).count() == 0
    freed = frontier.set_quarantine(states, held, False)
    assert [r.host for r in frontier.claimable(freed, 0).collect()] == ["b"]
    changed = frontier.change_depth(states, spark.createDataFrame([("a", -5), ("z", 2)], "host string, change bigint"))
    assert {r.host: r.depth for r in changed.collect()} == {"a": 0, "b": 1, "z": 2}


def test_registration_keeps_what_is_known(spark):
    state = spark.createDataFrame([("a", 0.5, 2.0)], "url string, cash double, history double")
    urls = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "url string")
    assert {tuple(r) for r in graph.seed(state, urls).collect()} == {("a", 0.5, 2.0), ("b", 1.0, 0.0)}
    fetched = folds.recrawl_state(spark.createDataFrame([("a", 1000, 1, False)], "url string, at_ms bigint, seq bigint, changed boolean"))
    got = {r.url: (r.rate, r.n_fetches, r.next_ms) for r in folds.register_recrawls(fetched, urls, 0).collect()}
    assert got == {"a": (0.7, 1, 1000 + 7_200_000), "b": (1.0, 0, 3_600_000)}


def test_bench_percentiles(spark):
    rows = [("x", n, n == 3) for n in (5, 1, 3, 2, 4)] + [("y", 7, False)]
    got = {r.bench: r for r in metrics.bench_results(spark.createDataFrame(rows, "bench string, ns bigint, failed boolean"), "bench", "ns", "failed", F.lit(0)).collect()}
    assert (got["x"].p50_ns, got["x"].p99_ns, got["x"].max_ns, got["x"].n_errors, got["x"].per_second) == (3, 5, 5, 1, 5000.0)
    assert (got["y"].p50_ns, got["y"].p99_ns) == (7, 7)


def test_members(spark):
    members = spark.createDataFrame([("a", 1, "ALIVE", 5), ("b", 1, "DEAD", 5)], "agent_id string, generation int, status string, heartbeat_ms bigint")
    assert [r.agent_id for r in routing.with_status(members, "DEAD").collect()] == ["b"]
    assert {r.agent_id: r.heartbeat_ms for r in routing.heartbeat(members, "a", 9).collect()} == {"a": 9, "b": 5}
    assert routing.anchor_get(members, "b").count() == 1 and routing.anchor_remove(members, ["b"]).count() == 1 and routing.anchor_remove(members, []).count() == 2


def test_http_dates(spark):
    rows = [("Tue, 3 Jun 2008 11:05:30 GMT", 1212491130), ("Tue, 03 Jun 2008 11:05:30 GMT", 1212491130), ("2008-06-03", None), ("", None), (None, None), ("Tue, 33 Jun 2008 11:05:30 GMT", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = df.select("i", F.unix_seconds(codec.http_date(F.col("t"))).alias("s"), codec.format_http_date(codec.http_date(F.col("t"))).alias("back")).orderBy("i").collect()
    assert [r.s for r in got] == [s for _, s in rows] and got[1].back == rows[0][0]


def test_rolling_files_hold_the_records(spark, tmp_path):
    records = [(p, k, bytes([65 + k]) * (10 + 7 * k)) for p in (1, 2) for k in range(6)]
    df = spark.createDataFrame(records[::-1] + [(None, 1, b"x"), (1, 99, None)], "part int, seq int, record binary")
    files = archive.write_warc_files(df, f"file://{tmp_path}/warc", "w", "20300101-000000", 60).collect()
    assert sum(r.n_records for r in files) == 12 and sorted(p.name for p in Path(tmp_path / "warc").iterdir()) == sorted(r.file for r in files)
    for part in (1, 2):
        names = sorted(r.file for r in files if f"-{part}-" in r.file)
        assert b"".join((tmp_path / "warc" / n).read_bytes() for n in names) == b"".join(r for p, _, r in records if p == part)
        assert all((tmp_path / "warc" / n).stat().st_size <= 60 for n in names) and names[0].endswith("-00001.warc")


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response({"/loop": 302, "/gone": 404, "/bare": 302}.get(self.path, 302 if self.path.startswith("/hop") else 304 if self.headers.get("If-None-Match") == '"x"' else 200))
        if self.path == "/loop":
            self.send_header("Location", "/loop")
        if self.path.startswith("/hop"):
            self.send_header("Location", f"/hop{int(self.path[4:]) - 1}" if self.path != "/hop1" else "/end")
        self.end_headers()
        if self.path in ("/end", "/big"):
            self.wfile.write(b"y" * (5000 if self.path == "/big" else 3))

    def log_message(self, *_):
        pass


def test_http_fetcher(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    settings = fetch.FetchSettings(max_body_bytes=1000)
    got = lambda path, **k: fetch.http_fetcher(base + path, settings, **k)
    assert (got("/hop3")["body"], got("/hop3")["redirect_hop_count"], got("/hop3")["final_url"]) == (b"yyy", 3, base + "/end")
    assert (got("/loop")["http_status"], got("/loop")["redirect_hop_count"]) == (0, 6)
    assert got("/bare")["http_status"] == 302 and got("/end", etag='"x"')["http_status"] == 304 and len(got("/big")["body"]) == 1000
    urls = spark.createDataFrame([(base + "/end",), (base + "/gone",), (base + "/loop",), ("http://127.0.0.1:1/",)], "url string")
    outcomes = {r.url.rsplit("/", 1)[1]: r.outcome for r in fetch.fetch_with(urls, fetch.http_fetcher, settings).collect()}
    server.shutdown()
    assert outcomes == {"end": "SUCCESS_200", "gone": "CLIENT_ERROR_4XX", "loop": "REDIRECT_3XX", "": "NETWORK_ERROR"}
