from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomcrawl.functions.codec import cdxj_line
from loomcrawl.operators import dedup, folds, graph, metrics, robots, routing, skew
from loomcrawl.sources import archive

ENTRY = "entry_id bigint, host_name string, url string, priority_class string, discovered_at_epoch_ms bigint"


def brute_figures(rows):
    out = {}
    for _, host, _, kind, at in rows:
        h = host.strip().lower().rstrip(".") if host and host.strip() else None
        n, oldest, high = out.get(h, (0, None, 0))
        out[h] = (n + 1, at if oldest is None else oldest if at is None else min(oldest, at), high + (kind == "HIGH_OPIC"))
    return out


def test_host_figures_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Hot.example", "hot.example.", " hot.example", f"h{i}.test", None]), f"u{i}", rng.choice(["HIGH_OPIC", "LOW_OPIC", "odd", None]), rng.choice([None, rng.randrange(10**6)])) for i in range(3000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, ENTRY).withColumn("__salt", F.lit(1)).withColumn("n_rows", F.lit("x")).withColumn("host", F.lit("clash"))
    figures = skew.host_figures(df)
    got = {r.host: (r.n_rows, r.oldest_ms, r.n_high_opic) for r in figures.collect()}
    assert got == brute_figures(rows)
    assert sum(x[0] for x in got.values()) == len(rows)
    assert [r.host for r in skew.frequent_hosts(figures).collect()] == ["hot.example"]
    assert skew.heavy_keys(df.select(F.lower("host_name").alias("k")), "k", 0.1)


def test_host_figures_empty_and_ties(spark):
    none = spark.createDataFrame([], ENTRY)
    assert skew.host_figures(none).count() == 0
    assert skew.frequent_hosts(skew.host_figures(none)).count() == 0
    even = spark.createDataFrame([(i, f"h{i % 50}.test", "", "", 1) for i in range(100)], ENTRY)
    assert skew.frequent_hosts(skew.host_figures(even)).count() == 50  # exactly 2 per cent each
    policies = spark.createDataFrame([("H1.test ", "a", 2, "2030-01-01"), ("h1.test.", "b", 3, "2030-01-02"), (None, "c", 2, "2030-01-01")], "host string, owning_agent string, split_factor int, configured_at string")
    got = {r.host: r.policy_agent for r in skew.with_policy(skew.host_figures(even), policies).collect()}
    assert got["h1.test"] == "b" and got["h2.test"] is None


def test_backoff_steps_compose(spark):
    rng = random.Random(5)
    kinds = ["SUCCESS_200", "SERVER_ERROR_5XX", "CLIENT_ERROR_4XX", "TIMEOUT", "NOT_MODIFIED_304", None]
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(500), i, rng.choice(kinds)) for i in range(2000)]
    got = {r.host: r for r in folds.host_backoff(spark.createDataFrame(rows, "host string, at_ms bigint, seq bigint, outcome string")).collect()}
    for host in ("hot", "b"):
        x, errors, ok, last = 1.0, 0, None, 0
        for _, at, _, kind in sorted((r for r in rows if r[0] == host), key=lambda r: (r[1], r[2])):
            if kind in ("SERVER_ERROR_5XX", "TIMEOUT"):
                x, errors = min(64.0, x * 2), errors + 1
            elif kind in ("SUCCESS_200", "NOT_MODIFIED_304"):
                x, errors, ok = max(1.0, x * 0.95), 0, at
            last = at
        assert got[host].backoff == pytest.approx(x) and (got[host].errors, got[host].last_success_ms) == (errors, ok)
        assert got[host].next_fetch_ms == last + int(1e9 * x) // 1_000_000
    assert set(got) == {"hot", "b"}


def test_recrawl_intervals(spark):
    hour = 3_600_000
    rows = [("changed", 0, 1, True), ("same", 0, 2, False)] + [("often", i, i, True) for i in range(30)] + [("never", i, i, False) for i in range(30)]
    got = {r.url: r for r in folds.recrawl_state(spark.createDataFrame(rows, "url string, at_ms bigint, seq bigint, changed boolean")).collect()}
    assert (got["changed"].interval_ms, got["same"].interval_ms) == (hour // 2, 2 * hour)
    assert (got["often"].interval_ms, got["never"].interval_ms) == (900_000, 30 * 24 * hour)


def test_audit_chain_and_tampering(spark):
    events = spark.createDataFrame([("a", i, f"d{i}") for i in range(5)] + [("b", 1, "x")], "log string, seq bigint, digest string")
    chain = folds.audit_chain(events).cache()
    assert {r["log"]: r["index"] for r in folds.first_tampered(chain).collect()} == {"a": -1, "b": -1}
    bad = chain.withColumn("digest", F.when((F.col("log") == "a") & (F.col("seq") == 3), "forged").otherwise(F.col("digest")))
    assert {r["log"]: r["index"] for r in folds.first_tampered(bad).collect()} == {"a": 3, "b": -1}


def test_rolling_files(spark):
    rows = [("p", i, s) for i, s in enumerate([60, 30, 20, 100, 150, 10])]
    got = [r.file_no for r in folds.roll_files(spark.createDataFrame(rows, "part string, seq bigint, size bigint"), 100).orderBy("seq").collect()]
    assert got == [0, 0, 1, 2, 3, 4]


def test_opic_against_one_by_one(spark):
    empty = spark.createDataFrame([], "url string, cash double, history double")
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "source string, target string")
    got = {r.url: (r.cash, r.history) for r in graph.opic_round(empty, edges.select(F.col("source").alias("url")), edges).collect()}
    assert got == {"a": (0.0, 1.0), "b": (0.5, 0.0), "c": (0.5, 0.0)}
    twice = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", None)], "source string, target string")
    got = {r.url: round(r.cash, 6) for r in graph.opic_round(empty, twice.select(F.col("source").alias("url")), twice).collect()}
    assert got == {"a": 0.333333, "b": 0.666667}
    alone = graph.opic_round(empty, spark.createDataFrame([("z",)], "url string"), edges.limit(0)).first()
    assert (alone.cash, alone.history) == (0.0, 1.0)


ROBOTS = {
    "1": "User-agent: *\nDisallow: /private/",
    "2": "User-agent: *\nDisallow:",
    "3": "",
    "4": "User-agent: MyBot\nDisallow: /admin/",
    "5": "User-agent: *\nDisallow: /a/\nAllow: /a/b/",
    "6": "User-agent: *\nDisallow: /\n\nUser-agent: MyBot\nDisallow: /private/",
    "7": "User-agent: MyBot\nDisallow: /a/\nUser-agent: MyBot\nDisallow: /b/",
    "8": "User-agent: BotA\nUser-agent: BotB\nSitemap: x\nDisallow: /private/ # no",
    "9": "Disallow: /x\nUser-agent: *\nAllow: /p\nDisallow: /p",
}


def test_robots_verdicts(spark):
    asks = [("1", "x", "/private/s", "D"), ("1", "x", "/public", "A"), ("2", "x", "/any", "A"), ("3", "x", "/any", "A"), ("4", "mybot", "/admin/u", "D"), ("4", "other", "/admin/u", "A"), ("5", "x", "/a/b/page", "A"), ("5", "x", "/a/c/page", "D"), ("6", "mybot", "/any", "A"), ("6", "other", "/any", "D"), ("7", "mybot", "/a/x", "D"), ("7", "mybot", "/b/x", "D"), ("7", "mybot", "/c/x", "A"), ("8", "bota", "/private/x", "D"), ("8", "botb", "/private/x", "D"), ("8", "botc", "/private/x", "A"), ("9", "x", "/p", "A"), ("9", "x", "/x", "A")]
    body = spark.createDataFrame(list(ROBOTS.items()) + [("0", None)], "host string, body string")
    probes = spark.createDataFrame([a[:3] for a in asks], "host string, agent string, path string")
    got = {(r.host, r.agent, r.path): r.verdict[0] for r in robots.verdicts(probes, robots.rule_table(body), robots.agent_table(body)).collect()}
    assert got == {a[:3]: a[3] for a in asks}


def test_scope(spark):
    df = spark.createDataFrame([("foo.example.com",), ("example.com",), ("malicious-example.com",), ("bad.example.com",)], "h string")
    got = {r.h: r.v for r in df.select("h", robots.scope_verdict(F.col("h"), ["*.example.com"], ["bad.example.com"]).alias("v")).collect()}
    assert got == {"foo.example.com": "ALLOW", "example.com": "DENY", "malicious-example.com": "DENY", "bad.example.com": "DENY"}


def test_ring_values(spark):
    agents = [f"agent-{i}" for i in range(10)]
    hosts = spark.range(10_000).select(F.concat(F.lit("host"), "id", F.lit(".com")).alias("h"))
    load = {r.a: r.n for r in hosts.select(routing.ring_owner(F.col("h"), agents, 50).alias("a")).groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert [load[a] for a in agents] == [989, 1180, 985, 1105, 996, 1150, 896, 961, 850, 888]
    five = [f"agent-{i}" for i in range(5)]
    one = spark.createDataFrame([("example.com",)], "h string")
    assert one.select(routing.ring_owner(F.col("h"), five, 200).alias("a")).first().a == "agent-2"
    owners = one.select(routing.ring_owners(F.col("h"), five, 200, 9).alias("a")).first().a
    assert owners[0] == "agent-2" and len(set(owners)) == 5
    urls = spark.range(1000).select(F.concat(F.lit("http://youtube.com/watch?v="), "id").alias("u"), F.array(F.lit("agent-3"), F.lit("agent-7"), F.lit("agent-19")).alias("p"))
    split = {r.a: r.n for r in urls.select(routing.hot_executor(F.col("u"), F.col("p"), F.lit(3)).alias("a")).groupBy("a").agg(F.count("*").alias("n")).collect()}
    assert split == {"agent-3": 335, "agent-7": 345, "agent-19": 320}


def test_bloom(spark):
    assert [dedup.bloom_size(*x) for x in ((10_000, 0.01), (10_000, 0.001), (1000, 0.01), (100, 0.05))] == [(95851, 7), (143776, 10), (9586, 7), (624, 4)]
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    bits = dedup.bloom_bits(keys, "k", 9586, 7).cache()
    assert dedup.bloom_probe(keys, bits, "k", 9586, 7).where("might_contain").count() == 500
    others = spark.range(500).select(F.concat(F.lit("x"), "id").alias("k"))
    assert dedup.bloom_probe(others, bits, "k", 9586, 7).where("might_contain").count() < 25


def test_verdicts_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, None), (3, 0, "b")], "d bigint, e int, key string")
    got = {(r.d, r.e): r.verdict for r in dedup.dedup_verdicts(rows, "key", ["d", "e"]).collect()}
    assert got == {(1, 0): "NEW", (1, 1): "DUPLICATE", (3, 0): "NEW"}


def test_queue_positions_across_slices(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "b"]), rng.randrange(20) * 1_000_000) for i in range(400)]
    got = {r.entry_id: r.position for r in graph.frontier_positions(spark.createDataFrame(rows, "entry_id bigint, host string, at bigint"), ["at", "entry_id"]).collect()}
    for host in ("hot", "b"):
        for k, r in enumerate(sorted((r for r in rows if r[1] == host), key=lambda r: (r[2], r[0]))):
            assert got[r[0]] == k + 1


def test_membership(spark):
    kind = "agent_id string, generation int, status string, heartbeat_ms bigint"
    known = spark.createDataFrame([("a", 5, "ALIVE", 0), ("b", 3, "DEAD", 0), ("c", 2, "ALIVE", 0)], kind)
    news = spark.createDataFrame([("a", 3, "DEAD", 1), ("b", 3, "ALIVE", 1), ("c", 2, "ALIVE", 1), ("d", 1, "ALIVE", 1)], kind)
    got = {r.agent_id: (r.status, r.heartbeat_ms) for r in routing.merge_members(known, news).collect()}
    assert got == {"a": ("ALIVE", 0), "b": ("DEAD", 0), "c": ("ALIVE", 0), "d": ("ALIVE", 1)}
    aged = {r.agent_id: r.status for r in routing.evaluate_liveness(known, 100_000, self_id="c").collect()}
    assert aged == {"a": "SUSPECT", "b": "DEAD", "c": "ALIVE"}


def test_timers(spark):
    df = spark.range(1, 101).select(F.lit("t").alias("k"), F.col("id").alias("v"), F.col("id").alias("at"))
    r = metrics.timer_percentiles(df, "k", "v", ["at"]).first()
    assert (r.n_samples, r.p50, r.p99, r.max) == (100, 51, 100, 100)


def test_archive_records_and_index(spark, tmp_path):
    df = spark.createDataFrame([("http://example.com/page?q=1", "2026-04-27 15:00:00", None, 200, "sha1:x", 10, 'f"\\', 42), ("http://a.org/", "2026-01-01 00:00:00", "t", 200, "d", 1, "f", 0), ("http://a.com/", "2026-01-02 00:00:00", "t", 200, "d", 1, "f", 0), ("bad", "2026-01-02 00:00:00", "t", 200, "d", 1, "f", 0)], "url string, captured_at string, mime_type string, http_status int, payload_digest string, payload_length bigint, warc_filename string, warc_offset bigint").withColumn("captured_at", F.to_timestamp("captured_at"))
    lines = [r.line for r in archive.index_lines(df).orderBy("surt").collect()]
    assert lines[1].startswith('com,example)/page?q=1 20260427150000 {"url": "http://example.com/page?q=1", "mime": null, "status": "200"')
    assert lines[1].endswith('"filename": "f\\"\\\\", "offset": "42"}')
    assert archive.write_sorted_index(df, str(tmp_path / "index")) == 3
    archive.append_index(df, str(tmp_path / "loose"))
    assert spark.read.text(str(tmp_path / "loose")).count() == 3
    record = archive.warc_record("response", F.lit("http://a.com/"), F.to_timestamp(F.lit("2026-01-02 00:00:00")), F.lit("id-1"), F.encode(F.lit("body"), "UTF-8"), F.create_map(F.lit("WARC-IP-Address"), F.lit("1.2.3.4")))
    raw = bytes(spark.range(1).select(record.alias("r")).first().r)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.com/\r\nWARC-Date: 2026-01-02T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:id-1>\r\n")
    assert raw.endswith(b"WARC-IP-Address: 1.2.3.4\r\n\r\nbody\r\n\r\n") and b"Content-Length: 4\r\n" in raw
    assert cdxj_line is not None


def test_redirect_chains(spark):
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(7)] + [("x", "y")], "source string, target string")
    start = spark.createDataFrame([("u0",), ("u5",), ("x",), ("z",)], "url string")
    got = {r.url: (r.final_url, r.hops) for r in archive.resolve_redirects(start, edges, 5).collect()}
    assert got == {"u0": (None, 6), "u5": ("u7", 2), "x": ("y", 1), "z": ("z", 0)}


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "host string, n int")
    archive.save_snapshot({"host_state": df}, str(tmp_path / "s"))
    archive.save_snapshot({"host_state": df}, str(tmp_path / "s"))
    assert archive.load_snapshot(spark, str(tmp_path / "s"), ["host_state"])["host_state"].collect() == df.collect()
