from __future__ import annotations

from pyspark.sql import functions as F

from loomcrawl import cli
from loomcrawl.operators import crawl, simulate
from loomcrawl.plans import core_queries
from loomcrawl.sources import fetch
from loomcrawl.streaming import keyed

SITE = {"/": ["/a", "/b", "/forbidden"], "/a": ["/b", "/c", "/a"], "/b": ["/c", "/"], "/c": [], "/forbidden": []}


def pages(spark):
    rows = [(f"http://site.test{p}", "".join(f'<a href="{x}">x</a>' for x in links).encode() + b"<p>text</p>", "text/html") for p, links in SITE.items()]
    return spark.createDataFrame(rows, "url string, body binary, content_type string")


def run(spark, seeds, cap=100):
    table = pages(spark)
    robots = spark.createDataFrame([("site.test", "User-agent: *\nDisallow: /forbidden")], "host string, body string")
    return crawl.crawl(spark.createDataFrame([(s,) for s in seeds], "url string"), lambda urls: fetch.fetch_from(urls, table), robots, cap)


def test_whole_site(spark):
    stats, tables = run(spark, ["HTTP://site.test"])
    assert (stats.fetched, stats.succeeded, stats.failed, stats.disallowed) == (4, 4, 0, 1)
    assert (stats.documents, stats.links, stats.deduplicated, stats.stop_reason) == (4, 8, 4, 0)
    assert tables["links"].count() == 8 and tables["documents"].count() == 4


def test_cap_and_forbidden_seed(spark):
    stats, _ = run(spark, ["http://site.test/"], 2)
    assert (stats.fetched, stats.stop_reason) == (2, 1)
    stats, _ = run(spark, ["http://site.test/forbidden", "not a url"])
    assert (stats.fetched, stats.disallowed, stats.succeeded) == (0, 1, 0)


def test_named_crawl_follows_a_chain_to_its_end(spark, tmp_path):
    urls = [f"http://chain.test/{k}" for k in range(6)]
    bodies = [f'<a href="/{k + 1}">on</a>'.encode() for k in range(5)] + [b"<p>end</p>"]
    tables = {
        "forwarding_batches": ([([(urls[0], None)],)], "urls array<struct<url: string, discovered_from_url: string>>"),
        "fetch_results": ([(u, b, "text/html") for u, b in zip(urls, bodies)], "final_url string, body binary, content_type string"),
        "documents": ([], "doc_id bigint, doc_type string, source string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    stats = core_queries.QUERIES["crawl_waves"](spark, str(tmp_path)).first()
    assert (stats.fetched, stats.succeeded, stats.links, stats.waves, stats.stop_reason) == (6, 6, 5, 6, 0)


def test_fetch_function_and_outcomes(spark):
    def fetcher(url, settings):
        if "slow" in url:
            raise TimeoutError("timed out")
        if "loop" in url:
            return {"http_status": 302, "redirect_hop_count": 6}
        if "down" in url:
            raise OSError("refused")
        return {"http_status": int(url.rsplit("/", 1)[1]), "body": b"x" * 50}

    urls = spark.createDataFrame([(f"http://a.test/{p}",) for p in ("200", "404", "429", "503", "304", "slow", "loop", "down")], "url string")
    got = {r.url.rsplit("/", 1)[1]: (r.outcome, r.http_status, r.body and len(r.body)) for r in fetch.fetch_with(urls, fetcher, fetch.FetchSettings(max_body_bytes=10)).collect()}
    assert got["200"] == ("SUCCESS_200", 200, 10) and got["404"] == ("CLIENT_ERROR_4XX", 404, None)
    assert [got[k][0] for k in ("429", "503", "304", "slow", "loop", "down")] == ["RATE_LIMITED_429", "SERVER_ERROR_5XX", "NOT_MODIFIED_304", "TIMEOUT", "REDIRECT_3XX", "NETWORK_ERROR"]
    assert got["loop"][1] == 0


def test_lossy_network_is_the_same_every_time(spark):
    sent = spark.range(1000).select(F.col("id").alias("m"), (F.col("id") * 10).alias("sent_at_ms"))
    net = simulate.send(sent, "m", 7, 0.5, 5, 50)
    again = simulate.send(sent.repartition(7), "m", 7, 0.5, 5, 50)
    assert sorted(net.collect()) == sorted(again.collect())
    t = simulate.traffic(net, 5000).first()
    assert 400 <= t.n_lost <= 600 and t.n_delivered + t.n_under_way + t.n_lost == t.n_sent == 1000
    assert simulate.delivered(net, 5000).count() == t.n_delivered


def stream_of(spark, tmp_path, rows, schema, per_file):
    path = str(tmp_path / "in")
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_of_claims(spark, tmp_path):
    rows = [("a", 0, 1, "enqueue", "u1", None), ("a", 0, 2, "enqueue", "u2", None), ("a", 0, 3, "claim", None, None), ("a", 500, 4, "claim", None, None), ("b", 0, 5, "enqueue", "v1", None), ("a", 600, 6, "verdict", None, "SERVER_ERROR_5XX"), ("a", 2000, 7, "claim", None, None), ("b", 0, 8, "claim", None, None), ("a", 2600, 9, "claim", None, None)]
    s = stream_of(spark, tmp_path, rows, "host string, at_ms bigint, seq bigint, kind string, url string, outcome string", 5)
    got = sorted(tuple(r) for r in keyed.drain(keyed.frontier_stream(s), "claims", str(tmp_path / "c1")).collect())
    assert got == [("a", "u1", 0, 1000), ("a", "u2", 2600, 2000), ("b", "v1", 0, 1000)]


def test_stream_of_grants_and_batches(spark, tmp_path):
    rows = [("h", t, i, f"u{i}") for i, t in enumerate([0, 10, 500, 1000, 1500, 2100])]
    schema = "host string, at_ms bigint, seq bigint, url string"
    s = stream_of(spark, tmp_path / "g", rows, schema, 2)
    got = [(r.seq, r.granted) for r in keyed.drain(keyed.politeness_stream(s), "grants", str(tmp_path / "c2")).orderBy("seq").collect()]
    assert got == [(0, True), (1, False), (2, False), (3, True), (4, False), (5, True)]
    rows = [("t", i, i, f"u{i}") for i in range(7)] + [("t", 100, 99, None)]
    s = stream_of(spark, tmp_path / "b", rows, "target string, at_ms bigint, seq bigint, url string", 3)
    got = [(r.batch_no, list(r.urls)) for r in keyed.drain(keyed.forward_stream(s, 5, 50), "batches", str(tmp_path / "c3")).orderBy("batch_no").collect()]
    assert got == [(0, [f"u{i}" for i in range(5)]), (1, ["u5", "u6"])]


def test_stream_of_new_urls(spark, tmp_path):
    rows = [(f"u{i % 10}",) for i in range(40)]
    s = stream_of(spark, tmp_path, rows, "url string", 15)
    assert keyed.drain(keyed.new_urls(s), "news", str(tmp_path / "c4")).count() == 10


def test_retries_end_with_dead_letters(spark):
    tried, dead = [], []
    each = keyed.deliver_with_retries(lambda df, attempt: (tried.append(attempt), df)[1], lambda df: dead.append(df.count()), 3)
    each(spark.range(3), 0)
    assert tried == [0, 1, 2, 3] and dead == [3]
    each = keyed.deliver_with_retries(lambda df, attempt: df.limit(0), lambda df: dead.append(9))
    each(spark.range(3), 1)
    assert dead == [3]


def test_commands(spark, tmp_path):
    said = []
    call = lambda *a: cli.main([str(tmp_path / "control"), *a], spark, said.append)
    assert call("seed", "HTTP://a.test", "http://b.test/x") == 0
    assert call("seed", "nonsense") == 64 and call("seed") == 64 and call("unknown") == 64
    assert call("quarantine", "A.test.") == 0 and call("quarantine", "b.test") == 0 and call("release", "b.test") == 0
    assert [r.host for r in cli.quarantined(cli.control(spark, str(tmp_path / "control"))).collect()] == ["a.test"]
    assert call("pause") == 0 and call("status") == 0 and said[-2:] == ["paused", "1 hosts in quarantine"]
    said.clear()
    assert call("audit", "2") == 0 and len(said) == 2 and said[-1].endswith("pause crawl")
    assert call("help") == 0 and cli.main([], spark, said.append) == 64


def test_crawl_obeys_control_events(spark):
    kind = "seq bigint, occurred_at timestamp, actor string, action string, subject string, detail string"
    robots = spark.createDataFrame([("site.test", "")], "host string, body string")
    seeds = spark.createDataFrame([("http://site.test/",)], "url string")

    def fetched(*rows):
        events = spark.createDataFrame([(k, None, "me", a, s, None) for k, (a, s) in enumerate(rows)], kind)
        stats, _ = crawl.crawl(seeds, lambda urls: fetch.fetch_from(urls, pages(spark)), robots, 100, control_events=lambda: events)
        return stats.fetched, stats.stop_reason

    assert fetched() == (5, 0)
    assert fetched(("takedown", "http://site.test/a")) == (4, 0)
    assert fetched(("quarantine", "site.test")) == (0, 0)
    assert fetched(("quarantine", "site.test"), ("release", "site.test"), ("pause", "crawl")) == (0, 3)
