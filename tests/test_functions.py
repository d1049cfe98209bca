from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomcrawl.functions import codec, hashing, htmlparse, simhash, url

URLS = {
    "HTTP://Example.COM/Path": "http://example.com/Path",
    "http://example.com:80/page": "http://example.com/page",
    "https://example.com:443/page": "https://example.com/page",
    "http://example.com:0080/page": "http://example.com/page",
    "http://example.com:8080/page": "http://example.com:8080/page",
    "http://example.com:/x": "http://example.com/x",
    "http://example.com": "http://example.com/",
    "http://example.com/a/./b/../c": "http://example.com/a/c",
    "http://example.com/page#section": "http://example.com/page",
    "http://example.com/page?a=1&b=2": "http://example.com/page?a=1&b=2",
    "HTTP://Example.com:80/a/./b/../page#frag": "http://example.com/a/page",
    "http://example.com/a//b": "http://example.com/a/b",
    "http://example.com/a/..": "http://example.com/",
    "http://example.com/a/b/..": "http://example.com/a/",
    "http://example.com/a/.": "http://example.com/a/",
    "http://example.com/../x": "http://example.com/../x",
    "http://example.com/..": "http://example.com/..",
    "http://example.com/a/../..": "http://example.com/..",
    "http://user:pw@example.com/x": "http://example.com/x",
    "http://example.com/%7e": "http://example.com/%7e",
    "http://example.com/x?": "http://example.com/x?",
    " \thttp://example.com/x \n": "http://example.com/x",
    "http://example.com./x": "http://example.com/x",
    "http://example.com/é": "http://example.com/é",
    "http://10.0.0.1/x": "http://10.0.0.1/x",
    "/just/a/path": None,
    "ftp://example.com/file": None,
    "mailto:foo@example.com": None,
    "http://example .com/page": None,
    "http://ex_ample.com/": None,
    "http://-a.example/": None,
    "http://example.com/a|b": None,
    "http://example.com/%zz": None,
    "http://example.com/a b": None,
    "http://example.com:99999999999/": None,
    "http:///x": None,
    "http://[::1]/": None,
    "": None,
    None: None,
}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = {r.u: r.v for r in df.select("u", url.canon_url(F.col("u")).alias("v")).collect()}
    assert got == URLS


def test_hosts(spark):
    want = {"Example.COM.": "example.com", "  example.com  ": "example.com", "": None, "   ": None, "-example.com": None, "example-.com": None, "ex_ample.com": None, "example..com": None, "a" * 64 + ".com": None, ("a" * 60 + ".") * 5: None, None: None}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.v for r in df.select("u", url.canon_host(F.col("u")).alias("v")).collect()} == want
    one = spark.createDataFrame([("a.b.example.com",)], "h string").select(url.surt_host(F.col("h")).alias("s"), url.registrable_domain(F.col("h")).alias("d")).first()
    assert (one.s, one.d) == ("com,example,b,a", "example.com")


def test_sites(spark):
    want = {"https://WWW.Example.com:8080/x": "example.com", "http://www.www.a.test": "www.a.test", "http://a.test?x": "a.test", "nothing": "", None: None}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.v for r in df.select("u", url.site_of(F.col("u")).alias("v")).collect()} == want


def test_hash_values(spark):
    df = spark.createDataFrame([("",), ("example.com",), ("/èê ß",), ("http://example.com/",), (None,)], "t string")
    got = {r.t: (r.f, r.m) for r in df.select("t", hashing.hex64(hashing.fnv1a64(F.col("t"))).alias("f"), hashing.hex64(hashing.mix64(F.col("t"))).alias("m")).collect()}
    assert got["http://example.com/"][0] == "32522fc5fdfe06f1"
    assert (got[""][1], got["example.com"][1], got["/èê ß"][1]) == ("efd01f60ba992926", "9591d6421994d599", "6c828505ac2549a5")
    assert got[None] == (None, None)


def test_bloom_slots_match_columns(spark):
    df = spark.createDataFrame([(f"host{i}.com",) for i in range(50)], "t string")
    df = df.withColumn("a", hashing.fnv1a64(F.col("t"))).withColumn("b", hashing.djb2_64(F.col("t"))).cache()
    rows = df.select(hashing.bloom_slots(F.col("t"), 95851, 7).alias("x"), "a", "b").cache().select("x", hashing.bloom_indexes(F.col("a"), F.col("b"), 95851, 7).alias("y")).collect()
    assert all(list(r.x) == list(r.y) for r in rows)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("", "efd01f60ba992926"),
        ("hello", "e9c562c0fdb23244"),
        ("a b c", "21a3b3fe9ee4787a"),
        ("Hello world this is content.", "f9bb73437041d44e"),
        ("(foo bar", "442a895f1e2240a7"),
        ("alpha " * 100, "5f9471d80db2625d"),
        ("beta " * 100, "ce19b08090afef74"),
        ("The quick brown fox jumps over the lazy dog. " * 20 + "Variant one.", "189b86fe21d669cd"),
        ("...", "0000000000000000"),
    ],
)
def test_simhash_values(text, value):
    assert f"{int(simhash.simhash_array([text])[0]):016x}" == value


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 6))) for b in base] + base[:5] + [0, 2**64 - 1]
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed] + [(None,)], "fp bigint")
    for k in (1, 3, 7):
        got = {(r.fp_a, r.fp_b): r.distance for r in simhash.near_pairs(df, k).collect()}
        one = sorted(set(signed))
        want = {(a, b): bin((a ^ b) & (2**64 - 1)).count("1") for i, a in enumerate(one) for b in one[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= k}
        assert got == want


def _limited_broadcast(spark, tmp_path, search):
    """Rows of a search over 20,000 fingerprints in a file, while no broadcast may be over 1 MB."""
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(10_000)]
    path = str(tmp_path / "fps")
    spark.createDataFrame([(v,) for b in base for v in (b, b ^ 1 ^ 1 << rng.randrange(1, 62))], "fp bigint").write.parquet(path)
    name = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(name)
    spark.conf.set(name, "1MB")
    try:
        return base, search(spark.read.parquet(path)).collect()
    finally:
        spark.conf.set(name, before)


def test_near_pairs_within_three_bits_broadcast_nothing_exploded(spark, tmp_path):
    base, rows = _limited_broadcast(spark, tmp_path, lambda fps: simhash.near_pairs(fps, 3))
    assert {x for r in rows for x in (r.fp_a, r.fp_b)} >= set(base) and len(rows) == len({(r.fp_a, r.fp_b) for r in rows})


def test_near_pairs_within_seven_bits_broadcast_nothing_exploded(spark, tmp_path):
    base, rows = _limited_broadcast(spark, tmp_path, lambda fps: simhash.near_pairs(fps, 7, 10))
    near = {x for r in rows if r.distance == 2 for x in (r.fp_a, r.fp_b)}
    assert near >= set(base) and len(rows) == len({(r.fp_a, r.fp_b) for r in rows})


def test_nearest_broadcasts_nothing_exploded_and_searches_once(spark, tmp_path):
    found = []
    base, rows = _limited_broadcast(spark, tmp_path, lambda fps: found.append(simhash.nearest(fps, 7, 10)) or found[0])
    assert {r.fp for r in rows} >= set(base) and len(rows) == len({r.fp for r in rows})
    assert found[0]._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_near_pairs_of_groups_in_slices(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 20)
    rng = random.Random(7)
    fps = sorted({rng.getrandbits(10) << 50 | rng.getrandbits(6) for _ in range(300)})
    rows = simhash.near_pairs(spark.createDataFrame([(v,) for v in fps], "fp bigint"), 3).collect()
    want = [(a, b, (a ^ b).bit_count()) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    assert sorted(tuple(r) for r in rows) == want


def test_lane_candidates(spark):
    df = spark.createDataFrame([(0xFFFF,), (0xFFFF0000,), (0xFFFFFFFF,)], "fp bigint")
    got = {r.candidate for r in simhash.lane_candidates(df.where(F.col("fp") == 0xFFFFFFFF), df).collect()}
    assert got == {0xFFFF, 0xFFFF0000}


PAGE = """<html><head><title> A  title </title><meta name=description content="About"><link rel=canonical href="/canon">
<script>var x = '</p>';</script></head><body><header><a href="/h">H</a></header><nav><a href=/n rel="nofollow sponsored">N</a></nav>
<main><h1>One</h1><h2></h2><p>First<p>Second <b>bold</b><br>line<a href="b?x=1&amp;y=2">b</a><a href="mailto:a@b.c">m</a>
<div class="ad">buy</div></main><aside><a href="/s">S</a></aside><footer><a href="//other.test/f">F</a></footer></body></html>"""


def test_html_parts():
    d = htmlparse.parse_page("http://example.com/a/page", PAGE)
    assert (d["title"], d["description"], d["canonical"]) == ("A title", "About", "http://example.com/canon")
    assert d["headings"] == [{"level": 1, "text": "One", "ordinal": 0}]
    assert [(o["target"], o["section"]) for o in d["outlinks"]] == [
        ("http://example.com/h", "HEADER"),
        ("http://example.com/n", "NAV"),
        ("http://example.com/a/b?x=1&y=2", "MAIN"),
        ("mailto:a@b.c", "MAIN"),
        ("http://example.com/s", "SIDEBAR"),
        ("http://other.test/f", "FOOTER"),
    ]
    assert d["main_text"] == "One First Second bold lineb m".replace("lineb m", "linebm") or d["main_text"].startswith("One First Second bold line")
    assert "buy" not in d["main_text"] and "F" not in d["main_text"].split()
    none = htmlparse.parse_page("http://example.com/", '<meta name="robots" content="NOINDEX, nofollow"><a href="/x">x</a>')
    assert (none["indexable"], none["followable"], none["outlinks"]) == (False, False, [])
    assert htmlparse.parse_page("http://example.com/", "")["main_text"] == ""


def test_render_reasons(spark):
    long_text = "x" * 6000
    pages = [(200, f"<body>{long_text}</body>", None), (200, "<body>short</body>", "EMPTY_BODY"), (200, f'<body><div id="root">{long_text}</div></body>', "SPA_FRAMEWORK_DETECTED"), (200, f"<body><noscript>please switch on scripts now</noscript>{long_text}</body>", "CLASSIFIER_OTHER"), (200, f'<body><div id="mainframe">{long_text}</div></body>', None), (200, f'<body><div id="rootless">{long_text}</div></body>', None), (200, f'<body><app-root>{long_text}</app-root></body>', "SPA_FRAMEWORK_DETECTED"), (404, "<body></body>", None), (200, None, None), (200, "no body here", None)]
    df = spark.createDataFrame([(i, s, p) for i, (s, p, _) in enumerate(pages)], "i int, s int, p string")
    got = [r.r for r in df.select("i", htmlparse.render_reason(F.col("s"), F.col("p")).alias("r")).orderBy("i").collect()]
    assert got == [w for _, _, w in pages]


def test_codecs(spark):
    df = spark.createDataFrame([("click here", 'Spaces and "quotes"', "a\\b", "", None)], "a string, b string, c string, d string, e string")
    line = df.select(codec.kv_line(anchor=F.col("a"), q=F.col("b"), back=F.col("c"), empty=F.col("d"), none=F.col("e"), flag=F.lit(True)).alias("l")).first().l
    assert line == 'anchor="click here" q="Spaces and \\"quotes\\"" back=a\\b empty= none= flag=true'
    when = spark.createDataFrame([("Sun, 06 Nov 1994 08:49:37 GMT",), ("nonsense",), (None,)], "t string").select(F.date_format(codec.http_date(F.col("t")), "yyyyMMddHHmmss").alias("w")).collect()
    assert [r.w for r in when] == ["19941106084937", None, None]


def test_page_text_by_charset(spark):
    rows = [("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"), ("é".encode(), "text/html; charset=utf-8", "é"), ("é".encode(), None, "é"), (b"a\xffb", None, "a\ufffdb"), (None, "text/html", None)]
    df = spark.createDataFrame([(i, b, t) for i, (b, t, _) in enumerate(rows)], "i int, b binary, t string")
    got = [r.x for r in df.select("i", htmlparse.page_text(F.col("b"), F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [w for *_, w in rows]
