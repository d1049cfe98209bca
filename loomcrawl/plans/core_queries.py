"""Queries of the engine's own operators and their SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcrawl.functions import codec, hashing, htmlparse, simhash, url
from loomcrawl.operators import crawl, dedup, folds, graph, metrics, robots, routing, simulate
from loomcrawl.operators.skew import CLASSES
from loomcrawl.plans.duck import canon_host as duck_host
from loomcrawl.plans.duck import url_table
from loomcrawl.session import materialize
from loomcrawl.sources import archive, fetch
from loomcrawl.sources.tables import table
from loomcrawl.streaming import keyed
from loomcrawl.streaming.dedup import parquet_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}

AGENTS = [f"agent-{i:02d}" for i in range(24)]
VNODES = 50
NOW_MS = 1_896_134_400_000  # 2030-02-01
PROBES = ("/", "/private/a", "/admin/index.html", "/archive/2029/a", "/search", "/news/latest")
BOTS = ("mybot", "archivebot")
ALLOW, DENY = ["*.example", "*.test"], ["*.harrowlight.example", "videonest.example"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- SQL building blocks -------------------------------------------------------

_FNV = """list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, octet_length(encode({x})) + 1),
  lambda i: ('0x' || substr(hex(encode({x})), (2*i-1)::INT, 2))::UTINYINT::UHUGEINT)),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"""
_DJB = _FNV.replace("14695981039346656037", "5381").replace("(xor(h, b) * 1099511628211::UHUGEINT)", "(h * 33::UHUGEINT + b)")


def fnv(x: str) -> str:
    return _FNV.format(x=x)


def djb(x: str) -> str:
    return _DJB.format(x=x)


def mixed(source: str, keep: str, x: str) -> str:
    """SELECT keep, h: the mixed hash of x as UHUGEINT."""
    m = "18446744073709551616::UHUGEINT"
    return f"""(SELECT {keep}, xor(h2, h2 >> 33) AS h FROM (SELECT *, (xor(h1, h1 >> 33) * 14181476777654086739::UHUGEINT) % {m} AS h2 FROM
  (SELECT *, (xor(h0, h0 >> 33) * 18397679294719823053::UHUGEINT) % {m} AS h1 FROM (SELECT {keep}, {fnv(x)} AS h0 FROM {source}))))"""


def signed(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808::UHUGEINT THEN {h}::HUGEINT - 18446744073709551616::HUGEINT ELSE {h}::HUGEINT END)::BIGINT"


def hexed(h: str) -> str:
    return f"lpad(lower(hex({h}::UBIGINT)), 16, '0')"


_TARGETS = "(SELECT DISTINCT target_url FROM extracted_links WHERE target_url IS NOT NULL)"
_URLS = url_table(_TARGETS, "target_url", "target_url")
_FETCH_URLS = url_table("fetch_results", "url", "fetch_id, fetched_at, outcome, http_status, fetch_duration_ms, content_type, body, conditional_used, conditional_matched")
_HOSTS = f"(SELECT DISTINCT host FROM (SELECT {duck_host('host_name')} AS host FROM back_queue_entries) WHERE host IS NOT NULL)"
_ENTRIES = "(SELECT delivery_id, unnest(range(len(urls))) AS entry_no, unnest(urls).url AS raw FROM forwarding_batches WHERE urls IS NOT NULL)"


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_links").select("target_url").where(F.col("target_url").isNotNull()).distinct()


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "back_queue_entries").select(url.present(url.canon_host(F.col("host_name"))).alias("host")).distinct()


def entries(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "forwarding_batches").select("delivery_id", F.posexplode("urls").alias("entry_no", "e"))
    return each.select("delivery_id", "entry_no", url.present(url.canon_url(F.col("e.url"))).alias("key"))


def fetches(spark: SparkSession, d: str) -> DataFrame:
    """Fetches once each, with the host of their url."""
    f = table(spark, d, "fetch_results").select("fetch_id", "outcome", "fetched_at", F.explode(F.array(url.url_parts(F.col("url")))).alias("parts"))
    return f.select("fetch_id", F.col("parts.value").alias("url"), F.col("parts.host").alias("host"), "outcome", F.unix_millis("fetched_at").alias("at_ms"), F.col("fetch_id").alias("seq")).dropDuplicates(["fetch_id"])


_FETCH = f"(SELECT DISTINCT ON (fetch_id) fetch_id, value AS url, host, outcome, epoch_us(fetched_at) // 1000 AS at_ms FROM {_FETCH_URLS})"


# --- URLs and hashes -----------------------------------------------------------


@query("url_canonicalize", f"SELECT target_url, value, host, scheme, path, query, port FROM {_URLS}")
def url_canonicalize(spark, d):
    p = url.url_parts(F.col("target_url"))
    return targets(spark, d).withColumn("p", p).select("target_url", *[F.col(f"p.{c}").alias(c) for c in ("value", "host", "scheme", "path", "query", "port")])


_SPELLINGS = [
    ("HtTp", "Shop.Tern-Quay.Test"), ("https", "tern-quay.test:443"), ("http", "tern-quay.test:80"), ("http", "tern-quay.test:8443"), ("http", "reader@tern-quay.test"), ("ftp", "tern-quay.test"),
    ("http", "tern quay.test"), ("http", "tern_quay.test"), ("http", "-tern.test"), ("http", "tern-quay.test."), ("http", "10.1.2.3"), ("http", "a.1b"), ("gopher", "x.test"),
]
_PATHS = ["", "/", "/Fish/./cod/../eel", "/tide#low", "/tide?day=3&hour=4", "/net//knots/", "/../up/..", "/%7etern", "/%zz", "/eel|cod", "?q=", "/net/knots/..", "/caf\u00e9 "]
_RAW_URLS = [f"{scheme}://{host}{path}" for scheme, host in _SPELLINGS for path in _PATHS] + ["/tide/tables", "mailto:reader@tern-quay.test", "", "tern-quay.test/x"]
_VALUES = "(VALUES " + ", ".join("('" + u.replace("'", "''") + "')" for u in _RAW_URLS) + ") v(raw)"


@query("url_reject", f"SELECT raw AS raw_url, value FROM {url_table(_VALUES, 'raw', 'raw')}")
def url_reject(spark, d):
    return spark.createDataFrame([(u,) for u in _RAW_URLS], "raw_url string").select("raw_url", url.canon_url(F.col("raw_url")).alias("value"))


@query(
    "url_surt",
    f"SELECT DISTINCT value, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || CASE WHEN query IS NOT NULL THEN '?' || query ELSE '' END AS surt, array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM {_URLS} WHERE value IS NOT NULL",
)
def url_surt(spark, d):
    p = targets(spark, d).select(url.present(url.url_parts(F.col("target_url"))).alias("p"))
    return p.select(F.col("p.value").alias("value"), url.surt_key(F.col("p")).alias("surt"), url.registrable_domain(F.col("p.host")).alias("domain")).distinct()


@query("url_hash64", f"SELECT host, {hexed('f')} AS fnv1a64, {hexed('d')} AS djb2, (f & 9223372036854775807::UHUGEINT)::BIGINT % 256 AS bucket FROM (SELECT host, {fnv('host')} AS f, {djb('host')} AS d FROM {_HOSTS})")
def url_hash64(spark, d):
    h = hosts(spark, d).withColumn("f", hashing.fnv1a64(F.col("host"))).withColumn("g", hashing.djb2_64(F.col("host")))
    return h.select("host", hashing.hex64(F.col("f")).alias("fnv1a64"), hashing.hex64(F.col("g")).alias("djb2"), hashing.bucket_of(F.col("f")).cast("bigint").alias("bucket"))


@query("url_mix64", f"SELECT host, {hexed('h')} AS mix64 FROM {mixed(_HOSTS, 'host', 'host')}")
def url_mix64(spark, d):
    return hosts(spark, d).select("host", hashing.hex64(hashing.mix64(F.col("host"))).alias("mix64"))


# --- Deduplication -------------------------------------------------------------

_KEYS = f"(SELECT delivery_id, entry_no, value AS key FROM {url_table(_ENTRIES, 'raw', 'delivery_id, entry_no')} WHERE value IS NOT NULL)"
_VERDICTS = f"(SELECT delivery_id, entry_no, key, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY delivery_id, entry_no) = 1 THEN 'NEW' ELSE 'DUPLICATE' END AS verdict FROM {_KEYS})"
_LINKS = f"(SELECT DISTINCT value AS key FROM {_URLS} WHERE value IS NOT NULL)"


@query("url_dedup_verdict", f"SELECT * FROM {_VERDICTS}")
def url_dedup_verdict(spark, d):
    return dedup.dedup_verdicts(entries(spark, d), "key", ["delivery_id", "entry_no"])


@query("url_dedup_stats", f"SELECT count(*) AS n_queries, count(*) FILTER (WHERE verdict = 'NEW') AS n_new, count(*) FILTER (WHERE verdict <> 'NEW') AS n_duplicate, round(count(*) FILTER (WHERE verdict <> 'NEW') / count(*), 6) AS duplicate_rate FROM {_VERDICTS}")
def url_dedup_stats(spark, d):
    return dedup.dedup_stats(url_dedup_verdict(spark, d))


@query("url_net_new", f"SELECT DISTINCT key FROM {_KEYS} WHERE key NOT IN (SELECT key FROM {_LINKS})")
def url_net_new(spark, d):
    links = targets(spark, d).select(url.present(url.canon_url(F.col("target_url"))).alias("key")).distinct()
    return dedup.net_new(entries(spark, d), links, "key")


@query("url_probe", f"SELECT DISTINCT key, CASE WHEN key IN (SELECT key FROM {_LINKS}) THEN 'DUPLICATE' ELSE 'NEW' END AS verdict FROM {_KEYS}")
def url_probe(spark, d):
    links = targets(spark, d).select(url.present(url.canon_url(F.col("target_url"))).alias("key"))
    return dedup.probe(entries(spark, d), links, "key")


_SIZES = "(VALUES (10000, 0.01), (10000, 0.001), (1000, 0.01), (100, 0.05)) v(n, rate)"


@query("bloom_sizing", f"SELECT n, rate, bits, hashes, round(pow(1 - exp(-hashes::DOUBLE * n / bits), hashes), 9) AS fpr FROM (SELECT n::BIGINT AS n, rate::DOUBLE AS rate, bits, greatest(1, round(bits / n * ln(2)))::BIGINT AS hashes FROM (SELECT *, greatest(8, ceil(-n * ln(rate::DOUBLE) / (ln(2) * ln(2))))::BIGINT AS bits FROM {_SIZES}))")
def bloom_sizing(spark, d):
    rows = [(n, r, *dedup.bloom_size(n, r)) for n, r in ((10000, 0.01), (10000, 0.001), (1000, 0.01), (100, 0.05))]
    df = spark.createDataFrame(rows, "n bigint, rate double, bits bigint, hashes bigint")
    fpr = F.pow(1 - F.exp(-F.col("hashes").cast("double") * F.col("n") / F.col("bits")), F.col("hashes").cast("double"))
    return df.select("*", F.round(fpr, 9).alias("fpr"))


_BITS, _K = dedup.bloom_size(10_000, 0.01)
_BLOOM = f"(SELECT host, unnest(list_transform(range(0, {_K}), lambda i: (((f + i::UHUGEINT * g) % 18446744073709551616::UHUGEINT) & 9223372036854775807::UHUGEINT) % {_BITS}::UHUGEINT))::BIGINT AS bit FROM (SELECT host, {fnv('host')} AS f, {djb('host')} AS g FROM {_HOSTS}))"


@query("bloom_bits", f"SELECT DISTINCT bit FROM {_BLOOM}")
def bloom_bits(spark, d):
    return dedup.bloom_bits(hosts(spark, d), "host", _BITS, _K)


@query("bloom_probe", f"WITH p AS (SELECT DISTINCT host FROM {_URLS} WHERE host IS NOT NULL), b AS (SELECT DISTINCT bit FROM {_BLOOM}), q AS (SELECT host, unnest(list_transform(range(0, {_K}), lambda i: (((f + i::UHUGEINT * g) % 18446744073709551616::UHUGEINT) & 9223372036854775807::UHUGEINT) % {_BITS}::UHUGEINT))::BIGINT AS bit FROM (SELECT host, {fnv('host')} AS f, {djb('host')} AS g FROM p)) SELECT host, bool_and(bit IN (SELECT bit FROM b)) AS might_contain FROM q GROUP BY host")
def bloom_probe(spark, d):
    asked = targets(spark, d).select(url.url_parts(F.col("target_url"))["host"].alias("host")).where(F.col("host").isNotNull())
    return dedup.bloom_probe(asked, bloom_bits(spark, d), "host", _BITS, _K)


# --- Fingerprints --------------------------------------------------------------

_PAGES = "(SELECT DISTINCT ON (page_id) * FROM parsed_documents)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_documents").dropDuplicates(["page_id"])


@query("simhash64", f"SELECT page_id, {hexed('(CASE WHEN simhash64 < 0 THEN simhash64::HUGEINT + 18446744073709551616 ELSE simhash64::HUGEINT END)')} AS simhash64 FROM {_PAGES}")
def simhash64(spark, d):
    p = table(spark, d, "parsed_documents").select("page_id", "main_text").dropDuplicates(["page_id"])
    return p.select("page_id", hashing.hex64(simhash.simhash64(F.col("main_text"))).alias("simhash64"))


def _fingerprints(spark, d):
    """Fingerprints of all pages, and for each page one more with two or three of its bits turned."""
    p = table(spark, d, "parsed_documents").where(F.col("simhash64").isNotNull())
    bit = lambda n: F.expr(f"shiftleft(1L, cast(pmod(page_id * {n}, 64) as int))")
    flipped = F.col("simhash64").bitwiseXOR(bit(1).bitwiseOR(bit(7)).bitwiseOR(bit(11)))
    return p.select(F.explode(F.array("simhash64", flipped)).alias("fp"))


_BIT = "(1::UBIGINT << (page_id * {n} % 64)::UBIGINT)"
_TURNED = f"xor(CASE WHEN simhash64 < 0 THEN (simhash64::HUGEINT + 18446744073709551616)::UBIGINT ELSE simhash64::UBIGINT END, {_BIT.format(n=1)} | {_BIT.format(n=7)} | {_BIT.format(n=11)})"
_FPS = f"(SELECT DISTINCT fp FROM (SELECT simhash64 AS fp FROM parsed_documents WHERE simhash64 IS NOT NULL UNION ALL SELECT (CASE WHEN u >= 9223372036854775808::UBIGINT THEN u::HUGEINT - 18446744073709551616 ELSE u::HUGEINT END)::BIGINT FROM (SELECT {_TURNED} AS u FROM parsed_documents WHERE simhash64 IS NOT NULL)))"


def _pair_sql(k: int) -> str:
    return f"SELECT a.fp AS fp_a, b.fp AS fp_b, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM {_FPS} a JOIN {_FPS} b ON a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= {k}"


@query("near_dup_pairs_k3", _pair_sql(3))
def near_dup_pairs_k3(spark, d):
    return simhash.near_pairs(_fingerprints(spark, d), 3)


@query("near_dup_pairs_k7", _pair_sql(7))
def near_dup_pairs_k7(spark, d):
    return simhash.near_pairs(_fingerprints(spark, d), 7, 10)


@query("nearest_near_dup", f"WITH p AS ({_pair_sql(7)}), b AS (SELECT fp_a AS fp, fp_b AS other, distance FROM p UNION ALL SELECT fp_b, fp_a, distance FROM p) SELECT fp, other AS nearest, distance FROM b QUALIFY row_number() OVER (PARTITION BY fp ORDER BY distance, other) = 1")
def nearest_near_dup(spark, d):
    return simhash.nearest(_fingerprints(spark, d), 7, 10)


@query("exact_dup_groups", "SELECT simhash64 AS fp, count(DISTINCT page_id) AS n_pages, min(page_id) AS first_page FROM parsed_documents WHERE simhash64 IS NOT NULL GROUP BY simhash64")
def exact_dup_groups(spark, d):
    return pages(spark, d).where(F.col("simhash64").isNotNull()).groupBy(F.col("simhash64").alias("fp")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query("distinct_fingerprints", "SELECT count(DISTINCT simhash64) AS n FROM parsed_documents")
def distinct_fingerprints(spark, d):
    return table(spark, d, "parsed_documents").select(F.col("simhash64").alias("fp")).agg(F.count_distinct("fp").alias("n"))


# --- Pages ---------------------------------------------------------------------


def parsed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetch_results").where(F.col("body").isNotNull()).select("fetch_id", "final_url", "body", "content_type").dropDuplicates(["fetch_id"])
    return f.select("fetch_id", "final_url", htmlparse.parse_html(F.col("final_url"), F.col("body"), F.col("content_type")).alias("doc"))


@query("page_titles")
def page_titles(spark, d):
    return parsed(spark, d).select("fetch_id", "doc.title", "doc.description", "doc.canonical", "doc.indexable", "doc.followable", "doc.dom_size")


@query("page_headings")
def page_headings(spark, d):
    return parsed(spark, d).select("fetch_id", F.explode("doc.headings").alias("h")).select("fetch_id", "h.level", "h.text", "h.ordinal")


@query("page_outlinks")
def page_outlinks(spark, d):
    out = parsed(spark, d).select("fetch_id", F.posexplode("doc.outlinks").alias("place", "o"))
    return out.select("fetch_id", "place", url.canon_url(F.col("o.target")).alias("target"), "o.anchor", "o.rel", "o.section").where(F.col("target").isNotNull())


@query("page_main_text")
def page_main_text(spark, d):
    return parsed(spark, d).select("fetch_id", "doc.main_text", hashing.hex_short(F.col("doc.simhash64")).alias("simhash64"))


_ESCAPED = r"""regexp_replace(regexp_replace(replace(replace(replace(body::VARCHAR, '\x22', '"'), '\x27', chr(39)), '\x5C', '/'), '\\x0[9A-D]', ' ', 'g'), '\\x[0-9A-F]{2}', '?', 'g')"""
_PAGE_TEXT = f"""(SELECT fetch_id, http_status, CASE WHEN regexp_matches(coalesce(content_type, ''), '(?i)charset\\s*=\\s*["'']?(?:iso-8859-|latin-?1|windows-125|cp125|us-ascii)') THEN {_ESCAPED} ELSE decode(body, 'replace') END AS page
  FROM (SELECT DISTINCT ON (fetch_id) * FROM fetch_results))"""


@query(
    "page_render_reason",
    f"""SELECT fetch_id, CASE WHEN page IS NULL OR http_status NOT BETWEEN 200 AND 299 THEN NULL WHEN size >= 0 AND size < {htmlparse.EMPTY_BODY} THEN 'EMPTY_BODY'
  WHEN regexp_matches(page, '{htmlparse.SPA_MARKER}') THEN 'SPA_FRAMEWORK_DETECTED' WHEN regexp_matches(page, '{htmlparse.NOSCRIPT_TEXT}') THEN 'CLASSIFIER_OTHER' END AS reason
FROM (SELECT *, CASE WHEN start > 0 AND after > 0 AND tail > 0 AND length(low) - tail - 5 >= after THEN length(low) - tail - 5 - after ELSE -1 END AS size
  FROM (SELECT *, CASE WHEN start > 0 AND instr(low[start:], '>') > 0 THEN start - 1 + instr(low[start:], '>') ELSE 0 END AS after FROM (SELECT fetch_id, http_status, page, lower(page) AS low, instr(lower(page), '<body') AS start, instr(reverse(lower(page)), '>ydob/<') AS tail FROM {_PAGE_TEXT})))""",
)
def page_render_reason(spark, d):
    f = table(spark, d, "fetch_results").select("fetch_id", "http_status", htmlparse.page_text(F.col("body"), F.col("content_type")).alias("page"))
    return f.select("fetch_id", htmlparse.render_reason(F.col("http_status"), F.col("page")).alias("reason")).dropDuplicates(["fetch_id"])


# --- Links ---------------------------------------------------------------------

_EDGES = f"(SELECT s.value AS source, s.host AS source_host, t.value AS target, t.host AS target_host, l.anchor_text, l.rel, l.dom_section, l.link_id FROM (SELECT DISTINCT ON (link_id) * FROM extracted_links) l JOIN {url_table('(SELECT DISTINCT source_url FROM extracted_links)', 'source_url', 'source_url')} s USING (source_url) JOIN {_URLS} t USING (target_url) WHERE s.value IS NOT NULL AND t.value IS NOT NULL)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "extracted_links").dropDuplicates(["link_id"])
    both = links.select("*", url.present(url.url_parts(F.col("source_url"))).alias("s")).select("*", url.present(url.url_parts(F.col("target_url"))).alias("t"))
    return both.select(F.col("s.value").alias("source"), F.col("s.host").alias("source_host"), F.col("t.value").alias("target"), F.col("t.host").alias("target_host"), "anchor_text", "rel", "dom_section", "link_id")


@query("link_indegree", f"SELECT target, count(*) AS n_links, count(DISTINCT source) AS n_sources FROM {_EDGES} GROUP BY target")
def link_indegree(spark, d):
    per = edges(spark, d).groupBy("target", "source").agg(F.count("*").alias("n"))
    return per.groupBy("target").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_sources"))


@query("link_sections", "SELECT dom_section, count(*) AS n_links, count(*) FILTER (WHERE list_has_any(string_split_regex(lower(coalesce(rel, '')), '\\s+'), ['nofollow', 'sponsored'])) AS n_nofollow FROM (SELECT DISTINCT ON (link_id) * FROM extracted_links) GROUP BY dom_section")
def link_sections(spark, d):
    links = table(spark, d, "extracted_links").dropDuplicates(["link_id"])
    return links.groupBy("dom_section").agg(F.count("*").alias("n_links"), F.count(F.when(codec.is_nofollow(F.col("rel")), 1)).alias("n_nofollow"))


@query("link_host_graph", f"SELECT source_host, target_host, count(*) AS n_links FROM {_EDGES} WHERE source_host <> target_host GROUP BY ALL")
def link_host_graph(spark, d):
    e = edges(spark, d).where(F.col("source_host") != F.col("target_host"))
    return e.groupBy("source_host", "target_host").agg(F.count("*").alias("n_links"))


_OPIC = f"""WITH e AS (SELECT source, target FROM {_EDGES}), v AS (SELECT DISTINCT source AS url FROM e),
s AS (SELECT source, 1.0::DOUBLE / count(*) AS share FROM e GROUP BY source), g AS (SELECT target AS url, sum(share) AS gain FROM e JOIN s USING (source) GROUP BY target)
SELECT coalesce(v.url, g.url) AS url, round(coalesce(gain, 0), 9)::DOUBLE AS cash, CASE WHEN v.url IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS history FROM v FULL JOIN g ON v.url = g.url"""


def _opic(spark, d):
    e = edges(spark, d).select("source", "target")
    empty = spark.createDataFrame([], "url string, cash double, history double")
    state = graph.opic_round(empty, e.select(F.col("source").alias("url")), e)
    return state.select("url", F.round("cash", 9).alias("cash"), "history")


@query("opic_round", _OPIC)
def opic_round(spark, d):
    return _opic(spark, d)


@query("opic_top", f"SELECT * FROM ({_OPIC}) ORDER BY history DESC, cash DESC, url LIMIT 20")
def opic_top(spark, d):
    return graph.top_by_history(_opic(spark, d), 20)


# --- Events --------------------------------------------------------------------


def _duck_kv(**fields: str) -> str:
    def value(x: str) -> str:
        t = f"coalesce(({x})::VARCHAR, '')"
        esc = f"replace(replace(replace({t}, chr(92), chr(92)||chr(92)), '\"', chr(92)||'\"'), chr(10), chr(92)||'n')"
        return f"CASE WHEN regexp_matches({t}, '[ \"\\n]') THEN '\"' || {esc} || '\"' ELSE {t} END"

    return " || ' ' || ".join(f"'{k}=' || {value(v)}" for k, v in fields.items())


def _duck_instant(ts: str) -> str:
    return f"strftime({ts} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' WHEN epoch_us({ts}) % 1000 = 0 THEN '.' || lpad(((epoch_us({ts}) % 1000000) // 1000)::VARCHAR, 3, '0') ELSE '.' || lpad((epoch_us({ts}) % 1000000)::VARCHAR, 6, '0') END || 'Z'"


_PAGE_URLS = url_table("parsed_documents", "url", "page_id, title, main_text, simhash64, parsed_at, is_indexable")


@query(
    "document_events",
    f"""SELECT DISTINCT ON (page_id) page_id, {_duck_kv(event="'document'", url="value", host="host", title="left(coalesce(title, ''), 256)", text_length="length(coalesce(main_text, ''))", simhash64="lower(hex(CASE WHEN simhash64 < 0 THEN simhash64::HUGEINT + 18446744073709551616 ELSE simhash64::HUGEINT END::UBIGINT))", fetched_at=_duck_instant("parsed_at"))} AS line FROM {_PAGE_URLS} WHERE value IS NOT NULL AND is_indexable""",
)
def document_events(spark, d):
    p = pages(spark, d).where("is_indexable").select("*", url.present(url.url_parts(F.col("url"))).alias("u"))
    line = codec.kv_line(event=F.lit("document"), url=F.col("u.value"), host=F.col("u.host"), title=codec.truncate(F.col("title"), 256), text_length=F.length(F.coalesce("main_text", F.lit(""))), simhash64=hashing.hex_short(F.col("simhash64")), fetched_at=archive.iso_instant(F.col("parsed_at")))
    return p.select("page_id", line.alias("line"))


@query("link_events", f"""SELECT link_id, {_duck_kv(event="'link'", source_url="source", target_url="target", source_host="source_host", target_host="target_host", anchor="left(coalesce(anchor_text, ''), 200)", rel="rel", dom_section="dom_section")} AS line FROM {_EDGES}""")
def link_events(spark, d):
    line = codec.kv_line(event=F.lit("link"), source_url=F.col("source"), target_url=F.col("target"), source_host=F.col("source_host"), target_host=F.col("target_host"), anchor=codec.truncate(F.col("anchor_text"), 200), rel=F.col("rel"), dom_section=F.col("dom_section"))
    return edges(spark, d).select("link_id", line.alias("line"))


@query("fetch_events", f"""SELECT DISTINCT ON (fetch_id) fetch_id, {_duck_kv(event="'fetch'", url="value", host="host", http_status="http_status", fetch_duration_ms="fetch_duration_ms", body_size_bytes="coalesce(octet_length(body), 0)", content_type="content_type", conditional_used="conditional_used", conditional_matched="conditional_matched", fetched_at=_duck_instant("fetched_at"))} AS line FROM {_FETCH_URLS} WHERE value IS NOT NULL""")
def fetch_events(spark, d):
    f = table(spark, d, "fetch_results").dropDuplicates(["fetch_id"]).select("*", url.present(url.url_parts(F.col("url"))).alias("u"))
    line = codec.kv_line(event=F.lit("fetch"), url=F.col("u.value"), host=F.col("u.host"), http_status=F.col("http_status"), fetch_duration_ms=F.col("fetch_duration_ms"), body_size_bytes=F.coalesce(F.octet_length("body"), F.lit(0)), content_type=F.col("content_type"), conditional_used=F.col("conditional_used"), conditional_matched=F.col("conditional_matched"), fetched_at=archive.iso_instant(F.col("fetched_at")))
    return f.select("fetch_id", line.alias("line"))


@query("fetch_outcomes", "SELECT http_status, CASE WHEN http_status = 304 THEN 'NOT_MODIFIED_304' WHEN http_status BETWEEN 200 AND 299 THEN 'SUCCESS_200' WHEN http_status BETWEEN 300 AND 399 THEN 'REDIRECT_3XX' WHEN http_status = 429 THEN 'RATE_LIMITED_429' WHEN http_status BETWEEN 400 AND 499 THEN 'CLIENT_ERROR_4XX' WHEN http_status BETWEEN 500 AND 599 THEN 'SERVER_ERROR_5XX' ELSE 'NETWORK_ERROR' END AS mapped, outcome, count(DISTINCT fetch_id) AS n, bool_or(outcome IN ('SERVER_ERROR_5XX', 'RATE_LIMITED_429', 'NETWORK_ERROR', 'TIMEOUT')) AS backs_off FROM fetch_results GROUP BY http_status, outcome")
def fetch_outcomes(spark, d):
    f = table(spark, d, "fetch_results").select("fetch_id", "http_status", "outcome").dropDuplicates(["fetch_id"])
    return f.groupBy("http_status", codec.status_outcome(F.col("http_status")).alias("mapped"), "outcome").agg(F.count("*").alias("n"), F.bool_or(codec.is_backoff(F.col("outcome"))).alias("backs_off"))


@query("crawl_stats", "SELECT count(*) AS n_fetched, count(*) FILTER (WHERE outcome IN ('SUCCESS_200', 'NOT_MODIFIED_304')) AS n_succeeded, count(*) FILTER (WHERE outcome NOT IN ('SUCCESS_200', 'NOT_MODIFIED_304')) AS n_failed, sum(coalesce(octet_length(body), 0))::BIGINT AS body_bytes, sum(redirect_hop_count)::BIGINT AS n_redirects FROM (SELECT DISTINCT ON (fetch_id) * FROM fetch_results)")
def crawl_stats(spark, d):
    f = table(spark, d, "fetch_results").select("fetch_id", "outcome", F.octet_length("body").alias("size"), "redirect_hop_count").dropDuplicates(["fetch_id"])
    good = codec.is_success(F.col("outcome"))
    return f.agg(F.count("*").alias("n_fetched"), F.count(F.when(good, 1)).alias("n_succeeded"), F.count(F.when(~good, 1)).alias("n_failed"), F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("body_bytes"), F.sum("redirect_hop_count").cast("bigint").alias("n_redirects"))


# --- Folds ---------------------------------------------------------------------


@query(
    "host_backoff",
    f"""SELECT host, round(s.x, 6) AS backoff, s.e AS errors, s.ok AS last_success_ms, s.t + floor((1e9 * s.x)::BIGINT / 1000000)::BIGINT AS next_fetch_ms FROM (SELECT host, list_reduce(
  list_prepend({{'x': 1.0::DOUBLE, 'e': 0, 'ok': NULL::BIGINT, 't': 0::BIGINT, 'o': ''}}, list({{'x': 0.0::DOUBLE, 'e': 0, 'ok': NULL::BIGINT, 't': at_ms, 'o': outcome}} ORDER BY at_ms, fetch_id)),
  lambda a, b: {{'x': CASE WHEN b.o IN ('SERVER_ERROR_5XX', 'RATE_LIMITED_429', 'NETWORK_ERROR', 'TIMEOUT') THEN least(64.0, a.x * 2) WHEN b.o IN ('SUCCESS_200', 'NOT_MODIFIED_304') THEN greatest(1.0, a.x * 0.95) ELSE a.x END,
  'e': CASE WHEN b.o IN ('SERVER_ERROR_5XX', 'RATE_LIMITED_429', 'NETWORK_ERROR', 'TIMEOUT') THEN a.e + 1 WHEN b.o IN ('SUCCESS_200', 'NOT_MODIFIED_304') THEN 0 ELSE a.e END,
  'ok': CASE WHEN b.o IN ('SUCCESS_200', 'NOT_MODIFIED_304') THEN b.t ELSE a.ok END, 't': b.t, 'o': ''}}) AS s FROM {_FETCH} WHERE host IS NOT NULL GROUP BY host)""",
)
def host_backoff(spark, d):
    return folds.host_backoff(fetches(spark, d)).withColumn("backoff", F.round("backoff", 6))


_RECRAWL = f"""(SELECT url, s.i AS interval_ms, round(s.r, 9) AS rate, s.n AS n_fetches, s.c AS n_changes, s.u AS n_unchanged, s.lc AS last_changed_ms, s.t + s.i AS next_ms FROM (SELECT url, list_reduce(
  list_prepend({{'i': 3600000::BIGINT, 'r': 1.0::DOUBLE, 'n': 0, 'c': 0, 'u': 0, 'lc': min(at_ms), 't': 0::BIGINT, 'ch': false}}, list({{'i': 0::BIGINT, 'r': 0.0::DOUBLE, 'n': 0, 'c': 0, 'u': 0, 'lc': 0::BIGINT, 't': at_ms, 'ch': changed}} ORDER BY at_ms, fetch_id)),
  lambda a, b: {{'i': CASE WHEN b.ch THEN greatest(900000, a.i // 2) ELSE least(2592000000, a.i * 2) END,
  'r': 0.7 * a.r + 0.3 * ((a.c + CASE WHEN b.ch THEN 1 ELSE 0 END) / greatest(1.0, abs(b.t - CASE WHEN b.ch THEN b.t ELSE a.lc END) / 86400000.0::DOUBLE)),
  'n': a.n + 1, 'c': a.c + CASE WHEN b.ch THEN 1 ELSE 0 END, 'u': CASE WHEN b.ch THEN 0 ELSE a.u + 1 END, 'lc': CASE WHEN b.ch THEN b.t ELSE a.lc END, 't': b.t, 'ch': false}}) AS s
  FROM (SELECT *, outcome = 'SUCCESS_200' AS changed FROM {_FETCH} WHERE url IS NOT NULL) GROUP BY url))"""


def _recrawl(spark, d):
    f = fetches(spark, d).where(F.col("url").isNotNull()).select("url", "at_ms", "seq", (F.col("outcome") == "SUCCESS_200").alias("changed"))
    return folds.recrawl_state(f)


@query("recrawl_state", f"SELECT * FROM {_RECRAWL}")
def recrawl_state(spark, d):
    return _recrawl(spark, d).withColumn("rate", F.round("rate", 9))


_DUE_MS = 1_895_000_000_000


@query("recrawl_due", f"SELECT r.url, round(ln(1 + rate) * coalesce(o.history, 0), 6) AS priority FROM {_RECRAWL} r LEFT JOIN ({_OPIC}) o ON r.url = o.url WHERE next_ms <= {_DUE_MS} ORDER BY priority DESC, r.url LIMIT 50")
def recrawl_due(spark, d):
    state = _recrawl(spark, d).withColumn("rate", F.round("rate", 9))
    ranked = state.where(F.col("next_ms") <= _DUE_MS).join(_opic(spark, d).select("url", "history"), "url", "left")
    return ranked.select("url", F.round(F.log1p("rate") * F.coalesce("history", F.lit(0.0)), 6).alias("priority")).orderBy(F.desc("priority"), "url").limit(50)


@query("recrawl_overdue", f"SELECT count(*) AS n_overdue FROM {_RECRAWL} WHERE next_ms <= {_DUE_MS}")
def recrawl_overdue(spark, d):
    return _recrawl(spark, d).where(F.col("next_ms") <= _DUE_MS).agg(F.count("*").alias("n_overdue"))


def _grants(rows: str) -> str:
    return f"""WITH g AS (SELECT host, list_reduce(list_prepend({{'clock': NULL::BIGINT, 't': 0::BIGINT, 'id': 0::BIGINT, 'out': []::STRUCT(id BIGINT, granted BOOLEAN, wait BIGINT)[]}},
  list({{'clock': NULL::BIGINT, 't': at_ms, 'id': fetch_id, 'out': []::STRUCT(id BIGINT, granted BOOLEAN, wait BIGINT)[]}} ORDER BY at_ms, fetch_id)),
  lambda a, b: CASE WHEN a.clock IS NULL OR a.clock <= b.t THEN {{'clock': b.t + 60000, 't': b.t, 'id': b.id, 'out': list_append(a.out, {{'id': b.id, 'granted': true, 'wait': 0::BIGINT}})}}
    ELSE {{'clock': a.clock, 't': b.t, 'id': b.id, 'out': list_append(a.out, {{'id': b.id, 'granted': false, 'wait': a.clock - b.t}})}} END) AS s FROM {rows} WHERE host IS NOT NULL GROUP BY host)
SELECT host, o.id AS seq, o.granted AS granted, o.wait AS wait_ms FROM g, unnest(s.out) u(o)"""


@query("politeness_grants", _grants(_FETCH))
def politeness_grants(spark, d):
    return folds.politeness_grants(fetches(spark, d), 60_000)


# --- Robots and scope ----------------------------------------------------------

_ROBOTS = r"""b AS (SELECT doc_id, text FROM documents WHERE doc_type = 'robots' AND text IS NOT NULL),
l AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '#.*$', ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS line FROM (SELECT doc_id, unnest(range(len(string_split_regex(text, '\r?\n')))) AS line_no, unnest(string_split_regex(text, '\r?\n')) AS line FROM b)),
d AS (SELECT doc_id, line_no, lower(regexp_replace(split_part(line, ':', 1), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS directive, regexp_replace(line[instr(line, ':')+1:], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS value FROM l WHERE instr(line, ':') > 1),
g AS (SELECT *, sum(CASE WHEN directive = 'user-agent' AND coalesce(prev, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM (SELECT *, lag(directive) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM d WHERE directive <> 'sitemap')),
a AS (SELECT DISTINCT doc_id, g, lower(value) AS agent FROM g WHERE directive = 'user-agent'),
r AS (SELECT DISTINCT doc_id, agent, directive AS kind, value AS pattern FROM g JOIN a USING (doc_id, g) WHERE directive IN ('allow', 'disallow') AND value <> '')"""


def _robots(spark, d):
    return table(spark, d, "documents").where((F.col("doc_type") == "robots") & F.col("text").isNotNull()).select("doc_id", "text")


@query("robots_rules", f"WITH {_ROBOTS} SELECT * FROM r")
def robots_rules(spark, d):
    return robots.rule_table(_robots(spark, d), "doc_id", "text")


_ASK = ", ".join(f"('{b}', '{p}')" for b in BOTS for p in PROBES)


@query(
    "robots_verdicts",
    f"""WITH {_ROBOTS}, q AS (SELECT doc_id, bot AS agent, path, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.agent = bot) THEN bot ELSE '*' END AS chosen FROM b, (VALUES {_ASK}) v(bot, path))
SELECT q.doc_id, q.agent, q.path, CASE WHEN max(length(pattern)) FILTER (WHERE kind = 'disallow' AND starts_with(q.path, pattern)) > coalesce(max(length(pattern)) FILTER (WHERE kind = 'allow' AND starts_with(q.path, pattern)), -1) THEN 'DISALLOWED' ELSE 'ALLOWED' END AS verdict
FROM q LEFT JOIN r ON r.doc_id = q.doc_id AND r.agent = q.chosen GROUP BY q.doc_id, q.agent, q.path""",
)
def robots_verdicts(spark, d):
    body = _robots(spark, d)
    asks = F.array(*[F.struct(F.lit(b).alias("agent"), F.lit(p).alias("path")) for b in BOTS for p in PROBES])
    probes = body.select("doc_id", F.explode(asks).alias("q")).select("doc_id", "q.agent", "q.path")
    return robots.verdicts(probes, robots.rule_table(body, "doc_id", "text"), robots.agent_table(body, "doc_id", "text"), "doc_id")


_ANSWERS = [(200, None, None, None), (404, None, None, None), (503, None, None, None), (0, "timeout", None, None), (500, None, "FETCHED", 25 * 3_600_000), (500, None, "FETCHED", 8 * 86_400_000), (500, None, "STALE_SERVE", 3_600_000), (0, "refused", "FETCHED", 3_600_000), (301, None, None, None)]


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_POLICY = "(VALUES " + ", ".join("(" + ", ".join(map(_literal, a)) + ")" for a in _ANSWERS) + ") v(status, error, previous, age_ms)"


@query(
    "robots_cache_policy",
    f"""SELECT status, error, previous, age_ms::BIGINT AS age_ms, source, CASE WHEN source IN ('FETCHED', 'ALLOW_ALL_4XX') THEN 86400000 ELSE 3600000 END::BIGINT AS ttl_ms FROM (SELECT *, CASE
  WHEN (error IS NOT NULL OR status >= 500) AND coalesce(previous = 'FETCHED' AND age_ms < 604800000, false) THEN 'STALE_SERVE' WHEN error IS NOT NULL OR status >= 500 THEN 'DISALLOW_ALL_5XX'
  WHEN status BETWEEN 200 AND 299 THEN 'FETCHED' WHEN status BETWEEN 400 AND 499 THEN 'ALLOW_ALL_4XX' ELSE 'DISALLOW_ALL_5XX' END AS source FROM {_POLICY})""",
)
def robots_cache_policy(spark, d):
    df = spark.createDataFrame(_ANSWERS, "status int, error string, previous string, age_ms bigint")
    source, ttl = robots.cache_policy(F.col("status"), F.col("error"), F.col("previous"), F.col("age_ms"))
    return df.select("*", source.alias("source"), ttl.cast("bigint").alias("ttl_ms"))


def _duck_rules(rules: list[str]) -> str:
    return " OR ".join(f"ends_with(host, '{r[1:]}')" if r.startswith("*.") else f"host = '{r}'" for r in rules)


_SCOPE = f"(SELECT DISTINCT value AS url, CASE WHEN {_duck_rules(DENY)} THEN 'DENY' WHEN {_duck_rules(ALLOW)} THEN 'ALLOW' ELSE 'DENY' END AS verdict FROM {_URLS} WHERE value IS NOT NULL)"


def _scope(spark, d):
    p = targets(spark, d).select(url.present(url.url_parts(F.col("target_url"))).alias("p"))
    return p.select(F.col("p.value").alias("url"), robots.scope_verdict(F.col("p.host"), ALLOW, DENY).alias("verdict")).distinct()


@query("scope_verdicts", f"SELECT * FROM {_SCOPE}")
def scope_verdicts(spark, d):
    return _scope(spark, d)


@query("seed_submit", f"SELECT verdict, count(*) AS n FROM {_SCOPE} GROUP BY verdict")
def seed_submit(spark, d):
    return _scope(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


# --- Routing -------------------------------------------------------------------


def _ring(agents: list[str]) -> str:
    names = ", ".join(f"'{a}'" for a in agents)
    source = f"(SELECT agent, v, agent || ':' || v AS name FROM (SELECT unnest([{names}]) AS agent), range({VNODES}) t(v))"
    return f"(SELECT agent, {signed('h')} AS position FROM {mixed(source, 'agent, name', 'name')})"


def _owned(agents: list[str]) -> str:
    return f"(SELECT k.host, coalesce(r.agent, (SELECT arg_min(agent, position) FROM {_ring(agents)})) AS agent FROM (SELECT host, {signed('h')} AS k FROM {mixed(_HOSTS, 'host', 'host')}) k ASOF LEFT JOIN {_ring(agents)} r ON k.k <= r.position)"


@query("ring_positions", f"SELECT * FROM {_ring(AGENTS)}")
def ring_positions(spark, d):
    return routing.ring_table(spark, AGENTS, VNODES)


@query("ring_owner", f"SELECT * FROM {_owned(AGENTS)}")
def ring_owner(spark, d):
    return hosts(spark, d).select("host", routing.ring_owner(F.col("host"), AGENTS, VNODES).alias("agent"))


@query(
    "ring_owners3",
    f"""WITH r AS {_ring(AGENTS)}, k AS (SELECT host, {signed('h')} AS k FROM {mixed(_HOSTS, 'host', 'host')}), n AS (SELECT host, agent, min(CASE WHEN position >= k THEN 0 ELSE 1 END * 100000::BIGINT + place) AS nth
  FROM k, (SELECT *, row_number() OVER (ORDER BY position) AS place FROM r) GROUP BY host, agent) SELECT host, list(agent ORDER BY nth)[1:3] AS agents FROM n GROUP BY host""",
)
def ring_owners3(spark, d):
    return hosts(spark, d).select("host", routing.ring_owners(F.col("host"), AGENTS, VNODES, 3).alias("agents"))


@query("ring_load", f"SELECT agent, count(*) AS n_hosts FROM {_owned(AGENTS)} GROUP BY agent")
def ring_load(spark, d):
    return ring_owner(spark, d).groupBy("agent").agg(F.count("*").alias("n_hosts"))


@query("ring_moved", f"SELECT count(*) AS n_hosts, count(*) FILTER (WHERE a.agent <> b.agent) AS n_moved FROM {_owned(AGENTS)} a JOIN {_owned([*AGENTS, 'agent-99'])} b USING (host)")
def ring_moved(spark, d):
    h = hosts(spark, d).select(routing.ring_owner(F.col("host"), AGENTS, VNODES).alias("a"), routing.ring_owner(F.col("host"), [*AGENTS, "agent-99"], VNODES).alias("b"))
    return h.agg(F.count("*").alias("n_hosts"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_moved"))


_HOT = f"(SELECT {duck_host('host')} AS host, list_concat([owning_agent], coalesce(spillover_agents, [])) AS agents, split_factor FROM hot_host_policies QUALIFY row_number() OVER (PARTITION BY {duck_host('host')} ORDER BY configured_at DESC, owning_agent DESC) = 1)"


@query("hot_executor", f"SELECT u.value AS url, p.agents[((h & 9223372036854775807::UHUGEINT)::BIGINT % split_factor + 1)] AS agent FROM {mixed(f'(SELECT DISTINCT value, host FROM {_URLS} WHERE value IS NOT NULL)', 'value, host', 'value')} u JOIN {_HOT} p USING (host)")
def hot_executor(spark, d):
    u = targets(spark, d).select(url.present(url.url_parts(F.col("target_url"))).alias("p")).select(F.col("p.value").alias("url"), F.col("p.host").alias("host")).distinct()
    hot = routing.participants(table(spark, d, "hot_host_policies"))
    return u.join(hot, "host").select("url", routing.hot_executor(F.col("url"), F.col("agents"), F.col("split")).alias("agent"))


@query("forward_batches", "SELECT target_agent, (k // 100)::BIGINT AS batch_no, count(*) AS n_messages, min(delivery_id) AS first_id FROM (SELECT target_agent, delivery_id, row_number() OVER (PARTITION BY target_agent ORDER BY delivery_id) - 1 AS k FROM forwarding_batches WHERE target_agent IS NOT NULL) GROUP BY ALL")
def forward_batches(spark, d):
    placed = graph.batches(table(spark, d, "forwarding_batches").select("target_agent", "delivery_id"), "target_agent", "delivery_id")
    return placed.groupBy("target_agent", "batch_no").agg(F.count("*").alias("n_messages"), F.min("delivery_id").alias("first_id"))


_MEMBERS = [("agent-00", 5, "ALIVE", 1_000), ("agent-01", 3, "DEAD", 2_000), ("agent-02", 2, "ALIVE", 90_000), ("agent-03", 2, "SUSPECT", 60_000)]
_GOSSIP = [("agent-00", 3, "DEAD", 9_000), ("agent-01", 3, "ALIVE", 9_000), ("agent-02", 2, "SUSPECT", 9_000), ("agent-04", 1, "ALIVE", 99_000)]
_MEMBER = "agent_id string, generation int, status string, heartbeat_ms bigint"


def _duck_members(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', {g}, '{s}', {h}::BIGINT)" for a, g, s, h in rows) + ")"


@query("membership_merge", f"SELECT agent_id, generation, status, heartbeat_ms FROM (SELECT *, 1 AS mine FROM {_duck_members(_MEMBERS)} v(agent_id, generation, status, heartbeat_ms) UNION ALL SELECT *, 0 FROM {_duck_members(_GOSSIP)} w) QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY generation DESC, CASE status WHEN 'DEAD' THEN 2 WHEN 'SUSPECT' THEN 1 ELSE 0 END DESC, mine DESC) = 1")
def membership_merge(spark, d):
    return routing.merge_members(spark.createDataFrame(_MEMBERS, _MEMBER), spark.createDataFrame(_GOSSIP, _MEMBER))


@query("membership_liveness", f"SELECT agent_id, generation, CASE WHEN status = 'ALIVE' AND 100000 - heartbeat_ms > 5000 THEN 'SUSPECT' WHEN status = 'SUSPECT' AND 100000 - heartbeat_ms > 15000 THEN 'DEAD' ELSE status END AS status, CASE WHEN (status = 'ALIVE' AND 100000 - heartbeat_ms > 5000) OR (status = 'SUSPECT' AND 100000 - heartbeat_ms > 15000) THEN 100000 ELSE heartbeat_ms END AS heartbeat_ms FROM {_duck_members(_MEMBERS)} v(agent_id, generation, status, heartbeat_ms)")
def membership_liveness(spark, d):
    return routing.evaluate_liveness(spark.createDataFrame(_MEMBERS, _MEMBER), 100_000)


# --- DNS -----------------------------------------------------------------------

def _answers(spark, d) -> DataFrame:
    """Derived answers: address and life time come from the length of the host's name."""
    h = targets(spark, d).select(url.url_parts(F.col("target_url"))["host"].alias("host")).where(F.col("host").isNotNull()).distinct()
    size = F.length("host")
    return h.select("host", F.array(F.concat(F.lit("10.0.0."), (size % 8).cast("string")), F.concat(F.lit("10.0.1."), (size % 5).cast("string"))).alias("ips"), F.lit(NOW_MS).alias("now_ms"), (F.lit(NOW_MS) + size * 200_000 - 3_000_000).alias("expires_ms"))


_DUCK_DNS = f"(SELECT host, ['10.0.0.' || length(host) % 8, '10.0.1.' || length(host) % 5] AS ips, {NOW_MS}::BIGINT AS now_ms, {NOW_MS}::BIGINT + length(host) * 200000 - 3000000 AS expires_ms FROM (SELECT DISTINCT host FROM {_URLS} WHERE host IS NOT NULL))"


@query("dns_ttl", f"SELECT host, least(greatest(expires_ms, now_ms + 60000), now_ms + 3600000) AS positive_ms, least(expires_ms, now_ms + 300000) AS negative_ms FROM {_DUCK_DNS}")
def dns_ttl(spark, d):
    a = _answers(spark, d)
    return a.select("host", metrics.clamp_positive(F.col("now_ms"), F.col("expires_ms")).alias("positive_ms"), metrics.clamp_negative(F.col("now_ms"), F.col("expires_ms")).alias("negative_ms"))


@query("dns_reverse", f"SELECT DISTINCT unnest(ips) AS ip, host FROM {_DUCK_DNS}")
def dns_reverse(spark, d):
    return metrics.hosts_by_address(_answers(spark, d))


# --- Archive and audit ---------------------------------------------------------

_DUCK_FIELD = "CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || replace(replace({c}::VARCHAR, chr(92), chr(92)||chr(92)), '\"', chr(92)||'\"') || '\"' END"
_CDX = url_table("cdxj_entries", "url", "captured_at, mime_type, http_status, payload_digest, payload_length, warc_filename, warc_offset")


def _duck_line() -> str:
    fields = [("url", "value"), ("mime", "mime_type"), ("status", "http_status"), ("digest", "payload_digest"), ("length", "payload_length"), ("filename", "warc_filename"), ("offset", "warc_offset")]
    return " || ', ' || ".join(f"'\"{k}\": ' || {_DUCK_FIELD.format(c=c)}" for k, c in fields)


@query("cdxj_lines", f"SELECT surt, captured_at, surt || ' ' || strftime(captured_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') || ' {{' || {_duck_line()} || '}}' AS line FROM (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || CASE WHEN query IS NOT NULL THEN '?' || query ELSE '' END AS surt FROM {_CDX} WHERE value IS NOT NULL)")
def cdxj_lines(spark, d):
    return archive.index_lines(table(spark, d, "cdxj_entries"))


@query("warc_records", f"SELECT DISTINCT ON (fetch_id) fetch_id, octet_length(body) AS payload_length, 'sha1:' || sha1(body) AS digest, {_duck_instant('fetched_at')} AS warc_date FROM fetch_results WHERE body IS NOT NULL")
def warc_records(spark, d):
    f = table(spark, d, "fetch_results").where(F.col("body").isNotNull()).select("fetch_id", "body", "fetched_at").dropDuplicates(["fetch_id"])
    return f.select("fetch_id", F.octet_length("body").cast("bigint").alias("payload_length"), archive.sha1_digest(F.col("body")).alias("digest"), archive.iso_instant(F.col("fetched_at")).alias("warc_date"))


_RECORD = f"""encode('WARC/1.1' || crlf || 'WARC-Type: response' || crlf || 'WARC-Target-URI: ' || value || crlf || 'WARC-Date: ' || {_duck_instant('fetched_at')} || crlf
  || 'WARC-Record-ID: <urn:uuid:00000000-0000-4000-8000-' || lpad(fetch_id::VARCHAR, 12, '0') || '>' || crlf || 'Content-Type: application/http; msgtype=response' || crlf || 'Content-Length: ' || octet_length(body) || crlf
  || 'WARC-Payload-Digest: sha1:' || sha1(body) || crlf || 'WARC-Block-Digest: sha1:' || sha1(body) || crlf || crlf) || body || encode(crlf || crlf)"""


@query("warc_bytes", f"SELECT fetch_id, sha256(record) AS sha256, octet_length(record)::INTEGER AS size FROM (SELECT DISTINCT ON (fetch_id) fetch_id, {_RECORD} AS record FROM (SELECT *, chr(13) || chr(10) AS crlf FROM {url_table('fetch_results', 'final_url', 'fetch_id, body, fetched_at')} WHERE body IS NOT NULL))")
def warc_bytes(spark, d):
    f = table(spark, d, "fetch_results").where(F.col("body").isNotNull()).select("fetch_id", "final_url", "body", "fetched_at").dropDuplicates(["fetch_id"])
    record_id = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("fetch_id").cast("string"), 12, "0"))
    record = archive.warc_record("response", url.canon_url(F.col("final_url")), F.col("fetched_at"), record_id, F.col("body"))
    return f.select("fetch_id", F.sha2(record, 256).alias("sha256"), F.octet_length(record).alias("size"))


@query(
    "warc_roll",
    """WITH s AS (SELECT warc_filename AS part, list_reduce(list_prepend({'n': 0::BIGINT, 'u': 0::BIGINT, 'z': 0::BIGINT, 'k': 0::BIGINT, 'out': []::STRUCT(k BIGINT, n BIGINT)[]},
 list({'n': 0::BIGINT, 'u': 0::BIGINT, 'z': payload_length, 'k': warc_offset, 'out': []::STRUCT(k BIGINT, n BIGINT)[]} ORDER BY warc_offset)),
 lambda a, b: CASE WHEN a.u > 0 AND a.u + b.z > 20000 THEN {'n': a.n + 1, 'u': b.z, 'z': b.z, 'k': b.k, 'out': list_append(a.out, {'k': b.k, 'n': a.n + 1})}
  ELSE {'n': a.n, 'u': a.u + b.z, 'z': b.z, 'k': b.k, 'out': list_append(a.out, {'k': b.k, 'n': a.n})} END) AS s FROM (SELECT DISTINCT warc_filename, warc_offset, max(coalesce(payload_length, 0)) OVER (PARTITION BY warc_filename, warc_offset) AS payload_length FROM cdxj_entries WHERE warc_filename IS NOT NULL AND warc_offset IS NOT NULL) GROUP BY warc_filename)
SELECT part, o.k AS seq, o.n AS file_no FROM s, unnest(s.out) u(o)""",
)
def warc_roll(spark, d):
    r = table(spark, d, "cdxj_entries").where(F.col("warc_filename").isNotNull() & F.col("warc_offset").isNotNull()).groupBy(F.col("warc_filename").alias("part"), F.col("warc_offset").alias("seq")).agg(F.max(F.coalesce("payload_length", F.lit(0))).alias("size"))
    return folds.roll_files(r, 20_000)


@query(
    "redirects",
    """WITH RECURSIVE e AS (SELECT url AS source, min(final_url) AS target FROM fetch_results WHERE url <> final_url GROUP BY url),
w AS (SELECT DISTINCT url, url AS place, 0 AS hops FROM fetch_results WHERE url IS NOT NULL UNION ALL SELECT w.url, e.target, hops + 1 FROM w JOIN e ON w.place = e.source WHERE hops <= 5)
SELECT url, CASE WHEN max(hops) <= 5 THEN arg_max(place, hops) END AS final_url, max(hops)::INTEGER AS hops FROM w GROUP BY url""",
)
def redirects(spark, d):
    f = table(spark, d, "fetch_results").where(F.col("url") != F.col("final_url")).groupBy(F.col("url").alias("source")).agg(F.min("final_url").alias("target"))
    return archive.resolve_redirects(table(spark, d, "fetch_results").select("url").distinct(), f)


def _audit(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    digest = codec.audit_digest(F.col("event_id"), F.col("ts").cast("timestamp"), F.col("user_id"), F.col("event_type"), F.lit(None), F.lit(None), F.col("event_id"), F.create_map(F.lit("value"), F.col("value").cast("decimal(18,2)").cast("string")))
    return e.select(F.col("user_id").cast("string").alias("log"), F.col("event_id").alias("seq"), digest.alias("digest"))


_DIGEST = "(SELECT user_id::VARCHAR AS log, event_id AS seq, sha256(event_id || '|' || (epoch_us(ts) // 1000) || '|' || user_id || '|' || event_type || '|||' || event_id || '|' || 'value=' || (value::DECIMAL(18,2))::VARCHAR || ';') AS digest FROM events)"


@query("audit_digests", f"SELECT * FROM {_DIGEST}")
def audit_digests(spark, d):
    return _audit(spark, d)


@query("audit_chain", f"WITH c AS (SELECT log, list_reduce(list_prepend({{'h': repeat('0', 64), 'd': '', 's': 0::BIGINT}}, list({{'h': '', 'd': digest, 's': seq}} ORDER BY seq)), lambda a, b: {{'h': sha256(a.h || ':' || b.d), 'd': b.d, 's': b.s}}) AS x, count(*) AS n FROM {_DIGEST} GROUP BY log) SELECT log, n AS n_events, x.h AS last_hash FROM c")
def audit_chain(spark, d):
    return folds.audit_chain(_audit(spark, d)).groupBy("log").agg(F.count("*").alias("n_events"), F.max_by("hash", "seq").alias("last_hash"))


@query("audit_tamper", "SELECT log, coalesce(min(k) FILTER (WHERE event_id % 197 = 0), -1)::BIGINT AS index FROM (SELECT user_id::VARCHAR AS log, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) GROUP BY log")
def audit_tamper(spark, d):
    """Chains in which the content of some events was changed afterwards."""
    chain = folds.audit_chain(_audit(spark, d))
    changed = F.when(F.col("seq") % 197 == 0, F.sha2("digest", 256)).otherwise(F.col("digest"))
    return folds.first_tampered(chain.withColumn("digest", changed))


@query("audit_tail", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def audit_tail(spark, d):
    return table(spark, d, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(50)


# --- Metrics and frontier ------------------------------------------------------

_TIMER = """(SELECT event_type, count(*) AS n_samples, list(value ORDER BY value) FILTER (WHERE k <= 1024) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY event_type)"""


@query("timer_percentiles", f"SELECT event_type, n_samples, v[least(floor(len(v) * 0.5), len(v) - 1)::INT + 1] AS p50, v[least(floor(len(v) * 0.99), len(v) - 1)::INT + 1] AS p99, v[-1] AS max FROM {_TIMER}")
def timer_percentiles(spark, d):
    return metrics.timer_percentiles(table(spark, d, "events"), "event_type", "value", ["ts", "event_id"])


@query("last_n", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1024")
def last_n(spark, d):
    return metrics.last_rows(table(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_type", "event_id")


@query("prometheus", "SELECT 'events.' || event_type AS name, '# TYPE events_' || event_type || ' counter' || chr(10) || 'events_' || event_type || ' ' || count(*) || chr(10) AS text FROM events GROUP BY event_type")
def prometheus(spark, d):
    c = table(spark, d, "events").groupBy(F.concat(F.lit("events."), "event_type").alias("name")).agg(F.count("*").alias("value"))
    return metrics.prometheus(c)


@query("latest_action", "SELECT user_id, arg_max(event_type, event_id) AS action FROM events GROUP BY user_id")
def latest_action(spark, d):
    return metrics.latest_action(table(spark, d, "events").withColumn("action", F.col("event_type")), "user_id", ["event_id"])


_QUEUE = f"(SELECT DISTINCT ON (entry_id) *, {duck_host('host_name')} AS host FROM back_queue_entries)"


def _queue(spark, d) -> DataFrame:
    q = table(spark, d, "back_queue_entries").dropDuplicates(["entry_id"])
    return q.withColumn("host", url.canon_host(F.col("host_name")))


@query("frontier_claims", f"SELECT host, entry_id, (k - 1) * 1000 AS due_ms FROM (SELECT host, entry_id, row_number() OVER (PARTITION BY host ORDER BY discovered_at_epoch_ms, entry_id) AS k FROM {_QUEUE} WHERE host IS NOT NULL) ORDER BY due_ms, host, entry_id LIMIT 500")
def frontier_claims(spark, d):
    return graph.claim_order(_queue(spark, d), ["discovered_at_epoch_ms", "entry_id"], 500)


@query("frontier_positions", f"SELECT host, entry_id, row_number() OVER (PARTITION BY host ORDER BY discovered_at_epoch_ms, entry_id) AS position FROM {_QUEUE} WHERE host IS NOT NULL")
def frontier_positions(spark, d):
    return graph.frontier_positions(_queue(spark, d), ["discovered_at_epoch_ms", "entry_id"]).select("host", "entry_id", "position")


_CLASS_COUNTS = ", ".join(f"count(*) FILTER (WHERE priority_class = '{c}') AS n_{c.lower()}" for c in CLASSES)


@query("frontier_stats", f"SELECT count(*) AS n_entries, count(DISTINCT host) AS n_hosts, min(discovered_at_epoch_ms) AS oldest_ms, {_CLASS_COUNTS} FROM {_QUEUE}")
def frontier_stats(spark, d):
    return graph.frontier_stats(_queue(spark, d), CLASSES)


# --- Streams, crawl and simulation ---------------------------------------------


@query("stream_new_urls", "SELECT DISTINCT target_url FROM extracted_links WHERE target_url IS NOT NULL")
def stream_new_urls(spark, d):
    schema = T.StructType([T.StructField("target_url", T.StringType())])
    arriving = parquet_stream(spark, f"{d}/extracted_links.parquet", schema, 8).where(F.col("target_url").isNotNull())
    return keyed.run_to_files(keyed.new_urls(arriving, "target_url"), "new-urls")


@query("stream_politeness", _grants(f"(SELECT fetch_id, host, epoch_us(fetched_at) // 1000 AS at_ms FROM {_FETCH_URLS})"))
def stream_politeness(spark, d):
    schema = T.StructType([T.StructField("fetch_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("fetched_at", T.TimestampType())])
    claims = parquet_stream(spark, f"{d}/fetch_results.parquet", schema, 8).select(F.col("fetch_id").alias("seq"), F.unix_millis("fetched_at").alias("at_ms"), url.present(url.url_parts(F.col("url"))["host"]).alias("host"))
    return keyed.run_to_files(keyed.politeness_stream(claims, 60_000), "grants")


@query("crawl_waves")
def crawl_waves(spark, d):
    """Crawl from the seeds of the forwarded batches over the fetched pages, until the frontier is empty."""
    each = table(spark, d, "forwarding_batches").select(F.explode("urls").alias("e")).where(F.col("e.discovered_from_url").isNull())
    f = table(spark, d, "fetch_results").where(F.col("body").isNotNull())
    pages = f.select(url.present(url.canon_url(F.col("final_url"))).alias("url"), "body", "content_type").dropDuplicates(["url"])
    pages = materialize(pages, "crawl-pages")
    bodies = table(spark, d, "documents").where(F.col("doc_type") == "robots").groupBy(F.col("source").alias("host")).agg(F.max_by("text", "doc_id").alias("body"))
    stats, _ = crawl.crawl(each.select(F.col("e.url").alias("url")), lambda urls: fetch.fetch_from(urls, pages), bodies, 10**12)
    return spark.createDataFrame([tuple(vars(stats).values())], ", ".join(f"{k} bigint" for k in vars(stats)))


@query("network_simulation")
def network_simulation(spark, d):
    sent = table(spark, d, "forwarding_batches").select("delivery_id", F.unix_millis("emitted_at").alias("sent_at_ms"))
    return simulate.traffic(simulate.send(sent, "delivery_id", 7, 0.1, 50, 5000), NOW_MS - 10 * folds.DAY_MS)
