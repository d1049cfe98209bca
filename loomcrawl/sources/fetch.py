"""Fetching through a pluggable function.

A fetcher is a plain Python function of one request; it runs inside ``mapInPandas``, so
requests of one batch go through one worker. The offline form joins a table of pages.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcrawl.functions.codec import error_outcome, status_outcome

RESPONSE = "url string, final_url string, http_status int, body binary, content_type string, error string, redirect_hop_count int"


@dataclass(frozen=True)
class FetchSettings:
    """Limits of a request."""

    connect_timeout_s: int = 5
    read_timeout_s: int = 30
    total_timeout_s: int = 60
    max_redirects: int = 5
    max_body_bytes: int = 10 * 1024 * 1024
    user_agent: str = "loomcrawl/0.1"
    contact: str | None = None


def fetch_with(urls: DataFrame, fetcher: Callable[[str, FetchSettings], dict], settings: FetchSettings = FetchSettings()) -> DataFrame:
    """Responses of ``fetcher`` for a column url. An exception becomes an error column, not a failed task."""
    columns = [c.split(" ")[0] for c in RESPONSE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    got = fetcher(url, settings)
                except Exception as e:  # noqa: BLE001 - any failure of the function is a failed fetch
                    got = {"error": f"{type(e).__name__}: {e}"}
                rows.append({"url": url, "final_url": url, "http_status": 0, "redirect_hop_count": 0} | got)
            kinds = {"http_status": "int32", "redirect_hop_count": "int32"}
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=kinds.get(c, object)) for c in columns})

    return with_outcome(urls.select("url").mapInPandas(run, RESPONSE), settings)


def http_fetcher(url: str, settings: FetchSettings, etag: str | None = None, last_modified: str | None = None) -> dict:
    """One GET over the network, redirects followed here so that each hop is counted.

    ``etag`` and ``last_modified`` make it conditional. More hops than allowed are an
    unfinished redirect of status 0; a redirect without a usable target is a plain answer.
    """
    import http.client
    from urllib.parse import urljoin, urlsplit

    headers = {"User-Agent": settings.user_agent, "Accept-Encoding": "identity"}
    if settings.contact:
        headers["From"] = settings.contact
    if etag:
        headers["If-None-Match"] = etag
    if last_modified:
        headers["If-Modified-Since"] = last_modified
    began, at = time.monotonic(), url
    for hop in range(settings.max_redirects + 1):
        parts = urlsplit(at)
        kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        connection = kind(parts.netloc, timeout=settings.connect_timeout_s)
        try:
            connection.connect()
            connection.sock.settimeout(settings.read_timeout_s)
            connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers)
            answer = connection.getresponse()
            target = answer.getheader("Location")
            moved = urljoin(at, target) if answer.status in (301, 302, 303, 307, 308) and target else ""
            if not moved.startswith(("http://", "https://")):
                body = bytearray()
                while len(body) < settings.max_body_bytes and (part := answer.read(65_536)):
                    body += part
                    if time.monotonic() - began > settings.total_timeout_s:
                        raise TimeoutError("timed out: total time")
                return {"final_url": at, "http_status": answer.status, "body": bytes(body[: settings.max_body_bytes]), "content_type": answer.getheader("Content-Type"), "redirect_hop_count": hop}
            at = moved
        finally:
            connection.close()
    return {"final_url": at, "http_status": 0, "redirect_hop_count": settings.max_redirects + 1}


def fetch_from(urls: DataFrame, pages: DataFrame, settings: FetchSettings = FetchSettings()) -> DataFrame:
    """Offline form of S1: responses from a table (url, body, content_type); other urls are 404."""
    met = urls.select("url").join(pages.select("url", "body", "content_type"), "url", "left")
    status = F.when(F.col("body").isNotNull(), 200).otherwise(404)
    found = met.select("url", F.col("url").alias("final_url"), status.alias("http_status"), "body", "content_type", F.lit(None).cast("string").alias("error"), F.lit(0).alias("redirect_hop_count"))
    return with_outcome(found, settings)


def capped_body(status: Column, body: Column, cap: int) -> Column:
    """S3: bodies of 2xx answers only, at most ``cap`` bytes."""
    return F.when(status.between(200, 299) & (F.octet_length(body) > 0), F.substring(body, 1, cap))


def with_outcome(responses: DataFrame, settings: FetchSettings) -> DataFrame:
    """Outcome of each response; too many redirects are an unfinished redirect."""
    over = F.col("redirect_hop_count") > settings.max_redirects
    outcome = F.when(F.col("error").isNotNull(), error_outcome(F.col("error"))).when(over, "REDIRECT_3XX").otherwise(status_outcome(F.col("http_status")))
    return responses.withColumn("http_status", F.when(over, 0).otherwise(F.col("http_status"))).withColumn("outcome", outcome).withColumn("body", capped_body(F.col("http_status"), F.col("body"), settings.max_body_bytes))


def needs_render(responses: DataFrame, renderer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Send the responses with a render reason through ``renderer``; others pass."""
    chosen = responses.where(F.col("reason").isNotNull())
    return responses.where(F.col("reason").isNull()).unionByName(renderer(chosen))


def as_rendered(responses: DataFrame) -> DataFrame:
    """A renderer that gives every page back as it is, for tests and dry runs."""
    return responses.select("*")


def render_counts(responses: DataFrame) -> DataFrame:
    """(reason, n): what a renderer would be given."""
    return responses.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
