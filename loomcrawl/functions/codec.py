"""Record codecs as native columns: events, index lines, audit digests, metric text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def json_escape(text: Column) -> Column:
    """backslash and double quote only."""
    return replace(replace(text, "\\", "\\\\"), '"', '\\"')


def truncate(text: Column, size: int) -> Column:
    """First ``size`` characters; NULL becomes empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, size)


def kv_value(value: Column) -> Column:
    """Quoted when it holds a blank, a quote or a line feed, and then escaped."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    escaped = replace(replace(replace(text, "\\", "\\\\"), '"', '\\"'), "\n", "\\n")
    return F.when(text.rlike('[ "\\n]'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text)


def kv_line(**fields: Column) -> Column:
    """key=value pairs in the given order."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), kv_value(v)) for k, v in fields.items()])


def cdxj_time(ts: Column) -> Column:
    """F21."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def cdxj_line(surt: Column, ts: Column, **fields: Column) -> Column:
    """K4: sort key, time and a JSON object whose values are all strings."""
    value = lambda v: F.when(v.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), json_escape(v.cast("string")), F.lit('"')))
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), value(v)) for k, v in fields.items()])
    return F.concat(surt, F.lit(" "), cdxj_time(ts), F.lit(" {"), body, F.lit("}"))


def audit_digest(seq: Column, at: Column, actor: Column, action: Column, url: Column, host: Column, request: Column, details: Column) -> Column:
    """sha256 of the fields, each followed by a bar, and the sorted details."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(*[F.concat(text(c), F.lit("|")) for c in (seq, F.unix_millis(at), actor, action, url, host, request)])
    entries = F.transform(F.array_sort(F.map_entries(details)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";")))
    return F.sha2(F.concat(head, F.coalesce(F.array_join(entries, ""), F.lit(""))), 256)


def metric_name(name: Column) -> Column:
    return F.translate(name, ".-", "__")


def http_date(text: Column) -> Column:
    """time of an RFC 1123 date, NULL when it is none."""
    inner = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    return F.try_to_timestamp(inner, F.lit("d MMM yyyy HH:mm:ss"))


def format_http_date(ts: Column) -> Column:
    """a time as an RFC 1123 date; the day of the month has no leading zero."""
    return F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def is_nofollow(rel: Column) -> Column:
    """F26."""
    return F.arrays_overlap(F.split(F.lower(F.coalesce(rel, F.lit(""))), r"\s+"), F.array(F.lit("nofollow"), F.lit("sponsored")))


def status_outcome(status: Column) -> Column:
    """F17; the order of the tests matters."""
    return (
        F.when(status == 304, "NOT_MODIFIED_304")
        .when(status.between(200, 299), "SUCCESS_200")
        .when(status.between(300, 399), "REDIRECT_3XX")
        .when(status == 429, "RATE_LIMITED_429")
        .when(status.between(400, 499), "CLIENT_ERROR_4XX")
        .when(status.between(500, 599), "SERVER_ERROR_5XX")
        .otherwise("NETWORK_ERROR")
    )


def error_outcome(error: Column) -> Column:
    """kinds of time-out, else a network error."""
    return F.when(F.lower(error).rlike("time[ds]? ?out"), "TIMEOUT").otherwise("NETWORK_ERROR")


def is_backoff(outcome: Column) -> Column:
    """F19."""
    return outcome.isin("SERVER_ERROR_5XX", "RATE_LIMITED_429", "NETWORK_ERROR", "TIMEOUT")


def is_success(outcome: Column) -> Column:
    """F19."""
    return outcome.isin("SUCCESS_200", "NOT_MODIFIED_304")
