"""URL and host functions (F1-F6) as native columns.

Nothing here leaves the JVM. The grammar is RFC 2396 with any non-ASCII character
that is neither a space nor a control character allowed, and a host that must be a
plain DNS name or IPv4 address. Invalid input gives NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters no component may hold: controls, blanks and the "unwise" ASCII marks.
_BAD = r'\x00-\x20"<>\\^`{|}\x7f\p{Z}\p{Cc}'
_USER = rf"[^{_BAD}\[\]?#/@]*"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_TOP = r"[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HOST = rf"(?:(?:{_OCTET}\.){{3}}{_OCTET}|(?:{_LABEL}\.)+{_TOP}\.?|{_LABEL}\.?)"
_PATH = rf"(?:/[^{_BAD}\[\]?#]*)?"
_QUERY = rf"(?:\?[^{_BAD}#]*)?"
_FRAGMENT = rf"(?:#[^{_BAD}#]*)?"
#: Groups: scheme, host, port, path, query with its question mark.
URL = rf"^([Hh][Tt][Tt][Pp][Ss]?)://(?:{_USER}@)?({_HOST})(?::([0-9]*))?({_PATH})({_QUERY}){_FRAGMENT}$"
_BROKEN_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_NEEDS_FOLD = r"//|/\.\.?(?:/|$)"
HOST_RULE = r"^(?=.{1,253}$)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*$"


_BLANKS = "".join(map(chr, range(0x21)))
#: Joins the groups of a matched URL; no URL holds it.
_MARK = "\x01"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def present(value: Column) -> Column:
    """A generator that gives ``value`` where it is not NULL and drops the row where it is.

    Unlike a filter it is never pushed below the projection, which would compute an
    expensive value twice.
    """
    return F.explode(F.array_compact(F.array(value)))


def java_trim(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def _without_dot(host: Column) -> Column:
    return F.when(host.endswith("."), F.left(host, F.length(host) - 1)).otherwise(host)


def canon_host(raw: Column) -> Column:
    """trimmed, lower-case host without one trailing dot; NULL when invalid."""
    return let(F.lower(java_trim(raw)), lambda low: let(_without_dot(low), lambda host: F.when(host.rlike(HOST_RULE), host)))


def fold_path(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments and repeated slashes; a leading ``..`` stays."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    none = F.array().cast("array<string>")

    def step(stack: Column, part: Column) -> Column:
        top = F.try_element_at(stack, F.lit(-1))
        climbs = (part == "..") & top.isNotNull() & (top != "..")
        kept = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(part == ".", stack).when(climbs, kept).otherwise(F.concat(stack, F.array(part)))

    folded = F.aggregate(parts, none, step)
    open_end = path.rlike(r"(?:/|/\.)$") | (path.endswith("/..") & ~F.coalesce(F.try_element_at(folded, F.lit(-1)) == "..", F.lit(False)))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when(F.size(folded) == 0, F.lit("/")).when(open_end, F.concat(joined, F.lit("/"))).otherwise(joined)


def url_parts(raw: Column) -> Column:
    """F1 in full: struct(value, host, scheme, path, query, port), NULL when rejected.

    The URL pattern is matched once; its groups come out joined by a mark.
    """
    groups = lambda text: F.when(
        ~text.contains(_MARK) & ~text.rlike(_BROKEN_ESCAPE),
        F.split(F.regexp_replace(text, URL, _MARK.join(f"${k}" for k in range(1, 6))), _MARK, -1),
    )
    return let(let(java_trim(raw), groups), lambda g: F.when(F.size(g) == 5, let(_without_dot(F.lower(g[1])), lambda host: _assemble(g, host))))


def _assemble(g: Column, host: Column) -> Column:
    scheme, digits, raw_path, query = F.lower(g[0]), g[2], g[3], g[4]
    number = digits.try_cast("int")
    valid = host.rlike(HOST_RULE) & ((digits == "") | number.isNotNull())
    port = F.when((digits == "") | (number == default_port(scheme)), F.lit(-1)).otherwise(number)
    path = F.when(raw_path == "", F.lit("/")).when(raw_path.rlike(_NEEDS_FOLD), fold_path(raw_path)).otherwise(raw_path)
    inner = F.when(query != "", F.substring(query, 2, 2_000_000_000))
    value = F.concat(scheme, F.lit("://"), host, F.when(port != -1, F.concat(F.lit(":"), port.cast("string"))).otherwise(""), path, query)
    return F.when(valid, F.struct(value.alias("value"), host.alias("host"), scheme.alias("scheme"), path.alias("path"), inner.alias("query"), port.alias("port")))


def canon_url(raw: Column) -> Column:
    """the canonical spelling of an http(s) URL, NULL when rejected."""
    return url_parts(raw)["value"]


def default_port(scheme: Column) -> Column:
    """F6."""
    return F.when(scheme == "http", F.lit(80)).when(scheme == "https", F.lit(443)).otherwise(F.lit(-1))


def surt_host(host: Column) -> Column:
    """labels in reverse order, joined by commas."""
    return F.array_join(F.reverse(F.split(host, "[.]")), ",")


def surt_key(parts: Column) -> Column:
    """sort key of a struct from :func:`url_parts`."""
    query = F.when(parts["query"].isNotNull(), F.concat(F.lit("?"), parts["query"])).otherwise("")
    return F.concat(surt_host(parts["host"]), F.lit(")"), parts["path"], query)


def registrable_domain(host: Column) -> Column:
    """the last two labels."""
    return F.substring_index(host, ".", -2)


def site_of(url: Column) -> Column:
    """Lower-case host of a URL without port and without one leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
