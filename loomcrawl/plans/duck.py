"""SQL expressions that the test queries share (DuckDB dialect)."""

from __future__ import annotations

_BAD = r'\x00-\x20"<>\\^`{|}\x7f\pZ\p{Cc}'
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HOST = rf"(?:(?:{_OCTET}\.){{3}}{_OCTET}|(?:{_LABEL}\.)+[A-Za-z](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.?|{_LABEL}\.?)"
_URL = rf"^(?:[Hh][Tt][Tt][Pp])([Ss]?)://(?:[^{_BAD}\[\]?#/@]*@)?({_HOST})(?::([0-9]*))?((?:/[^{_BAD}\[\]?#]*)?)((?:\?[^{_BAD}#]*)?)(?:#[^{_BAD}#]*)?$"
_LABEL63 = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def canon_host(x: str) -> str:
    h = rf"regexp_replace(lower({trim(x)}), '\.$', '')"
    return rf"CASE WHEN length({h}) <= 253 AND regexp_full_match({h}, '{_LABEL63}(?:\.{_LABEL63})*') THEN {h} END"


def url_table(source: str, raw: str, keep: str = "") -> str:
    """A SELECT over ``source`` with (keep, value, host, scheme, path, query, port), rejected rows with NULL value."""
    url = _URL.replace("'", "''")
    keep = keep and keep + ", "
    return rf"""(WITH t0 AS (SELECT {keep}{trim(raw)} AS t FROM {source}),
t1 AS (SELECT *, regexp_matches(t, '{url}') AND NOT regexp_matches(regexp_replace(t, '%[0-9A-Fa-f][0-9A-Fa-f]', '', 'g'), '%') AS ok,
  'http' || lower(regexp_extract(t, '{url}', 1)) AS scheme, {canon_host(f"regexp_extract(t, '{url}', 2)")} AS host,
  regexp_extract(t, '{url}', 3) AS digits, regexp_extract(t, '{url}', 4) AS raw_path, regexp_extract(t, '{url}', 5) AS q FROM t0),
t2 AS (SELECT *, try_cast(nullif(digits, '') AS INTEGER) AS number,
  list_filter(string_split(raw_path, '/'), lambda s: s <> '') AS segs FROM t1),
t3 AS (SELECT *, list_reduce(list_prepend([]::VARCHAR[], list_transform(segs, lambda s: [s])),
  lambda a, b: CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[1:len(a)-1] ELSE list_concat(a, b) END) AS folded FROM t2),
t4 AS (SELECT *, CASE WHEN number IS NULL OR number = CASE scheme WHEN 'http' THEN 80 ELSE 443 END THEN -1 ELSE number END AS port,
  CASE WHEN len(folded) = 0 THEN '/' ELSE '/' || array_to_string(folded, '/') ||
    CASE WHEN ends_with(raw_path, '/') OR ends_with(raw_path, '/.') OR (ends_with(raw_path, '/..') AND folded[-1] <> '..') THEN '/' ELSE '' END END AS path FROM t3)
SELECT {keep}CASE WHEN good THEN scheme || '://' || host || CASE WHEN port <> -1 THEN ':' || port::VARCHAR ELSE '' END || path || q END AS value,
  CASE WHEN good THEN host END AS host, CASE WHEN good THEN scheme END AS scheme, CASE WHEN good THEN path END AS path,
  CASE WHEN good AND q <> '' THEN q[2:] END AS query, CASE WHEN good THEN port END AS port
FROM (SELECT *, coalesce(ok, false) AND host IS NOT NULL AND (digits = '' OR number IS NOT NULL) AS good FROM t4))"""
