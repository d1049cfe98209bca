"""Queries of the training-text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcrawl.llm import body, leakage, packing, residue, seen_keys, site_lines, splitting, stuffing
from loomcrawl.plans.duck import url_table
from loomcrawl.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The case is by pages alone; clusters and dates decide in p1_clean_pages."""
    return site_lines.repeated_occurrences(table(spark, d, "parsed_documents"))


def p1_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.clean_pages(table(spark, d, "parsed_documents"), table(spark, d, "cdxj_entries"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.seen_entries(table(spark, d, "forwarding_batches"), table(spark, d, "extracted_links"))


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return seen_keys.error_rate(table(spark, d, "forwarding_batches"), table(spark, d, "extracted_links"))


def p2_error_rate_full(spark: SparkSession, d: str) -> DataFrame:
    """The rate at the width that p2_found uses."""
    return seen_keys.error_rate(table(spark, d, "forwarding_batches"), table(spark, d, "extracted_links"), widths=(seen_keys.BITS,))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return body.furniture_lines(table(spark, d, "parsed_documents"), table(spark, d, "fetch_results"))


def p4_bodies(spark: SparkSession, d: str) -> DataFrame:
    return body.body_texts(table(spark, d, "parsed_documents"), table(spark, d, "fetch_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(table(spark, d, "parsed_documents")).select("page_id")


def p5_clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean_pages(table(spark, d, "parsed_documents").select("page_id", "url", "title", "main_text").dropDuplicates(["page_id"]))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.spam_pages(table(spark, d, "parsed_documents")).select("page_id")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.document_sizes(table(spark, d, "documents")))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, d))


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_leak_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(p9_found(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_clean_pages": p1_clean_pages,
    "p2_found": p2_found,
    "p2_error_rate": p2_error_rate,
    "p2_error_rate_full": p2_error_rate_full,
    "p4_found": p4_found,
    "p4_bodies": p4_bodies,
    "p5_found": p5_found,
    "p5_clean_pages": p5_clean_pages,
    "p7_found": p7_found,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_leak_report": p9_leak_report,
    "p10_pieces": p10_pieces,
}

_SITE = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_FORM = r"regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\s\x1c-\x1f\x85\pZ]+', ' ', 'g'), '^ | $', '', 'g')"
_P1 = f"""l AS (SELECT page_id, line_no, site, {_FORM} AS form FROM (SELECT page_id, {_SITE} AS site,
  unnest(range(len(string_split(main_text, chr(10))))) AS line_no, unnest(string_split(main_text, chr(10))) AS line
  FROM (SELECT DISTINCT page_id, url, main_text FROM parsed_documents WHERE main_text IS NOT NULL)) WHERE site <> '')"""

def _grams(table: str, key: str) -> str:
    return rf"""(SELECT DISTINCT {key}, gram FROM (SELECT {key}, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS gram
  FROM (SELECT {key}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= 13))"""


_P9 = f"SELECT DISTINCT d.doc_id, i.item_id FROM {_grams('documents', 'doc_id')} d JOIN {_grams('eval_items', 'item_id')} i USING (gram)"

_ENTRIES = "(SELECT delivery_id, unnest(range(len(urls))) AS entry_no, unnest(urls).url AS raw FROM forwarding_batches WHERE urls IS NOT NULL)"
_P2 = f"""WITH e AS (SELECT delivery_id, entry_no, value AS key FROM {url_table(_ENTRIES, 'raw', 'delivery_id, entry_no')} WHERE value IS NOT NULL),
h AS (SELECT DISTINCT value AS key FROM {url_table('extracted_links', 'target_url')} WHERE value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY delivery_id, entry_no) AS k FROM e)
SELECT delivery_id, entry_no FROM r WHERE k > 1 OR key IN (SELECT key FROM h)"""

SQL = {
    "p2_found": _P2,
    "p2_error_rate_full": f"SELECT 32 AS bits, count(*) AS n_entries, 0::BIGINT AS n_wrong, 0.0::DOUBLE AS rate FROM {url_table(_ENTRIES, 'raw', 'delivery_id, entry_no')} WHERE value IS NOT NULL",
    "p1_found": f"WITH {_P1}, f AS (SELECT site, form FROM l WHERE form <> '' GROUP BY site, form HAVING count(DISTINCT page_id) >= 6) SELECT page_id, line_no FROM l JOIN f USING (site, form)",
    "p9_found": _P9,
    "p9_leak_report": f"SELECT item_id, count(*) AS n_docs FROM ({_P9}) GROUP BY item_id",
}
