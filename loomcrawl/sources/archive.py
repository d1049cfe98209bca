"""Archive records, their index and rolling files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.functions.codec import cdxj_line
from loomcrawl.functions.url import present, surt_key, url_parts

CRLF = "\r\n"


def sha1_digest(payload: Column) -> Column:
    """K2."""
    return F.concat(F.lit("sha1:"), F.sha1(payload))


def iso_instant(ts: Column) -> Column:
    """Seconds, and milli- or microseconds only where they are not zero."""
    micros = F.unix_micros(ts) % 1_000_000
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(ts, ".SSS")).otherwise(F.date_format(ts, ".SSSSSS"))
    return F.concat(base, part, F.lit("Z"))


def warc_record(kind: str, uri: Column, at: Column, record_id: Column, payload: Column, extra: Column | None = None) -> Column:
    """K1, K2: one record as binary. ``extra`` is a map of further headers, written in order of their names."""
    digest = sha1_digest(payload)
    head = [
        ("WARC-Type", F.lit(kind)),
        ("WARC-Target-URI", uri),
        ("WARC-Date", iso_instant(at)),
        ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))),
        ("Content-Type", F.lit(f"application/http; msgtype={kind}")),
        ("Content-Length", F.octet_length(payload).cast("string")),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", digest),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in head]
    if extra is not None:
        entries = F.transform(F.array_sort(F.map_entries(extra)), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(CRLF)))
        lines.append(F.coalesce(F.array_join(entries, ""), F.lit("")))
    text = F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit(CRLF))
    return F.concat(F.encode(text, "US-ASCII"), payload, F.encode(F.lit(CRLF * 2), "US-ASCII"))


def index_lines(entries: DataFrame) -> DataFrame:
    """K4: (surt, captured_at, line) of every entry with a valid url."""
    keyed = entries.select("*", present(url_parts(F.col("url"))).alias("parts")).withColumn("surt", surt_key(F.col("parts")))
    line = cdxj_line(
        F.col("surt"),
        F.col("captured_at"),
        url=F.col("parts.value"),
        mime=F.col("mime_type"),
        status=F.col("http_status"),
        digest=F.col("payload_digest"),
        length=F.col("payload_length"),
        filename=F.col("warc_filename"),
        offset=F.col("warc_offset"),
    )
    return keyed.select("surt", "captured_at", line.alias("line"))


def write_sorted_index(entries: DataFrame, path: str) -> int:
    """K5, T5: range-partitioned sort by key and time, one text file per range; gives the count."""
    lines = index_lines(entries).repartitionByRange("surt", "captured_at").sortWithinPartitions("surt", "captured_at", "line")
    lines.select("line").write.mode("overwrite").text(path)
    return entries.sparkSession.read.text(path).count()


def append_index(entries: DataFrame, path: str) -> None:
    """K6."""
    index_lines(entries).select("line").write.mode("append").text(path)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """The frontier's tables as one folder each; the last write wins."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """S7."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def resolve_redirects(start: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """(url, final_url, hops) after following redirect edges (source, target) at most ``limit`` times.

    A bounded chain of joins; a chain that is longer has a NULL final url.
    """
    hop = edges.select("source", "target").dropDuplicates(["source"])
    state = start.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit(True).alias("open"))
    for _ in range(limit + 1):
        state = state.join(hop, state["final_url"] == hop["source"], "left").select(
            "url", F.coalesce("target", "final_url").alias("final_url"), (F.col("hops") + F.col("target").isNotNull().cast("int")).alias("hops"), F.col("target").isNotNull().alias("open")
        )
    return state.select("url", F.when(F.col("hops") <= limit, F.col("final_url")).alias("final_url"), F.least("hops", F.lit(limit + 1)).alias("hops"))


def write_warc_files(records: DataFrame, path: str, prefix: str, stamp: str, max_bytes: int = 1 << 30) -> DataFrame:
    """Write records (part, seq, record) to rolling files; gives (file, n_records, n_bytes).

    A file is ``<prefix>-<stamp>-<part>-<5 digits>.warc``, numbered from 1 in each part. One
    task streams through a part in order of seq, holding one record. A file is written
    under another name and renamed when it is whole, so a task that is run again leaves no
    half file and none twice. ``path`` is any folder that Arrow's file systems know.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(path)
        system.create_dir(root)
        out, name, stream, rows, size, part, number = [], None, None, 0, 0, None, 0
        mine = f".{uuid.uuid4().hex}.tmp"

        def close():
            if stream is not None:
                stream.close()
                system.move(f"{root}/{name}{mine}", f"{root}/{name}")
                out.append((name, rows, size))

        for frame in frames:
            for p, record in zip(frame["part"], frame["record"]):
                if p != part or size + len(record) > max_bytes:
                    close()
                    number = number + 1 if p == part else 1
                    part, name, rows, size = p, f"{prefix}-{stamp}-{p}-{number:05d}.warc", 0, 0
                    stream = system.open_output_stream(f"{root}/{name}{mine}")
                stream.write(bytes(record))
                rows, size = rows + 1, size + len(record)
        close()
        yield pd.DataFrame(out, columns=["file", "n_records", "n_bytes"])

    ordered = records.select("part", "seq", "record").where(F.col("part").isNotNull() & F.col("record").isNotNull())
    return ordered.repartition("part").sortWithinPartitions("part", "seq").mapInPandas(run, "file string, n_records bigint, n_bytes bigint")
