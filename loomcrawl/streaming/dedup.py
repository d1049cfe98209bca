"""Exactly one copy of each message that was delivered at least once (problem 6).

A stateful stream decides on arrival. For every identifier the keyed state store holds
the delivery that was kept and when it expires; a delivery of an identifier in the store
is a copy, the first delivery of any other identifier is kept and put out at once. When
the event-time watermark has passed an identifier by ``delay`` it is expired. An
arrival behind the watermark whose identifier is not in the store may be a copy of an
expired one: the stream calls it late, and only late arrivals are looked up, by key, in
the stream's durable output. State, source offsets and the output's commit log belong
to one checkpoint, so they advance together, and a folder that is given again goes on
where the last call ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomcrawl.session import fresh_path

BATCH_SCHEMA = T.StructType(
    [
        T.StructField("delivery_id", T.LongType()),
        T.StructField("source_agent", T.StringType()),
        T.StructField("batch_sequence", T.LongType()),
        T.StructField("emitted_at", T.TimestampType()),
    ]
)
DELAY_MS = 7 * 86_400_000
ANSWERS = "message string, verdict string, delivery_id bigint"


def message_columns() -> list[Column]:
    """(message, sent_at): the identifier of a batch as one string, and its event time.

    Agents are equal without regard to case and outer blanks, event times when cut to
    the millisecond. NULL parts compare as equal.
    """
    agent = F.lower(F.regexp_replace("source_agent", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    sent_at = F.date_trunc("millisecond", F.col("emitted_at"))
    none = F.lit("-")
    message = F.concat_ws("|", F.coalesce(F.col("batch_sequence").cast("string"), none), F.coalesce(F.unix_millis(sent_at).cast("string"), none), F.coalesce(agent, F.lit("|")))
    return [message.alias("message"), sent_at.alias("sent_at")]


def parquet_stream(spark: SparkSession, source: str, schema: T.StructType, files_per_trigger: int) -> DataFrame:
    """A file stream over a Parquet folder, or over a table that is one single file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(source)


#: Key of the rows that only move the watermark; no message is empty.
_TICK, _TICK_BUCKET = "", -1
STATE = "h1 array<bigint>, h2 array<bigint>, kept array<bigint>, expires array<bigint>"
#: Buckets of the state. A bucket holds the 128-bit hashes of its live identifiers; some
#: hundreds to thousands of them are met with a batch in one vectorised step. Fixed for
#: the life of a folder; a larger stream is given more.
BUCKETS = 512
_ROW = "message string, sent_ms bigint, delivery_id bigint, clock timestamp"


def _first_of_batch(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least delivery of every message of an Arrow batch, and one row with the batch's newest event time.

    A message that was delivered a very large number of times is one row a batch in the
    shuffle. Only the extra row has a clock: Spark drops rows whose event-time column is
    behind the watermark, and late arrivals are to be answered, not dropped.
    """
    clock = pa.timestamp("us", "UTC")
    schema = pa.schema([("message", pa.string()), ("sent_ms", pa.int64()), ("delivery_id", pa.int64()), ("clock", clock)])
    for frame in frames:
        least = pa.Table.from_batches([frame]).group_by(["message", "sent_ms"]).aggregate([("delivery_id", "min")])
        n = least.num_rows
        yield pa.record_batch([least["message"].combine_chunks(), least["sent_ms"].combine_chunks(), least["delivery_id_min"].combine_chunks(), pa.nulls(n, clock)], schema=schema)
        newest = pa.compute.max(frame["sent_ms"]).as_py()
        if newest is not None:
            yield pa.record_batch([pa.array([_TICK]), pa.array([newest]), pa.array([0], pa.int64()), pa.array([newest * 1000], pa.int64()).cast(clock)], schema=schema)


def _answer(delay_ms: int):
    """Answers of one bucket: its live identifiers are columns of the state, met with those of the batch at once."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        old = pd.DataFrame(dict(zip(("h1", "h2", "kept", "expires"), state.get)) if state.exists else {"h1": [], "h2": [], "kept": [], "expires": []}, dtype="int64")
        old = old[old["expires"] > now].reset_index(drop=True)
        new = old.iloc[:0]
        if not state.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True)
            if key[0] == _TICK_BUCKET:
                return
            rows = rows.sort_values("delivery_id", kind="stable").drop_duplicates(["h1", "h2"])
            known = rows.merge(old.reset_index()[["h1", "h2", "index"]], on=["h1", "h2"], how="left")["index"]
            at = known.fillna(-1).astype("int64").to_numpy()
            ids, message, sent = rows["delivery_id"].to_numpy("int64"), rows["message"].to_numpy(), rows["sent_ms"].astype("Float64")
            kept = old["kept"].to_numpy().copy()
            # Files came out of order: the smaller delivery takes the place of the other.
            less = np.flatnonzero((at >= 0) & (ids < np.where(at >= 0, kept[at] if len(kept) else 0, 0)))
            fresh = np.flatnonzero(at < 0)
            late = fresh[((sent.isna()) | (sent < now)).fillna(True).to_numpy(bool)[fresh]]
            first = np.setdiff1d(fresh, late)
            parts = [(less, "kept", ids[less]), (less, "withdrawn", kept[at[less]]), (late, "late", ids[late]), (first, "kept", ids[first])]
            kept[at[less]] = ids[less]
            old["kept"] = kept
            some = rows.iloc[first]
            new = pd.DataFrame({"h1": some["h1"].to_numpy("int64"), "h2": some["h2"].to_numpy("int64"), "kept": ids[first], "expires": sent.iloc[first].to_numpy("int64") + delay_ms})
            yield pd.DataFrame({"message": np.concatenate([message[k] for k, _, _ in parts]), "verdict": np.concatenate([[v] * len(k) for k, v, _ in parts]), "delivery_id": np.concatenate([x for _, _, x in parts])})
        live = pd.concat([old, new], ignore_index=True)
        if len(live):
            state.update(tuple(live[c].tolist() for c in ("h1", "h2", "kept", "expires")))
            state.setTimeoutTimestamp(int(live["expires"].min()))
        elif state.exists:
            state.remove()

    return run


@dataclass
class DeliveryLog:
    """The stream's home in the shared folder: checkpoint (offsets, state) and durable answers.

    ``folder`` outlives the call: a later :meth:`receive` with the same folder reads only
    files that are new and knows the identifiers of the earlier ones.
    """

    spark: SparkSession
    folder: str
    delay_ms: int = DELAY_MS
    files_per_trigger: int = 8
    buckets: int = BUCKETS

    def receive(self, source: str) -> DeliveryLog:
        """Take in all files of ``source`` that no earlier call has read, and stop.

        Event times are state, not a filter: deliveries without one, or behind the
        watermark and not in the state, are put out as late.
        """
        arrivals = parquet_stream(self.spark, source, BATCH_SCHEMA, self.files_per_trigger).where(F.col("delivery_id").isNotNull()).select(*message_columns(), "delivery_id")
        slim = arrivals.select("message", F.unix_millis("sent_at").alias("sent_ms"), "delivery_id")
        fewer = slim.mapInArrow(_first_of_batch, _ROW).withWatermark("clock", f"{self.delay_ms} milliseconds")
        h1, h2 = F.xxhash64("message"), F.xxhash64(F.lit("message"), "message")
        bucket = F.when(F.col("message") == _TICK, _TICK_BUCKET).otherwise(F.pmod(h1, F.lit(self.buckets))).cast("int")
        keyed = fewer.select(bucket.alias("bucket"), "message", h1.alias("h1"), h2.alias("h2"), "sent_ms", "delivery_id", "clock")
        answers = keyed.groupBy("bucket").applyInPandasWithState(_answer(self.delay_ms), ANSWERS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
        query = answers.writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/answers").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def answers(self) -> DataFrame:
        """(message, verdict, delivery_id) of all committed micro-batches."""
        return self.spark.read.schema(ANSWERS).parquet(f"{self.folder}/answers")

    def kept(self) -> DataFrame:
        """(message, delivery_id): the one kept delivery of every message.

        Late arrivals alone are looked up: those whose message was put out before are
        copies, of the others the smallest is kept.
        """
        answers = self.answers()
        put_out, withdrawn = answers.where("verdict = 'kept'"), answers.where("verdict = 'withdrawn'")
        on_time = put_out.join(withdrawn, ["message", "delivery_id"], "left_anti").select("message", "delivery_id")
        late = answers.where("verdict = 'late'").groupBy("message").agg(F.min("delivery_id").alias("delivery_id"))
        return on_time.unionByName(late.join(put_out.select("message"), "message", "left_anti"))


def kept_deliveries(spark: SparkSession, source: str, folder: str | None = None, delay_ms: int = DELAY_MS, files_per_trigger: int = 8) -> DataFrame:
    """The one copy of each batch that is kept, as (message, delivery_id).

    Without ``folder`` the stream starts from nothing. Deliveries without an id are left
    out; an empty table gives no rows.
    """
    return DeliveryLog(spark, folder or fresh_path(spark, "deliveries"), delay_ms, files_per_trigger).receive(source).kept()


def repeated_deliveries(spark: SparkSession, source: str, folder: str | None = None, delay_ms: int = DELAY_MS, files_per_trigger: int = 8) -> DataFrame:
    """Every delivery but the kept copy of its batch: (delivery_id), each once.

    A row that repeats a kept delivery in full is the same delivery.
    """
    kept = kept_deliveries(spark, source, folder, delay_ms, files_per_trigger).select("delivery_id")
    received = spark.read.schema(BATCH_SCHEMA).parquet(source).select("delivery_id").where(F.col("delivery_id").isNotNull())
    return received.distinct().join(kept, "delivery_id", "left_anti")
