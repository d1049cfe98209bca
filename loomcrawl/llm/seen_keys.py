"""Has this key been seen before? (problem 2)

Keys are spread over buckets. When a batch is finished its keys are sealed, once per
bucket: a minimal perfect hash gives every key its own slot, and an array holds one
fingerprint per slot. Segments are rows of a table in the shared folder; the keys are
dropped. A later batch reads segments, never keys: a key is "seen" when the fingerprint
at its computed slot is its own. Keys of the epoch in hand are compared exactly, by their
128-bit hash. With ``bits`` fingerprint bits a new key is called seen with a chance of
2**-bits per sealed segment; a seen key is never called new.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcrawl.functions.url import canon_url, present
from loomcrawl.session import fresh_path, materialize, shuffle_partitions

GAMMA = 1.6
LEVELS = 32
#: So few keys are left as they are, after the last level.
FEW = 32
#: Epochs into which the deliveries of one batch are cut, as many deliveries in each; each is sealed before the next.
EPOCHS = 8
BITS = 32
#: Keys of a bucket when the store is made: what one task holds at a time, about 20 MB.
KEYS_PER_BUCKET = 500_000
#: Widths at which the rate of wrong answers is measured.
WIDTHS = (8, 16, 32)
ABSENT = np.uint64(0xFFFFFFFFFFFFFFFF)
SEGMENT = "delivery_id bigint, entry_no int, least_bits int, bucket int, epoch int, n_keys bigint, segment binary"


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser with another start for each level."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SealedKeys:
    """Minimal perfect hash over 64-bit key hashes with one fingerprint per slot.

    Level by level, keys that are alone in their cell of a bit array are placed there and
    the others go on. A key's slot is the rank of its bit over all levels. The last few
    keys are kept as exact hashes.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, bits: int = BITS):
        self.bits, self.mask = bits, np.uint64((1 << bits) - 1)
        kind = np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32
        order = np.unique(h1, return_index=True)[1]
        left, prints = h1[order], h2[order]
        self.sizes, words, placed = [], [], []
        for level in range(LEVELS):
            if len(left) <= FEW:
                break
            size = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
            cell = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size)[cell] == 1
            bits_set = np.zeros(size, np.uint8)
            bits_set[cell[alone]] = 1
            words.append(np.packbits(bits_set, bitorder="little").view(np.uint64))
            placed.append(prints[alone][np.argsort(cell[alone])])
            self.sizes.append(size)
            left, prints = left[~alone], prints[~alone]
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.prints = (np.concatenate(placed) & self.mask).astype(kind) if placed else np.zeros(0, kind)
        self.rest = np.sort(left)
        self._index()

    def _index(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))[:-1]]).astype(np.uint32) if len(self.words) else np.zeros(0, np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4q", self.bits, len(self.sizes), len(self.prints), len(self.rest))
        return head + np.array(self.sizes, np.int64).tobytes() + self.words.tobytes() + self.rest.tobytes() + self.prints.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> SealedKeys:
        self = cls.__new__(cls)
        self.bits, levels, prints, rest = struct.unpack_from("<4q", data)
        at = 32
        self.sizes = np.frombuffer(data, np.int64, levels, at).tolist()
        at += 8 * levels
        self.words = np.frombuffer(data, np.uint64, sum(self.sizes) // 64, at)
        at += self.words.nbytes
        self.rest = np.frombuffer(data, np.uint64, rest, at)
        at += self.rest.nbytes
        self.prints = np.frombuffer(data, np.uint8 if self.bits <= 8 else np.uint16 if self.bits <= 16 else np.uint32, prints, at)
        self.mask = np.uint64((1 << self.bits) - 1)
        self._index()
        return self

    def __len__(self) -> int:
        return len(self.prints) + len(self.rest)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes + self.prints.nbytes + self.rest.nbytes

    def differ(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """For each key the bits in which the fingerprint at its slot differs from its own, ``ABSENT`` without a slot."""
        out = np.full(len(h1), ABSENT)
        if len(self.rest):
            out[np.isin(h1, self.rest)] = 0
        todo, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            cell = _mix(h1[todo], level) % np.uint64(size)
            word, bit = base + (cell >> np.uint64(6)).astype(np.int64), cell & np.uint64(63)
            value = self.words[word]
            here = (value >> bit) & np.uint64(1) == 1
            below = value[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            slot = self.before[word[here]].astype(np.int64) + np.bitwise_count(below)
            hit = todo[here]
            out[hit] = np.minimum(out[hit], (self.prints[slot] ^ h2[hit]) & self.mask)
            todo, base = todo[~here], base + size // 64
            if not len(todo):
                break
        return out

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.differ(h1, h2) == 0


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def entry_keys(batches: DataFrame) -> DataFrame:
    """(delivery_id, entry_no, key) of every entry with a valid url, entry_no from 0."""
    each = batches.select("delivery_id", F.posexplode("urls").alias("entry_no", "entry"))
    return each.select("delivery_id", "entry_no", present(canon_url(F.col("entry.url"))).alias("key"))


def link_keys(links: DataFrame) -> DataFrame:
    return links.select(present(canon_url(F.col("target_url"))).alias("key"))


def hashed(keys: DataFrame) -> DataFrame:
    """Replace the column key by its hashes h1 and h2; rows without a key are left out."""
    h1, h2 = key_hashes(F.col("key"))
    return keys.where(F.col("key").isNotNull()).select(*[c for c in keys.columns if c != "key"], h1.alias("h1"), h2.alias("h2"))


def _epochs(entries: DataFrame, epochs: int) -> Column:
    """Epoch of a delivery: by its place in the order of deliveries, so sparse ids fill no epoch of their own."""
    cuts = F.percentile_approx("delivery_id", F.array(*[F.lit(k / epochs) for k in range(1, epochs)]), 1000)
    bounds = (entries.agg(cuts).first()[0] or []) if epochs > 1 else []
    return sum(((F.col("delivery_id") > b).cast("int") for b in bounds), F.lit(0))


@dataclass
class SeenStore:
    """Sealed segments in a folder of the shared file system: one row per bucket and epoch.

    ``buckets`` is fixed when the store is made, from the number of keys that it is to
    hold. Every call of :meth:`seal` or :meth:`admit` adds one folder and rewrites none.
    """

    spark: SparkSession
    folder: str
    buckets: int
    bits: int = BITS

    @classmethod
    def create(cls, spark: SparkSession, keys: int, bits: int = BITS, folder: str | None = None) -> SeenStore:
        return cls(spark, folder or fresh_path(spark, "seen-store"), max(shuffle_partitions(spark), -(-keys // KEYS_PER_BUCKET)), bits)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        n = self.buckets
        spread = rows.repartition(n, "bucket") if n > shuffle_partitions(self.spark) else rows.repartition("bucket")
        return spread.sortWithinPartitions("bucket", "epoch", "kind")

    def _bucket(self) -> Column:
        return F.pmod(F.shiftrightunsigned(F.col("h1"), 17), F.lit(self.buckets)).cast("int").alias("bucket")

    def segments(self) -> DataFrame:
        """(bucket, epoch, n_keys, segment) of all that was sealed."""
        rows = self.spark.read.schema("part string, " + SEGMENT).parquet(self.folder)
        return rows.where(F.col("segment").isNotNull()).select("bucket", "epoch", "n_keys", "segment")

    def seal(self, keys: DataFrame) -> SeenStore:
        """Seal the distinct keys (h1, h2) of a finished history as one segment per bucket."""
        ids = keys.select(F.lit(0).cast("bigint").alias("delivery_id"), F.lit(0).alias("entry_no"), "h1", "h2")
        self._run(ids.groupBy("h1", "h2").agg(F.min("delivery_id").alias("delivery_id"), F.min("entry_no").alias("entry_no")).withColumn("epoch", F.lit(0)), known=None, answer=False)
        return self

    def admit(self, entries: DataFrame, epochs: int = EPOCHS) -> DataFrame:
        """(delivery_id, entry_no, least_bits) of the entries whose key is new; their keys are sealed with it.

        ``entries`` has delivery_id, entry_no, h1 and h2. Keys are made distinct per epoch
        before they move, so a key that is a third of all rows is one row. A task streams
        through its buckets in order of epoch; it holds the hashes of one epoch of one
        bucket and that bucket's segments, nothing else. ``least_bits`` is the least of
        ``WIDTHS`` (up to the store's) at which the key would be called new.
        """
        numbered = entries.withColumn("epoch", _epochs(entries, epochs))
        firsts = numbered.groupBy("h1", "h2", "epoch").agg(F.min(F.struct("delivery_id", "entry_no")).alias("at"))
        try:
            known = self.segments()
        except Exception as e:  # noqa: BLE001 - nothing was sealed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        path = self._run(firsts.select("h1", "h2", "epoch", "at.delivery_id", "at.entry_no"), known, answer=True)
        rows = self.spark.read.schema(SEGMENT).parquet(path)
        return rows.where(F.col("segment").isNull()).select("delivery_id", "entry_no", "least_bits")

    def _run(self, firsts: DataFrame, known: DataFrame | None, answer: bool) -> str:
        none = F.lit(None).cast("binary")
        rows = firsts.select(self._bucket(), F.col("epoch").cast("int").alias("epoch"), F.lit(1).alias("kind"), "h1", "h2", "delivery_id", F.col("entry_no").cast("int").alias("entry_no"), none.alias("segment"))
        if known is not None:
            zero = F.lit(0).cast("bigint")
            rows = rows.unionByName(known.select("bucket", F.lit(-1).alias("epoch"), F.lit(0).alias("kind"), zero.alias("h1"), zero.alias("h2"), zero.alias("delivery_id"), F.lit(0).alias("entry_no"), "segment"))
        path = f"{self.folder}/part={fresh_path(self.spark, 'p').rsplit('/', 1)[1]}"
        self._bucketed(rows).mapInPandas(_streamer(self.bits, answer), SEGMENT).write.parquet(path)
        return path


def _streamer(bits: int, answer: bool):
    widths = [w for w in WIDTHS if w < bits] + [bits]
    names = [c.strip().split(" ")[0] for c in SEGMENT.split(",")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segments, parts, current = [], [], None

        def close() -> Iterator[pd.DataFrame]:
            if not parts:
                return
            part = pd.concat(parts) if len(parts) > 1 else parts[0]
            a, b = part.h1.to_numpy().view(np.uint64), part.h2.to_numpy().view(np.uint64)
            least = np.full(len(a), widths[0], np.int32)
            for s in segments:
                off = s.differ(a, b)
                for w, wider in zip(widths, [*widths[1:], 0]):  # equal in w bits: new only at a wider width, or not at all
                    same = (off & np.uint64((1 << w) - 1)) == 0
                    least[same] = np.where(least[same] == 0, 0, np.maximum(least[same], wider) if wider else 0)
            new = least > 0
            if new.any():
                sealed = SealedKeys(a[new], b[new], bits)
                segments.append(sealed)
                if answer:
                    yield _frame(names, int(new.sum()), delivery_id=part.delivery_id.to_numpy()[new], entry_no=part.entry_no.to_numpy()[new], least_bits=least[new])
                yield _frame(names, 1, bucket=[current[0]], epoch=[current[1]], n_keys=[len(sealed)], segment=[sealed.to_bytes()])

        for frame in batches:
            for at, part in frame.groupby(["bucket", "epoch"], sort=False):
                if at != current:
                    yield from close()
                    parts = []
                    if current is None or current[0] != at[0]:
                        segments = []
                    current = at
                if at[1] < 0:
                    segments += [SealedKeys.from_bytes(bytes(x)) for x in part.segment]
                else:
                    parts.append(part)
        yield from close()

    return stream


def _frame(names: list[str], n: int, **columns) -> pd.DataFrame:
    """A frame of all columns; those that are not given are NULL. Ids stay whole numbers."""
    data = {}
    for name in names:
        if name == "segment":
            data[name] = columns.get(name, [None] * n)
        else:
            data[name] = pd.array(columns[name] if name in columns else [None] * n, dtype="Int64" if name in ("delivery_id", "n_keys") else "Int32")
    return pd.DataFrame(data)


def new_entries(history: DataFrame, entries: DataFrame, bits: int = BITS, epochs: int = EPOCHS, folder: str | None = None) -> DataFrame:
    """(delivery_id, entry_no, least_bits) of the entries whose key is in neither ``history`` nor an earlier entry.

    ``history`` has h1 and h2, ``entries`` delivery_id, entry_no, h1 and h2, from
    :func:`hashed`. The history is sealed first, then the entries are admitted against
    its segments. An empty history or no entries is fine.
    """
    spark = entries.sparkSession
    store = SeenStore.create(spark, history.count() + entries.count(), bits, folder)
    return store.seal(history).admit(entries, epochs)


def seen_entries(batches: DataFrame, links: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> DataFrame:
    """(delivery_id, entry_no) of every valid entry that is not the first of its key."""
    entries = materialize(hashed(entry_keys(batches)), "entry-keys")
    history = materialize(hashed(link_keys(links)), "link-keys")
    fresh = new_entries(history, entries, bits, epochs)
    return entries.select("delivery_id", "entry_no").distinct().join(fresh, ["delivery_id", "entry_no"], "left_anti")


def exact_new_entries(history: DataFrame, entries: DataFrame) -> DataFrame:
    """The same answer from the keys themselves, to measure against."""
    firsts = entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct("delivery_id", "entry_no")).alias("at"))
    return firsts.join(history.select("key").distinct(), "key", "left_anti").select("at.delivery_id", "at.entry_no")


def error_rate(batches: DataFrame, links: DataFrame, epochs: int = EPOCHS, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per width: fingerprint bits, valid entries, entries answered wrongly, and their rate.

    One pass answers for all widths: a fingerprint of ``BITS`` bits is compared in its
    lowest 8, 16 and 32.
    """
    entries, history = materialize(entry_keys(batches), "error-entries"), materialize(link_keys(links), "error-links")
    ours = new_entries(hashed(history), hashed(entries), BITS, epochs)
    truth = exact_new_entries(history, entries).withColumn("truth", F.lit(1))
    both = ours.join(truth, ["delivery_id", "entry_no"], "full")
    wrong = [F.count(F.when((F.coalesce("least_bits", F.lit(99)) <= w) != F.col("truth").isNotNull(), 1)).alias(f"w{w}") for w in widths]
    one = both.agg(*wrong).join(entries.agg(F.count("*").alias("n_entries")))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(w).alias("bits"), F.col(f"w{w}").alias("n_wrong")) for w in widths]))
    n = F.col("n_entries")
    return one.select("n_entries", rows.alias("r")).select("r.bits", n, "r.n_wrong", F.when(n == 0, 0.0).otherwise(F.col("r.n_wrong") / n).alias("rate"))
