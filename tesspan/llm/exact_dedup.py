"""Exact deduplication by static binary-fuse filters over immutable snapshots.

A snapshot is written once and never changed: its distinct digests with the row
that stays (the exact buckets) and, per shard of the digest space, one binary-fuse
filter.  An incoming batch is grouped by digest on its own, its distinct digests are
screened by the filters, and only the positives are joined with the exact buckets.
Every row that is about to be dropped is compared byte for byte with the row that
stays; digests under which texts differ are grouped again by the text itself.

Defined results: null text counts as empty; a null doc_id sorts after all others;
a row repeated with the same doc_id is a copy like any other and stays once; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import anti, hinted, new_path, saved, semi, table, unused

KEYS_PER_SHARD = 1 << 16
COPIES_PER_SALT = 2_000
_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


# --- binary-fuse filter over one shard -------------------------------------------------


@dataclass
class FuseFilter:
    """Three-wise binary-fuse filter with 8-bit fingerprints; no false negatives."""

    seed: int
    segment: int
    segments: int
    table: np.ndarray

    @staticmethod
    def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
        h = keys + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(33))

    @staticmethod
    def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        mask = np.uint64(segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(40))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> "FuseFilter":
        """keys: distinct uint64."""
        n = max(2, len(keys))
        segment = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(n * factor / segment) - 2)
        for attempt in range(1, 200):
            seed = (attempt * 0x9E3779B97F4A7C15) & (2**64 - 1)
            with np.errstate(over="ignore"):
                h = cls._mix(keys, seed)
            slots = cls._slots(h, segment, segments)
            rounds = cls._peel(slots, (segments + 2) * segment)
            if rounds is not None:
                filled, prints = np.zeros((segments + 2) * segment, np.uint8), cls._print(h)
                for key, slot in reversed(rounds):
                    filled[slot] = 0
                    filled[slot] = prints[key] ^ filled[slots[0, key]] ^ filled[slots[1, key]] ^ filled[slots[2, key]]
                return cls(seed, segment, segments, filled)
            if attempt % 10 == 0:
                segments += 1
        raise RuntimeError("no seed builds the filter; are the keys distinct?")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (key, its lone slot), all keys that are alone in some slot at once; None if a core stays."""
        n = slots.shape[1]
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(held, row, np.arange(n))
        rounds, left, look = [], n, np.flatnonzero(count == 1)
        while len(look):
            key, at = np.unique(held[look], return_index=True)
            rounds.append((key, look[at]))
            left -= len(key)
            touched = slots[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            for row in touched:
                np.bitwise_xor.at(held, row, key)
            look = np.unique(touched)
            look = look[count[look] == 1]
        return rounds if left == 0 else None

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        with np.errstate(over="ignore"):
            h = self._mix(keys, self.seed)
        a, b, c = self._slots(h, self.segment, self.segments)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self._print(h)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(d[:16].ljust(16, "0"), 16) for d in digests], dtype=np.uint64)


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(np.unique(_keys(pdf["digest"])))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [str(f.seed)], "segment": [f.segment], "segments": [f.segments], "filter": [f.table.tobytes()]})


def _screen_shard(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if batch.empty or filters.empty:
        return batch[["digest"]].iloc[:0]
    row = filters.iloc[0]
    f = FuseFilter(int(row["seed"]), int(row["segment"]), int(row["segments"]), np.frombuffer(row["filter"], np.uint8))
    return batch.loc[f.contains(_keys(batch["digest"])), ["digest"]]


# --- snapshots and batches -------------------------------------------------------------


@dataclass
class Snapshot:
    """Immutable: buckets(digest, keep_id, n), filters(shard, ...) and the number of shards."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def digested(docs: DataFrame, digest_hex: int = 64) -> DataFrame:
    """doc_id, digest, of every row; digest_hex below 64 shortens digests (to test collisions)."""
    return docs.select("doc_id", F.substring(F.sha2(normalised(F.col("text")), 256), 1, digest_hex).alias("digest"))


def _first(col: str) -> Column:
    return F.min(col)  # min skips nulls, so a null id stays only where there is no other


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(_first("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def build_snapshot(rows: DataFrame, path: str | None = None) -> Snapshot:
    """rows: doc_id, digest.  Writes the snapshot of their classes; see write_snapshot()."""
    return write_snapshot(_grouped(rows), path or new_path(rows.sparkSession, "snapshot"))


def write_snapshot(classes: DataFrame, path: str) -> Snapshot:
    """classes: digest, keep_id, n.  Writes the exact buckets and one filter per shard of about KEYS_PER_SHARD digests, once."""
    spark = classes.sparkSession
    classes.select("digest", "keep_id", "n").write.option("compression", "zstd").parquet(f"{path}/buckets")
    buckets = spark.read.parquet(f"{path}/buckets")
    shards = max(1, math.ceil(buckets.count() / KEYS_PER_SHARD))
    filters = (
        buckets.select("digest", _shard(F.col("digest"), shards).alias("shard"))
        .groupBy("shard")
        .applyInPandas(_build_shard, "shard int, seed string, segment long, segments long, filter binary")
    )
    filters.withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
    return open_snapshot(spark, path)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A snapshot that was written at path."""
    filters = spark.read.parquet(f"{path}/filters")
    held = filters.select("shards").first()
    return Snapshot(spark.read.parquet(f"{path}/buckets"), filters, held.shards if held else 1)


def incoming(snapshot: Snapshot, docs: DataFrame, path: str) -> tuple[DataFrame, Snapshot]:
    """A batch against a snapshot: doc_id, keep_id, group_size of its rows, and the next snapshot, written at path.

    keep_id is the smallest id of the class over the snapshot and the batch.  The snapshot holds digests alone, so
    classes go by the whole SHA-256; exact_duplicates() also compares texts, as it has them all.
    """
    rows = saved(digested(docs.select("doc_id", "text")), "digests")
    after = write_snapshot(merged_classes(snapshot, rows), path)
    out = rows.join(after.buckets, "digest").select("doc_id", "keep_id", F.col("n").alias("group_size"))
    return out, after


def screened(snapshot: Snapshot, digests: DataFrame, n: int) -> DataFrame:
    """The distinct digests (n of them) that a filter of the snapshot lets through."""
    salts = max(1, math.ceil(n / snapshot.shards / (4 * KEYS_PER_SHARD)))
    left = digests.select("digest", _shard(F.col("digest"), snapshot.shards).alias("shard"), F.pmod(F.crc32(F.col("digest").cast("binary")), F.lit(salts)).cast("int").alias("salt"))
    right = snapshot.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(_screen_shard, "digest string")


def merged_classes(snapshot: Snapshot, rows: DataFrame) -> DataFrame:
    """digest, keep_id, n over the snapshot and a batch of rows (doc_id, digest) together."""
    batch = saved(_grouped(rows), "batch")
    hits = saved(screened(snapshot, batch, batch.count()), "positives")
    known = hits.join(snapshot.buckets.withColumnsRenamed({"keep_id": "old_id", "n": "old_n"}), "digest")
    known = saved(known, "known")
    news = batch.join(known, "digest", "left").select(
        "digest", F.least("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n")
    )
    olds = snapshot.buckets.join(known.select("digest"), "digest", "left_anti")
    return saved(news.unionByName(olds), "classes")


def colliding(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Digests of classes of several rows in which some text differs from that of the row that stays.

    Only texts of such classes move.  A class is dealt over ceil(n / COPIES_PER_SALT) salts, each with
    one copy of the text that stays, so a huge group of copies is compared by many tasks.
    """
    several = saved(classes.where("n > 1"), "several")
    members = saved(rows.join(hinted(several), "digest"), "members")
    ids = hinted(members.select("doc_id", "digest", "keep_id", "n").distinct().withColumnRenamed("doc_id", "m_id"))
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text")).join(ids, F.col("doc_id").eqNullSafe(F.col("m_id")))
    texts = texts.withColumn("salts", F.ceil(F.col("n") / COPIES_PER_SALT).cast("int"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    base = (
        texts.where(stays)
        .groupBy("digest", "salts").agg(F.min("text").alias("base"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("salts")
    )
    copies = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    return copies.join(base, ["digest", "salt"]).where("text != base").select("digest").distinct()


def exact_duplicates(docs: DataFrame, snapshot_rows: Column | None = None, digest_hex: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    snapshot_rows: a condition on doc_id; rows that satisfy it make up the immutable snapshot, the others
    are the incoming batch.  By default crc32 of the id deals the rows about evenly.  The result doesn't depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    old = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(True)) if snapshot_rows is None else snapshot_rows
    full = saved(digested(docs).withColumnRenamed("digest", "sha"), "digests")
    rows = full.select("doc_id", F.substring("sha", 1, digest_hex).alias("digest"), "sha")
    snapshot = build_snapshot(rows.where(old).select("doc_id", "digest"))
    classes = merged_classes(snapshot, rows.where(~old).select("doc_id", "digest"))
    clash = saved(colliding(docs, rows.select("doc_id", "digest"), classes), "clash")
    several = classes.where("n > 1")
    key = "digest"
    if not clash.isEmpty():  # texts differ under one digest: there the text itself is the key
        odd = docs.select("doc_id", F.substring(F.sha2(normalised(F.col("text")), 256), 1, digest_hex).alias("digest"), normalised(F.col("text")).alias("exact"))
        odd = odd.join(hinted(clash), "digest")
        odd = saved(odd.groupBy("digest", "exact").agg(_first("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"), F.min(F.sha2("exact", 256)).alias("sha")), "odd")
        several = rows.select("digest", "sha").distinct().join(several.join(clash, "digest", "left_anti"), "digest").select("sha", "keep_id", "n")
        several = several.unionByName(odd.where("n > 1").select("sha", "keep_id", "n"))
        key = "sha"
    several = hinted(saved(several.select(key, "keep_id", "n"), "dup"))
    out = rows.join(several, key, "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("sha").alias("text_sha256"),
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not full.groupBy("doc_id").count().where("count > 1").isEmpty():  # a repeated row stays once
        w = Window.partitionBy("text_sha256", "doc_id").orderBy("group_size")
        out = out.withColumn("nth", F.row_number().over(w))
        kept = kept & (F.col("nth") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    out = saved(exact_duplicates(docs), "kept")
    dropped = out.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go"))
    dropped = saved(dropped.where("go > 0"), "dropped")
    rest = anti(docs, dropped, "doc_id")
    mixed = dropped.where("stay > 0")  # repeated ids: some rows stay, others go
    if mixed.isEmpty():
        return rest
    text, own, sha, nth = unused(docs, "__t", "__id", "__sha", "__n")
    again = semi(docs, mixed, "doc_id").withColumn(text, normalised(F.col("text")))
    full = out.where("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha))
    again = again.join(full, F.col("doc_id").eqNullSafe(F.col(own)) & (F.sha2(text, 256) == F.col(sha)))
    again = again.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", text).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return rest.unionByName(again.select(*docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s)
"""
