"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 positions, set where over half of the
document's shingle hashes have it.  Fingerprints at RADIUS or fewer differing bits
are linked; a document's class is the connected component.

Candidates come from 2^(RADIUS+1)-1 tables.  Every bit position i has a nonzero
vector phi(i) of RADIUS+1 bits; table v keeps the positions with <phi(i), v> odd.
RADIUS vectors never span RADIUS+1 dimensions, so for any RADIUS positions there is
a table that keeps none of them: every pair within the radius collides there.

Distinct fingerprints are looked up once, however many documents share one.  In a
bucket of up to BUCKET fingerprints the pairs are compared in blocks, and only a
spanning forest of the links leaves the task.  In a larger bucket each fingerprint
names all points within RADIUS/2 bits of it in the free positions; two of them name
a common point exactly if they are linked, so linking each to the smallest that
names the point is exact too, and takes no pairs and no single task.

Defined results: null text counts as empty, and texts without a word have fingerprint
zero and link like any other; a null doc_id yields to any other as the smallest id;
repeated rows come back repeated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import anti, hinted, saved, semi, table
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
BUCKET = 4096
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count, total = np.zeros(BITS, np.int64), n - SHINGLE + 1
    digest = xxhash.xxh64_digest
    for at in range(0, total, _BLOCK):
        stop = min(total, at + _BLOCK)
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:stop].tolist(), ends[at + SHINGLE - 1 : stop + SHINGLE - 1].tolist())])
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > total).tobytes(), "big")


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def masks(radius: int = RADIUS) -> list[int]:
    """The kept positions of each table, as 64-bit numbers."""
    side = 1 << (radius + 1)
    phi = [1 + i % (side - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() % 2) for v in range(1, side)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(prints: DataFrame) -> DataFrame:
    """fp -> fp, v, key for each table."""
    keep = F.array(*[F.lit(_signed(m)).cast("long") for m in masks()])
    out = prints.select("fp", F.posexplode(keep).alias("v", "mask"))
    return out.select("fp", "v", F.xxhash64("v", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def forest(fps: np.ndarray, runs: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest among equal runs (sorted): pairs of fingerprints at RADIUS or fewer bits."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out, step, at = [], 1, np.arange(len(fps))
    while True:
        at = at[at + step < len(fps)]
        at = at[runs[at] == runs[at + step]]
        if not len(at):
            return out
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= RADIUS]
        near = near[parent[near] != parent[near + step]]  # parents are roots here: only pairs of two trees are left
        for i in near.tolist():
            a, b = root(i), root(i + step)
            if a != b:
                parent[b] = a
                out.append((i, i + step))
        while len(near) and (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]
        step += 1


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key; a run is never cut, as what may go on is held back (BUCKET rows at most)."""
    held = None
    for pdf in batches:
        key, fp = pdf["key"].to_numpy(), pdf["fp"].to_numpy()
        if held is not None:
            key, fp = np.concatenate([held[0], key]), np.concatenate([held[1], fp])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        held = key[cut:], fp[cut:]
        yield _pairs(key[:cut], fp[:cut])
    if held is not None:
        yield _pairs(*held)


def _pairs(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    links = np.array(forest(fp.view(np.uint64), key), dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": fp[links[:, 0]], "b": fp[links[:, 1]]})


def _balls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint with all points within RADIUS // 2 bits of it in its table's free positions."""
    flips = []
    for mask in masks():
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        flips.append(np.array([sum(c) for k in range(RADIUS // 2 + 1) for c in combinations(free, k)], dtype=np.uint64))
    for pdf in batches:
        for v, part in pdf.groupby("v"):
            fps = part["fp"].to_numpy().view(np.uint64)
            for at in range(0, len(fps), 512):
                some = fps[at : at + 512]
                points = some[:, None] ^ flips[v][None, :]
                yield pd.DataFrame({"v": np.int32(v), "point": points.ravel().view(np.int64), "fp": np.repeat(some.view(np.int64), points.shape[1])})


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """prints: distinct fp.  a, b: links whose components are those of all pairs within the radius."""
    rows = _tables(prints)
    counts = saved(rows.groupBy("v", "key").count().where("count > 1"), "buckets")
    cold, hot = counts.where(F.col("count") <= bucket), counts.where(F.col("count") > bucket)
    members = rows.select("key", "fp").join(hinted(cold.select("key").distinct()), "key")
    parts = max(2, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    members = members.repartition(parts, "key").sortWithinPartitions("key", "fp")
    out = members.mapInPandas(_linked, "a long, b long")
    if not hot.isEmpty():
        balls = saved(rows.join(hinted(hot.select("v", "key")), ["v", "key"]).select("v", "fp").mapInPandas(_balls, "v int, point long, fp long"), "balls")
        least = balls.groupBy("v", "point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        out = out.unionByName(balls.join(least, ["v", "point"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct())
    return out


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (the smallest doc_id of its component)."""
    prints = saved(docs.select("doc_id", _fingerprints("text").alias("fp")), "prints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    roots = saved(components(links(classes.select("fp"), bucket)).withColumnRenamed("node", "fp"), "roots")
    linked = saved(classes.join(hinted(roots), "fp").select("fp", "root", "first"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "component_id")
    copied = classes.where("n > 1").join(hinted(roots.select("fp")), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    known = hinted(saved(linked.unionByName(copied), "known").withColumn("known", F.lit(True)))
    return prints.join(known, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component, with all columns; rows with a null id stay."""
    found = saved(near_duplicates(docs), "near")
    rest = anti(docs, saved(found.where("doc_id != component_id").select("doc_id").distinct(), "go"), "doc_id")
    again = saved(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1"), "again")
    if again.isEmpty():
        return rest
    return anti(rest, again, "doc_id").unionByName(semi(rest, again, "doc_id").dropDuplicates(["doc_id"]))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
