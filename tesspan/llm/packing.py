"""Packing by optimal length buckets.

One global histogram of token lengths is taken over all rows, a bar for each length that
occurs.  Dynamic programming over it picks the bucket boundaries with least padding.  Bars
are bounded by the distinct lengths (k different lengths need k^2/2 tokens of text, so a table of 10^14
tokens has at most 14 million bars of 16 bytes, and real ones have thousands).  Inside a bucket every row is
padded to the boundary, and batches hold as many rows as the token budget allows.
Places in a bucket come from counts per shard and a rank inside each shard, so no bucket
is one task however many rows it has.

Defined results: a row takes its text's tokens and one end mark, so null and empty texts
have length 1; a row longer than the budget is a batch of its own; repeated rows and null
ids are packed as rows like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hinted, saved, table
from .token_counts import VOCABULARY, with_token_count

BUCKETS, BUDGET, SHARD_ROWS = 16, 65_536, 50_000


def boundaries(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """The upper lengths of at most `buckets` buckets with least padding, for (length, rows) pairs.

    Padding of rows i..j under boundary j is b_j * (N_j - N_i) less their lengths; for each number of
    buckets the best cut is the lower envelope of lines with falling slopes -N_i, read at rising b_j.
    """
    bars = sorted(histogram)
    if not bars:
        return []
    n, k = len(bars), min(buckets, len(bars))
    rows, size = [0], [0]
    for length, count in bars:
        rows.append(rows[-1] + count)
        size.append(size[-1] + length * count)
    best = [0] + [float("inf")] * n
    cuts: list[list[int]] = []
    for _ in range(k):
        now, cut, hull = [float("inf")] * (n + 1), [0] * (n + 1), deque()
        for j in range(1, n + 1):
            i = j - 1
            if best[i] != float("inf"):
                m, c = -rows[i], best[i] + size[i]
                while len(hull) >= 2 and _above(hull[-2], hull[-1], (m, c)):
                    hull.pop()
                hull.append((m, c, i))
            b = bars[j - 1][0]
            while len(hull) >= 2 and hull[1][0] * b + hull[1][1] <= hull[0][0] * b + hull[0][1]:
                hull.popleft()
            if hull:
                now[j], cut[j] = hull[0][0] * b + hull[0][1] + b * rows[j] - size[j], hull[0][2]
        best = now
        cuts.append(cut)
        if best[n] == 0:
            break
    out, j = [], n
    for cut in reversed(cuts):
        if j:
            out.append(bars[j - 1][0])
            j = cut[j]
    return out[::-1]


def _above(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is nowhere below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def packed(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lengths: doc_id, n_tokens (1 at least), saved, and where ids repeat a number of the row, spread.  doc_id, n_tokens, bucket, padded_length, batch_id, slot."""
    spread = F.col("spread") if "spread" in lengths.columns else F.lit(0).cast("long")
    lengths = lengths.select("doc_id", "n_tokens", spread.alias("spread"))
    bars = [(r.g, r.n) for r in lengths.groupBy(F.col("n_tokens").alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()]
    tops = boundaries(bars, buckets) or [1]
    rows = [sum(n for g, n in bars if (tops[i - 1] if i else 0) < g <= top) for i, top in enumerate(tops)]
    room = [max(1, budget // top) for top in tops]
    base, total = [], 0
    for n, r in zip(rows, room):
        base.append(total)
        total += -(-n // r)
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("bucket") + 1)
    bucket = sum(((F.col("n_tokens") > top).cast("int") for top in tops[:-1]), F.lit(0))
    h = F.xxhash64("doc_id", "n_tokens", "spread")
    rows_of = lengths.withColumn("bucket", bucket).withColumn("h", h)
    rows_of = rows_of.withColumn("shard", F.pmod("h", of([max(1, -(-n // shard_rows)) for n in rows], "long")).cast("int"))
    counts = rows_of.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("h", "doc_id", "n_tokens", "spread")) - 1
    placed = rows_of.withColumn("rank", rank).join(hinted(saved(before, "before")), ["bucket", "shard"])
    at = F.col("before") + F.col("rank")
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        of(tops, "long").alias("padded_length"),
        (of(base, "long") + F.floor(at / of(room, "long"))).cast("long").alias("batch_id"),
        F.pmod(at, of(room, "long")).cast("long").alias("slot"),
    )


def token_lengths(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens with one end mark, of every row, and a number that tells rows without an id apart (spread); written once."""
    counted = with_token_count(docs.select("doc_id", "text"), "n_tokens", path)
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("spread")
    return saved(counted.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens"), spread), "lengths")


def packed_documents(docs: DataFrame) -> DataFrame:
    return packed(token_lengths(docs))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
