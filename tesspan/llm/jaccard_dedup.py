"""Near duplicates by exact similarity of word shingles: a set-similarity join with prefix filters.

A text's set holds its runs of WORDS words (A-Z lower-cased, ASCII space between); a text with
fewer words is one run.  Two texts are linked if their sets' Jaccard similarity is 4/5 or more,
that is if 9 |A and B| >= 4 (|A| + |B|).

All shingles have one order: by hash, with those that are frequent in a sample last.  Linked
sets share a shingle among the first |A| - ceil(4/5 |A|) + 1 of each, whatever the order is, so
the sample decides only how much work there is.  Of the two sets the one whose prefix ends first has all
further shared shingles behind its prefix; so a pair that shares c prefix shingles shares at most c and what is
behind the longer rest.  Pairs that this bound leaves are compared by the texts themselves.

First each document is compared only with the smallest of each shingle it shares, which takes a large
group away without its pairs; then all pairs among those left are compared.  Each time the smallest
document of every connected component of the links found stays.  So no two documents that stay are linked, and a
chain of links leads from each that goes to one that stays.

Defined results: null text counts as empty; texts without a word are equal; rows with a null
doc_id stay; ids are otherwise taken as distinct (simhash_dedup.one_of_each leaves them so).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anti, hinted, saved
from .components import components

WORDS, SEED = 5, 42
#: Documents that are compared with one copy of the text they are paired with.
COPIES_PER_SALT = 500
#: Documents whose shingles are counted, the count there from which a shingle is frequent, and how many of those are kept.
SAMPLE, FREQUENT, LISTED = 10_000, 4, 200_000


def shingles(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [b" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)] or [b" ".join(words)]


def hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles(text)]), ">u8").astype(np.uint64).view(np.int64))


def alike(a: set[bytes], b: set[bytes]) -> bool:
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def _frequent(docs: DataFrame) -> np.ndarray:
    n = docs.count()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": np.concatenate([hashes(t) for t in pdf["text"]])} if len(pdf) else {"h": np.zeros(0, np.int64)})

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    rows = some.mapInPandas(counted, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    return np.sort(np.array([r.h for r in rows.orderBy(F.desc("count"), "h").limit(LISTED).collect()], np.int64))


def _prefixes(docs: DataFrame) -> DataFrame:
    """h, doc_id, n: the first shingles of every document, with the size of its set."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = sent.value
        for pdf in batches:
            parts, sizes = [], []
            for text in pdf["text"]:
                h = hashes(text)
                n = len(h)
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    h = np.concatenate([h[~last], h[last]])
                parts.append(h[: n - -(-4 * n // 5) + 1])
                sizes.append(n)
            if parts:
                long = [len(p) for p in parts]
                yield pd.DataFrame({"h": np.concatenate(parts), "doc_id": np.repeat(pdf["doc_id"].to_numpy(), long), "n": np.repeat(sizes, long).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(rows, f"h long, doc_id {kind}, n int")


def _candidates(prefixes: DataFrame, every: bool) -> DataFrame:
    """a < b: pairs whose shared prefix shingles allow a link; unless every, a is the smallest that has the shingle."""
    kind = prefixes.schema["doc_id"].dataType.simpleString()

    def allowed(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        n, ids = pdf["n"].to_numpy(np.int64), pdf["doc_id"].to_numpy()
        ok = 9 * np.minimum(n[i], n[j]) >= 4 * (n[i] + n[j])
        i, j = i[ok], j[ok]
        return pd.DataFrame({"a": ids[i], "b": ids[j], "na": n[i].astype(np.int32), "nb": n[j].astype(np.int32)})

    def paired(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        h = pdf["h"].to_numpy()
        index = np.arange(len(h))
        if not every:
            first = np.searchsorted(h, h)
            yield allowed(pdf, first[first < index], index[first < index])
            return
        step = 1
        i = index
        while True:
            i = i[i + step < len(h)]
            i = i[h[i] == h[i + step]]
            if not len(i):
                return
            yield allowed(pdf, i, i + step)
            step += 1

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(pdf):
                cut = int(np.searchsorted(pdf["h"].to_numpy(), pdf["h"].iloc[-1]))
                held = pdf[cut:].reset_index(drop=True)
                yield from paired(pdf[:cut])
        if held is not None:
            yield from paired(held)

    parts = max(2, int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = prefixes.repartition(parts, "h").sortWithinPartitions("h", "doc_id")
    shared = dealt.mapInPandas(runs, f"a {kind}, b {kind}, na int, nb int").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    rest = F.ceil(4 * F.greatest("na", "nb") / 5) - 1  # behind the prefix of the larger set
    return shared.where(9 * (F.col("c") + rest) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: the pairs whose texts are linked.

    The text of each a goes once to each salt of its pairs, ahead of the texts of its b's, so no text is copied for each
    pair, and a document with many pairs is compared by many tasks.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = saved(pairs, "pairs")
    counts = saved(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / COPIES_PER_SALT).cast("int").alias("salts")), "salts")
    pairs = saved(pairs.join(hinted(counts), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "pairs")
    firsts = saved(pairs.select("a", "salt").distinct(), "firsts")
    texts = docs.select("doc_id", "text")
    ahead = texts.join(hinted(firsts), F.col("doc_id") == F.col("a")).select("a", "salt", F.col("a").alias("b"), "text")  # a < b, so it sorts first
    behind = texts.join(hinted(pairs), F.col("doc_id") == F.col("b")).select("a", "salt", "b", "text")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: set[bytes] = set()
        for pdf in batches:
            a, b = [], []
            for x, y, text in zip(pdf["a"], pdf["b"], pdf["text"]):
                if x == y:
                    own = set(shingles(text))
                elif alike(own, set(shingles(text))):
                    a.append(x)
                    b.append(y)
            yield pd.DataFrame({"a": a, "b": b}, dtype=pdf["a"].dtype)

    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = ahead.unionByName(behind).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "b")
    return rows.mapInPandas(compared, f"a {kind}, b {kind}")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs without those that a chain of links leads to a smaller id, with all columns."""
    docs = saved(docs, "docs")
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    prefixes = saved(_prefixes(known), "prefixes")
    for every in (False, True):
        found = components(_linked(known, _candidates(prefixes, every)))
        go = saved(found.where("node != root").select(F.col("node").alias("doc_id")).distinct(), "go")
        docs, known, prefixes = anti(docs, go, "doc_id"), anti(known, go, "doc_id"), anti(prefixes, go, "doc_id")
    return docs
