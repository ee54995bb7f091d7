import itertools
import random
from collections import Counter

import pytest

from tesspan.llm import packing as p


def padding(bars, tops):
    return sum(n * (min(t for t in tops if t >= g) - g) for g, n in bars)


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    bars = [(g, rng.randint(1, 50)) for g in sorted(rng.sample(range(1, 200), rng.randint(1, 9)))]
    k = rng.randint(1, 5)
    got = p.boundaries(bars, k)
    lengths = [g for g, _ in bars]
    best = min(padding(bars, [*c, lengths[-1]]) for r in range(k) for c in itertools.combinations(lengths[:-1], r))
    assert len(got) <= k and got == sorted(got) and padding(bars, got) == best


def test_boundaries_of_a_large_histogram():
    bars = [(8 * i, 1 + (i * 7919) % 100) for i in range(1, 5000)]
    tops = p.boundaries(bars, 16)
    assert len(tops) == 16 and tops[-1] == bars[-1][0]


@pytest.mark.parametrize("seed", range(3))
def test_padding_is_the_least_over_real_lengths(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(900, 1100), 4096 + rng.randint(0, 9), 9001]) for _ in range(120)]
    out = p.packed(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long"), buckets=3, budget=20_000).collect()
    bars = sorted(Counter(lengths).items())
    sizes = [g for g, _ in bars]
    best = min(padding(bars, [*c, sizes[-1]]) for r in range(3) for c in itertools.combinations(sizes[:-1], r))
    assert sum(r.padded_length - r.n_tokens for r in out) == best


@pytest.mark.parametrize("shard_rows", [50_000, 7])
def test_batches(spark, shard_rows):
    rng = random.Random(1)
    rows = [(i if i % 10 else None, rng.choice([3, 3, 3, 40, 900, 5000])) for i in range(500)] + [(1, 3), (1, 3), (7, 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = p.packed(df, buckets=4, budget=8192, shard_rows=shard_rows).toPandas()
    assert sorted(zip(out.doc_id.fillna(-1), out.n_tokens)) == sorted((-1 if i is None else i, n) for i, n in rows)
    assert (out.padded_length >= out.n_tokens).all()
    for _, batch in out.groupby("batch_id"):
        assert batch.bucket.nunique() == 1
        assert len(batch) == 1 or len(batch) * batch.padded_length.iloc[0] <= 8192
        assert sorted(batch.slot) == list(range(len(batch)))
    for _, bucket in out.groupby("bucket"):
        room = max(1, 8192 // bucket.padded_length.iloc[0])
        assert bucket.batch_id.nunique() == -(-len(bucket) // room)
    assert sorted(out.batch_id.unique()) == list(range(out.batch_id.nunique()))


def test_texts(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "x" * 400_000, 0)], "doc_id long, text string, bucket int")
    out = {(r.doc_id, r.n_tokens) for r in p.packed_documents(df).collect()}
    assert {(1, 1), (2, 1), (3, 3)} < out
    assert p.packed_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n\t"])
def test_long_white_space(spark, run):
    df = spark.createDataFrame([(1, f"a{run * (2_000_000 // len(run))}b")], "doc_id long, text string")
    assert p.packed_documents(df).first().n_tokens > 3


def test_rows_without_an_id_are_dealt_over_shards(spark):
    docs = spark.createDataFrame([(None, "same text")] * 60 + [(1, "other")], "doc_id long, text string")
    lengths = p.token_lengths(docs)
    assert lengths.where("doc_id IS NULL").select("spread").distinct().count() == 60
    out = p.packed(lengths, shard_rows=10).collect()
    assert len(out) == 61 and len({(r.batch_id, r.slot) for r in out}) == 61
