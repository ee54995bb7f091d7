import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tesspan.llm import exact_dedup as x

SCHEMA = "doc_id long, text string, keep_id string, n long"


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = min(known) if known else None, False
        for i in ids:
            stays = i == keep and not seen
            seen |= stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "a b"), (6, "x" * 200_000), (7, "x" * 200_000), (8, " a b"), (9, "a\t\r\nb"), (9, "a b"), (None, "a b"), (None, "only"), (None, "only"), (10, "z"), (10, "y")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_against_brute_force(spark, digest_hex):
    got = x.exact_duplicates(frame(spark, ROWS), digest_hex=digest_hex).collect()
    assert sorted([tuple(r) for r in got], key=str) == expected(ROWS)


def test_stage_keeps_one_row_of_each(spark):
    got = x.without_copies(frame(spark, ROWS))
    assert got.columns == ["doc_id", "text", "keep_id", "n"]
    kept = sorted([(i, s) for i, _, _, k, s in expected(ROWS) if k and i is not None])
    have = sorted((r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").encode()).hexdigest()) for r in got.collect() if r.doc_id is not None)
    assert have == kept


def test_empty(spark):
    assert x.exact_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    f = x.FuseFilter.build(keys)
    assert f.contains(keys).all()
    other = rng.integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01


def test_snapshots_are_kept_and_opened_again(spark, tmp_path):
    first, second = [(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (0, "a"), (5, "c"), (6, "c")]
    x.build_snapshot(x.digested(frame(spark, first)), f"{tmp_path}/one")
    old = x.open_snapshot(spark, f"{tmp_path}/one")
    got, new = x.incoming(old, frame(spark, second), f"{tmp_path}/two")
    assert {tuple(r) for r in got.collect()} == {(4, 2, 2), (0, 0, 3), (5, 5, 2), (6, 5, 2)}
    again = x.open_snapshot(spark, f"{tmp_path}/two").buckets
    assert sorted((r.keep_id, r.n) for r in again.collect()) == [(0, 3), (2, 2), (5, 2)] == sorted((r.keep_id, r.n) for r in new.buckets.collect())
    assert sorted((r.keep_id, r.n) for r in old.buckets.collect()) == [(1, 2), (2, 1)]
    assert x.open_snapshot(spark, x.build_snapshot(x.digested(frame(spark, [])), f"{tmp_path}/none") and f"{tmp_path}/none").shards == 1


def test_clashing_names(spark):
    docs = frame(spark, ROWS).withColumnsRenamed({"keep_id": "__t", "n": "__id"})
    assert x.without_copies(docs).columns == docs.columns
