import random

import numpy as np
import pytest
import xxhash

from tesspan.llm import simhash_dedup as s
from tesspan.llm.components import components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, (d, _) in zip(comp, rows):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, comp)), key=str)


def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéÉXYZ", k=rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choices(vocab, k=300)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = "edit"
        rows.append((100 + i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one"), (504, "One two  three"), (505, "one two three"), (506, "w " * 30_000), (507, " x   y É"), (None, base[0]), (None, "alone here by itself now"), (3, base[3]), (3, base[3])]
    return rows


@pytest.mark.parametrize("bucket", [4096, 3])
def test_against_brute_force(spark, bucket):
    rows = texts()
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, fp int, component_id string")
    got = sorted([tuple(r) for r in s.near_duplicates(df, bucket).collect()], key=str)
    assert got == brute(rows)


def test_stage_and_empty(spark):
    rows = texts()
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, fp int")
    out = s.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted({d for d, _, c in brute(rows) if d == c and d is not None})
    assert s.near_duplicates(df.limit(0)).count() == 0


def test_every_close_pair_collides():
    rng = np.random.default_rng(1)
    tables = s.masks()
    assert len(tables) == 31
    for _ in range(20_000):
        flip = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
        assert any(not flip & m for m in tables)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(201)} | {(1000 + i, 1000) for i in range(50)}
