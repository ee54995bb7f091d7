import random

import pytest

import corpus_pipeline
from tesspan.llm import jaccard_dedup as j
from tesspan.llm import simhash_dedup


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar(x, y):
    return len(x & y) / len(x | y) >= 0.8


def texts():
    """Texts with up to eight edits of a few bases, a passage that all share, odd rows."""
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    passage = " ".join(rng.choices(vocab, k=40))
    rows = []
    for b in range(6):
        base = rng.choices(vocab, k=rng.choice([30, 120, 300]))
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words) + (" " + passage if b % 2 else "")))
    rows += [(len(rows) + i, " ".join(rng.choices(vocab, k=60)) + " " + passage) for i in range(40)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (None, rows[0][1]), (None, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sample", [10_000, 5])
def test_against_all_pairs(spark, sample, monkeypatch):
    monkeypatch.setattr(j, "SAMPLE", sample)
    rows = texts()
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")
    out = j.without_near_copies(df)
    assert out.columns == df.columns
    got = [r.doc_id for r in out.collect()]
    sets = {d: shingled(t) for d, t in rows if d is not None}
    links = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    stay = {d for d in got if d is not None}
    assert got.count(None) == 2 and len(got) == len(stay) + 2
    assert not [(a, b) for a, b in links if a in stay and b in stay]
    root = {d: d for d in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {root[d] for d in sets} <= stay
    assert all(any(d in link for link in links) for d in sets if d not in stay)
    assert j.without_near_copies(df.limit(0)).count() == 0


def test_stage_takes_pairs_that_fingerprints_miss(spark):
    rows = [(d, t, "en", "s", 1) for d, t in texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stay = lambda out: [(r.doc_id, shingled(r.text)) for r in out.collect() if r.doc_id is not None]
    left = lambda kept: sum(similar(x, y) for a, x in kept for b, y in kept if a < b)
    assert left(stay(simhash_dedup.one_of_each(df))) > 0
    assert left(stay(corpus_pipeline.near(spark, df, ""))) == 0
