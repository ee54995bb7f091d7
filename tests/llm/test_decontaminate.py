import hashlib
import random
import re
from collections import Counter

import pytest

from tesspan.llm import decontaminate as c

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))


def brute_near(docs, items, slop=8):
    """The items near each document: every choice of one occurrence for each of a window's three rarest words."""
    texts = [words(t) for _, t in docs]
    count = Counter(w for t in texts for w in t)
    out = []
    for t in texts:
        at, ids = {}, set()
        for k, w in enumerate(t):
            at.setdefault(w, []).append(k)
        for i, u in items:
            v = words(u)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                if min(count[w] for w in v[s : s + n]) == 0:
                    continue
                rare = sorted(range(s, s + n), key=lambda k: (count[v[k]], k))[:3]
                offsets = [[p - k for p in at.get(v[k], [])] for k in rare]
                if all(offsets) and any(all(any(low <= o <= low + slop for o in own) for own in offsets) for low in sorted({o for own in offsets for o in own})):
                    ids |= {str(i)} if i is not None else set()
        out.append(sorted(ids))
    return out


def sha(ids):
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def brute(docs, items, slop=8):
    out, near = [], brute_near(docs, items, slop)
    for (d, t), close in zip(docs, near):
        w, hit, ids = words(t), set(), set()
        for i, u in items:
            v = words(u)
            n = min(13, len(v))
            grams = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if n and tuple(w[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    ids.add(str(i)) if i is not None else None
        out.append((d, len(w), len(hit), len(ids), sha(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(w), len(close), sha(close)))
    return sorted(out, key=str)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Short ITEM é"), (2, "short item É"), (10, "a a a a a a a a a a a a a a a"), (11, None), (12, "..!"), (None, "null item here"), (13, "solo"), (14, " ".join(f"w{i}" for i in range(13)))]
DOCS = [
    (1, LONG),
    (2, "x " + LONG.upper() + " y"),
    (3, " ".join(f"w{i}" for i in range(12))),
    (4, " ".join(f"w{i}" for i in range(17, 30)) + " w0 w1"),
    (5, " ".join(f"w{i}" for i in range(5, 30))),
    (6, "a " * 40 + "b"),
    (7, None),
    (8, ""),
    (9, "short, item... É! short item é"),
    (9, "nothing of it"),
    (9, "the null item here"),
    (None, "solo"),
    (10, "z " * 100 + "solo"),
    (11, "ö" * 50_000 + " solo"),
    (12, LONG + " gap " + LONG),
    (12, LONG + " gap " + LONG),
    (13, "w16 " + " ".join(f"w{i}" for i in range(18, 30)) + " " + " ".join(f"w{i}" for i in range(0, 14))),
]


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(a, b, 1, "q") for a, b in docs], "doc_id long, text string, rid int, word string"),
        spark.createDataFrame([(a, b, "n") for a, b in items], "item_id long, text string, words string"),
    )


def test_against_brute_force(spark):
    got = c.contamination(*frames(spark, DOCS, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS)


def test_stage(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    out = c.clean_documents(docs, items)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(d, t) for (d, t) in DOCS if not brute([(d, t)], ITEMS)[0][5]], key=str)


@pytest.mark.parametrize("docs, items", [([], ITEMS), (DOCS, []), ([(1, None)], [(1, None)])])
def test_empty(spark, docs, items):
    got = c.contamination(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_proximity(spark):
    near = "w0 w1 w2 zz w3 w4 w5 w6 yy w7 w8 w9 w10 w11 w12"
    rows, item = [(1, near), (2, "w0 w1"), (3, LONG)], [(14, " ".join(f"w{i}" for i in range(13)))]
    docs, items = frames(spark, rows, item)
    for slop in (1, 8):
        want = {(d, 14) for (d, _), ids in zip(rows, brute_near(rows, item, slop)) if ids}
        assert {tuple(r) for r in c.proximity_matches(docs, items, slop).collect()} == want
    assert not c.contamination(docs, items).where("doc_id = 1 AND n_hit > 0").count()


@pytest.mark.parametrize("seed, segment, block", [(1, 256, 4096), (2, 3, 16), (3, 1, 40), (4, 20, 13)])
def test_phrases_and_proximity_of_random_texts(spark, monkeypatch, seed, segment, block):
    monkeypatch.setattr(c, "SEGMENT", segment)
    monkeypatch.setattr(c, "BLOCK", block)
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(25)]
    items = [(i % 9, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 30, 70])))) for i in range(14)]
    docs = []
    for d in range(25):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(items)[1].split()
            at = rng.randint(0, len(own) - 1)
            part = own[at : at + rng.randint(8, 40)]
            if rng.random() < 0.5 and len(part) > 3:
                part.insert(2, "zz")
            w[rng.randint(0, len(w)) : 0] = part
        docs.append((d, " ".join(w)))
    got = c.contamination(*frames(spark, docs, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_long_items_and_many_alignments(spark):
    """An item of 100,000 words, and a document that aligns with it at 50,000 places: rows stay small."""
    item = " ".join(f"a b c{i % 7}" for i in range(33_334))
    docs, items = frames(spark, [(1, " ".join("a b c1" for _ in range(16_667))), (2, item)], [(1, item)])
    got = {r.doc_id: r for r in c.contamination(docs, items).collect()}
    assert (got[1].n_hit, got[2].n_hit) == (0, got[2].n_words) and got[2].n_items == 1


def test_clashing_names(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    docs = docs.withColumnsRenamed({"rid": "__key", "word": "__k"})
    assert c.clean_documents(docs, items).columns == docs.columns
