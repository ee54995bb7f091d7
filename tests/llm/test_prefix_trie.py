import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tesspan.llm import prefix_trie as p


def ordered(rows):
    convs = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(own)] for c, own in convs.items() if c is not None}


def brute_rebuilt(rows):
    convs, out = ordered(rows), {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + own[h:]
    return out


def brute(built):
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    below = {node: [x for x in members if x[: len(node)] == node] for node in members}
    kids = {node: sum(len(x) == len(node) + 1 for x in below[node]) for node in members}
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(built[c]) == len(node)))
        tokens = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[node] if x)
        leaves = sum(not kids[x] for x in below[node])
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids[node], leaves, tokens, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed=3):
    rng = random.Random(seed)
    words = ["hi", "", "Grüße", "tell me", None, "日本", "x" * 500]
    rows = []
    for c in rng.sample(range(700), 160):
        rows += [(c, k, ("user", "assistant")[k % 2], rng.choice(words[: 2 + k % 5])) for k in range(rng.randint(1, 7))]
    for c in range(1000, 1060):  # copies, and turns that all share
        rows += [(c, k, "user", f"shared {k}") for k in range(9)] + ([(c, 9, "user", f"own {c % 4}")] if c % 3 else [])
    rows += [(1100, None, None, "first"), (1100, None, None, "first"), (1100, 2, "user", "b"), (1100, 2, "user", "a"), (None, 0, "user", "lost"), (-7, 0, "user", "minus"), (-101, 0, "user", "minus")]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("group_turns", [4, 30, 50_000])
def test_against_brute_force(spark, group_turns, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 20)
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("x")).withColumn("base", F.lit("y"))
    got = p.trie(p.rebuilt(df), group_turns)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(brute_rebuilt(rows))
    assert len({(r[0], r[1]) for r in got.collect()}) == got.count()


def test_general_paths(spark):
    rows = rows_of(5)
    got = p.trie(p.paths(spark.createDataFrame(rows, SCHEMA)), 25)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(ordered(rows))


def test_small_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert p.trie(p.rebuilt(df)).count() == 0
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 2)
    rows = [(turnless, 0, "user", "a"), (turnless, 1, "assistant", "b")]  # no conversation 100, two turns, two of them left out
    got = [tuple(r) for r in p.trie(p.rebuilt(spark.createDataFrame(rows, SCHEMA))).collect()]
    assert got == brute(brute_rebuilt(rows)) and got[0][:6] == (turnless, 0, None, 1, 0, 1)


def test_long_conversations_share_a_long_start(spark):
    rows = [(c, k, "user", f"{k if k < 300 else c * k}") for c in range(5) for k in range(310)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = p.trie(p.paths(df), 100)  # one round takes the 300 turns that all share
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(ordered(rows))
