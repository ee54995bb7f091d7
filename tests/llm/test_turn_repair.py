import hashlib
import random
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from tesspan.llm import turn_repair as t


sys.setrecursionlimit(5_000)


def step(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def best(turns):
    """Least (cost, audit, repaired) of turns (role, text, must_go, cut), by trying every edit at every place."""
    from functools import lru_cache

    @lru_cache(None)
    def rest(i, state, inserted):
        found = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        if inserted < 2:
            for role in ("user", "assistant"):
                if (to := step(state, role[0])) is not None:
                    cost, audit, out = rest(i, to, inserted + 1)
                    found.append((cost + 5, "I" + audit, (f"{role}:", *out)))
        if i < len(turns):
            role, text, must_go, cut = turns[i]
            cost, audit, out = rest(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, out))
            for new, edit, price in [(role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)]:
                if not must_go and (to := step(state, new[:1])) is not None:
                    cost, audit, out = rest(i + 1, to, 0)
                    found.append((cost + price + 5 * cut, edit + audit, (f"{new}:{text}", *out)))
        return min(found, default=(10**9, "", ()))

    return rest(0, "", 0)


def brute(rows):
    """rows: conv_id, turn, role, text, present."""
    convs = {}
    for conv, turn, role, text, present in rows:
        convs.setdefault(conv, [])
        if present:
            text = " " if text is None else text
            convs[conv].append((turn is not None, turn or 0, " " if role is None else role, hashlib.sha256(text.encode()).digest(), text))
    out = []
    for conv, own in convs.items():
        own.sort()
        seen, turns, counts = set(), [], [0, 0, 0]
        for _, _, role, _, text in own:
            bare = text.rstrip(t.WHITE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            turns.append((role, text, fault in (0, 1), fault == 2))
        timed = [x[1] for x in own if x[0]]
        gaps = max(timed) - min(timed) + 1 - len(set(timed)) if timed else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, repaired = best(tuple(turns))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)



def made(rng, n):
    return tuple((rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), "x", rng.random() < 0.15, rng.random() < 0.15) for _ in range(n))


def as_bytes(turns):
    place = lambda r: "sua".find(r[0]) if r[:1] in ("s", "u", "a") else 3
    return bytes(place(r) | (4 if must_go else 8 if cut else 0) for r, _, must_go, cut in turns)


def test_layers_against_every_edit():
    rng = random.Random(5)
    for k in range(1500):
        turns = made(rng, rng.randint(0, 9))
        assert t.cheapest(as_bytes(turns)) == best(turns)[:2], turns


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_segments_change_nothing(segment):
    rng = random.Random(segment)
    for _ in range(400):
        turns = made(rng, rng.randint(0, 24))
        assert t.cheapest(as_bytes(turns), segment) == best(turns)[:2], turns


def test_time_grows_with_turns_alone():
    rng = random.Random(1)
    codes = as_bytes(made(rng, 20_000))
    cost, audit = t.cheapest(codes)
    assert cost > 5_000 and len(audit.replace("I", "")) == len(codes)
    assert cost == t.cheapest(codes, 50)[0] and audit == t.cheapest(codes, 50)[1]


TEXTS = ["Yes.", "No!", "cut", "", " \n\t", "Why?  ", "é ok.", "　", None, "long " * 5_000 + "end."]


def odd_rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "assistant", "user", "system", None, "", "tool"]
    rows = [(c, rng.choice([k, k, k, None, 3]), rng.choice(roles), rng.choice(TEXTS), rng.random() < 0.9) for c in range(120) for k in range(rng.randint(1, 8))]
    rows += [(None, 0, "user", "a.", True), (None, None, "assistant", "b.", True), (900, 1, "user", "x.", False), (None, 0, "user", "a.", True)]
    rows += [(901, k, ("user", "assistant")[k % 2], f"Turn {k // 3}.", True) for k in range(200)]
    rows += [(902, 5, "user", "same.", True)] * 50
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, present boolean"


def test_rows_against_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("numbers", F.lit(2))
    got = t.repair_digests(df)
    assert got.schema["conv_id"].dataType.simpleString() == "bigint"
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows)
    assert t.repair_digests(df.limit(0)).count() == 0


def test_repaired_turns_make_up_the_digest(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    texts = {}
    for r in sorted(t.repaired(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        own = texts.setdefault(r.conv_id, [])
        assert r.place == len(own) and r.edit in "KRI"
        own.append(f"{r.role}:{r.text}")
    want = {r[0]: r[-1] for r in brute(rows)}
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in want} == want


def test_damage(spark):
    rows = [(c, k, "assistant", "A. b! c?") for c in range(60) for k in range(6)] + [(None, None, None, None), (7, None, "user", None)]
    got = sorted([tuple(r) for r in t.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()], key=str)
    want = []
    for c, k, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if k is None else k}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        elif kind == 4:
            role = "user"
        want += [(c, k, role, text, kind != 0)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=str)
