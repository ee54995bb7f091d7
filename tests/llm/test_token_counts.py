import random

import pytest

from tesspan.llm import token_counts as t


def brute(text, spans, rule):
    encoding, _ = t.encoder()
    owner = [None] * len(text.encode())
    at = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for k, (a, b) in enumerate(spans):
        for x in range(at[min(a, len(text))], at[min(b, len(text))]):
            owner[x] = k
    got, outside, crossing, pos = [0.0] * len(spans), 0.0, 0, 0
    ids = encoding.encode_ordinary(text)
    for i in ids:
        n = len(encoding.decode_single_token_bytes(i))
        held = []
        for o in owner[pos : pos + n]:
            if held and held[-1][0] == o:
                held[-1][1] += 1
            else:
                held.append([o, 1])
        crossing += len(held) > 1
        if rule == "first":
            held = [[held[0][0], 1]]
        elif rule == "most":
            held = [[max(held, key=lambda h: h[1])[0], 1]]
        total = sum(h[1] for h in held)
        for o, h in held:
            if o is None:
                outside += h / total
            else:
                got[o] += h / total
        pos += n
    return got, outside, crossing, len(ids)


@pytest.mark.parametrize("rule", t.RULES)
def test_against_brute_force(rule):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choices("ab é\n\n  日ü.'s1", k=rng.randint(0, 80)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randint(2, 8)))) if text else [0, 0]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        rng.shuffle(spans)
        per, outside, crossing, n = t.attribute(text, spans, rule)
        want = brute(text, spans, rule)
        assert per.tolist() == pytest.approx(want[0]) and outside == pytest.approx(want[1]) and (crossing, n) == want[2:]
        assert per.sum() + outside == pytest.approx(n)


def test_lines_cover_the_text():
    for text in ("", "a", "\n", "a\nb", "é\n\n日\n"):
        assert "".join(text[a:b] for a, b in t.lines(text)) == text and all(x.count("\n") <= 1 for x in (text[a:b] for a, b in t.lines(text)))


def test_rows(spark):
    rows = [(1, "one line\ntwo  lines\n\n\nend", "z"), (2, None, "z"), (3, "", None), (None, "é\né", "z"), (1, "one line\ntwo  lines\n\n\nend", "z"), (4, "w" * 500_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = t.section_counts(df).collect()
    assert len(out) == 6
    for r in out:
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        if len(text) < 1000:
            want = brute(text, t.lines(text), "most")
            assert (r.section_tokens, r.outside, r.n_crossing, r.n_tokens) == (pytest.approx(want[0]), want[1], want[2], want[3])
    assert t.section_counts(df.limit(0)).count() == 0


def test_given_spans(spark):
    df = spark.createDataFrame([(1, "title body", [(0, 5), (6, 10)]), (2, "x", None), (3, None, [(0, 4)])], "doc_id long, text string, fields array<struct<start: int, end: int>>")
    out = {r.doc_id: r for r in t.section_counts(df, "fields", "split").collect()}
    assert out[1].n_sections == 2 and sum(out[1].section_tokens) + out[1].outside == pytest.approx(out[1].n_tokens)
    assert out[2].outside == out[2].n_tokens and out[3].section_tokens == [0.0]


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\u3000", "\x1c", " \n\t\u00a0", "\n\n "])
def test_tokens_of_long_runs_are_those_of_the_pattern(run):
    encoding, _ = t.encoder()
    for n in (1, 31, 32, 33, 34, 4095, 4096, 4097, 4098, 100_000, 400_000):
        own = (run * n)[:n]
        for text in (own, f"a{own}", f"{own}b", f"a{own}b {own}", f"a{own}'s{own}!{own}1", f"{own}\u00e9{own}"):
            assert t.tokens(text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n\t"])
def test_runs_that_the_pattern_alone_can_not_take(spark, run):
    text = f"a {run * (2_000_000 // len(run))} b"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    row = t.section_counts(df).where("doc_id = 1").first()
    assert row.n_tokens == len(t.tokens(text)) and sum(row.section_tokens) == row.n_tokens
    assert t.with_token_count(df).where("doc_id = 1").first().n_tokens == row.n_tokens
