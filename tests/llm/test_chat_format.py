import hashlib
import random

import pytest

from tesspan.llm import chat_format as c

T = c.MarkedTurns()
HARD = ["", c.EXTRA, "\\", "</turn>\n### assistant: x</turn>\n", " : ", "é\n\n日", "####\\#<<", c.SENTINEL[:1], c.SENTINEL, f"{c.SENTINEL}\ue001{c.SENTINEL}", " lead and trail "]


def test_round_trip_and_spans():
    rng = random.Random(3)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "a: b", "#<\\"]), rng.choice(HARD) + rng.choice(HARD)) for _ in range(rng.randint(0, 6))]
        text, spans, rewrites = c.locate(turns, T)
        assert text == T(turns) and T.read(text) == turns and not rewrites
        for (_, own), s in zip(turns, spans):
            assert T.plain(text[s.text_start : s.text_end]) == own
        assert "".join(text[s.start : s.end] for s in spans) == text


def test_read_rejects_other_texts():
    with pytest.raises(ValueError):
        T.read("### user: a")


def test_templates_of_other_kinds():
    turns = [("user", "hi"), ("assistant", "yo "), ("user", "more"), ("assistant", " end")]

    def end_mark(ts):
        return "<s>" + "".join(f"[{r}]{t}" for r, t in ts) + "</s>"

    text, spans, rewrites = c.locate(turns, end_mark)
    assert not rewrites and [text[s.text_start : s.text_end] for s in spans] == [t for _, t in turns]

    def drops_old_answers(ts):  # an answer goes once another user turn follows
        last = max([i for i, (r, _) in enumerate(ts) if r == "user"], default=0)
        return "".join(f"[{r}]{t}\n" for i, (r, t) in enumerate(ts) if r == "user" or i > last)

    text, spans, rewrites = c.locate(turns, drops_old_answers)
    assert rewrites and spans[1].rewritten and not spans[0].rewritten
    assert text[spans[3].text_start : spans[3].text_end] == " end"

    def strips(ts):
        return "".join(f"[{r}]{t.strip()}\n" for r, t in ts)

    text, spans, rewrites = c.locate(turns, strips)
    assert not rewrites and text[spans[1].text_start : spans[1].text_end] == "yo"

    def silent(ts):
        return "".join(f"[{r}]\n" for r, t in ts)

    assert all(s.text_start is None for s in c.locate(turns, silent)[1])


def brute(rows):
    convs = {}
    for i, turn, role, text in rows:
        convs.setdefault(i, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = []
    for i, ts in convs.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((i, len(ts), sha("".join(f"{r}\n{t}\n" for _, r, t in ts)), len(loss), sha(loss), len(T([(r, t) for _, r, t in ts]))))
    return sorted(out, key=str)


def test_rows(spark):
    rng = random.Random(8)
    rows = [(i, k, rng.choice(["user", "assistant", None, "system"]), rng.choice([*HARD, None])) for i in range(40) for k in range(rng.randint(1, 9))]
    rows += [(None, 1, "assistant", "x"), (None, None, "assistant", "y"), (3, 0, "assistant", "again"), (3, 0, "assistant", "again"), (900, 0, "assistant", "z#" * 100_000)]
    rows += [(901, k, "assistant", f"turn {k}") for k in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = sorted([tuple(r) for r in c.read_back(c.formatted(df)).collect()], key=str)
    assert got == brute(rows)
    assert c.read_back(c.formatted(df.limit(0))).count() == 0
