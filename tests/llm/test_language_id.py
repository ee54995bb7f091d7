import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from tesspan.llm import language_id as l
from tesspan.llm.common import table

SYLLABLES = {
    "en": "th er on an the ing and ed of wh sh ly",
    "de": "ch ein sch ung der ü ß en zu keit ä tz",
    "nl": "aa ij oe een het van ui gr sch en de ks",
    "fr": "eau é ou ai que ment les è ç une tion oi",
    "es": "ción ñ ar os ado que el í mente rr ez la",
    "it": "zione gli che ò are etto del gn io ca lla tto",
    "xx": "qz kx vv wj zzu kq jx qq vk xu jw kz",
}


def documents(langs, n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = langs[i % len(langs)]
        words = ["".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(rng.randint(15, 60))]
        rows.append((i, " ".join(words).capitalize() + ".", lang))
    return rows


SCHEMA = "doc_id long, text string, lang string"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_with_close_languages(spark):
    rows = documents(list(SYLLABLES), 1400)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", score int, p string")
    got = {r.doc_id: r for r in l.predicted(df, l.fitted(df)).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == held(i) and 0 <= got[i].score <= 1 for i in got)
    out = [(lang, got[i].lang_pred) for i, _, lang in rows if held(i)]
    assert sum(a == b for a, b in out) / len(out) > 0.97


def test_accuracy_on_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = [(truth[r.doc_id], r.lang_pred) for r in l.predicted(docs, l.fitted(docs)).collect() if r.held_out]
    assert len(out) > 150 and sum(a == b for a, b in out) / len(out) > 0.97


def plain(model, x):
    """Family, then duels, one text at a time."""
    z = [sum(a * b for a, b in zip([*x, 1.0], column)) for column in model.weights.T.tolist()]
    n = len(model.families)
    e = [np.exp(v - max(z[:n])) for v in z[:n]]
    best, at = e.index(max(e)), n
    for f, (_, langs) in enumerate(model.families):
        wins, sums, chance = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            v, at = z[at], at + 1
            wins[a if v >= 0 else b] += 1
            sums[a], sums[b] = sums[a] + v, sums[b] - v
            chance[a], chance[b] = chance[a] + 1 / (1 + np.exp(-2 * v)), chance[b] + 1 / (1 + np.exp(2 * v))
        if f == best:
            lang = min(langs, key=lambda c: (-wins[c], -sums[c], c))
            return lang, e[f] / sum(e) * (chance[lang] / (len(langs) - 1) if len(langs) > 1 else 1)


def test_predictions_against_plain_duels():
    rows = documents(list(SYLLABLES), 140)
    model = l.fit(l.features([t for _, t, _ in rows]), [lang for *_, lang in rows])
    assert [f for f, _ in model.families] == ["germanic", "romance", "xx"]
    x = np.vstack([l.features([t for _, t, _ in documents(list(SYLLABLES), 60, 9)]), np.zeros((1, l.WIDTH))])
    lang, score = model.predict(x)
    want = [plain(model, v) for v in x.tolist()]
    assert lang.tolist() == [w[0] for w in want] and np.allclose(score, [w[1] for w in want])


def test_blocks_change_nothing(monkeypatch):
    text = documents(["fr"], 1)[0][1] * 7
    whole = l.features([text, "", "a", "ab"])
    for block in (1, 5, 64):
        monkeypatch.setattr(l, "BLOCK", block)
        assert np.array_equal(l.features([text, "", "a", "ab"]), whole)
    assert np.isclose((whole[0] ** 2).sum(), 1) and not whole[1].any()


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 3] > 0.3, 1.0, -1.0)
    w = l.machine(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.98


def test_odd_rows(spark):
    rows = [*documents(["en", "fr"], 80), (None, "The thing and the others", "en"), (None, None, "en"), (900, "", "fr"), (901, "123 !? _", None), (902, "Ñ", None), (903, "a" * 3_000_000, None), (3, "same", "en"), (3, "same", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.lang_pred) for r in l.predicted(df, l.fitted(df)).collect()}
    assert {(900, "und"), (901, "und"), (None, "und")} <= got and (902, "und") not in got and (None, "en") in got
    assert l.predicted(df, l.fitted(df)).count() == len(rows)
    only = df.where("lang = 'fr'")
    assert {r.lang_pred for r in l.predicted(df, l.fitted(only)).collect()} == {"fr", "und"}
    assert l.fitted(df.limit(0)) is None and {(r.lang_pred, r.score) for r in l.predicted(df, None).collect()} == {("und", 0.0)}
    assert l.predicted(df.limit(0), None).count() == 0


@pytest.mark.parametrize("lang, family", [("en", "germanic"), ("pt-BR", "romance"), ("EN_us", "germanic"), ("tlh", "tlh")])
def test_families(lang, family):
    assert l.family(lang) == family


def test_sample_is_bounded(spark):
    rows = documents(["en"], 300) + documents(["fr"], 20) + [(1000 + i, "Copy of a text.", "es") for i in range(300)]
    got = l.training_sample(spark.createDataFrame(rows, SCHEMA), rows=90).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got}["es"] == 1 and all(r["count"] <= 30 for r in got) and len(got) == 3
