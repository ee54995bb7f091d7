import random
import zlib

import numpy as np

from tesspan.llm import quality as q


def make(n, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(5, 400))
        good = rng.random() < 0.7
        if not good:
            at = rng.randrange(len(words))
            words[at : at + 150] = [rng.choice(["###", "$$!", "%%"]) + w for w in rng.choices(vocab, k=150)]
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(good), 0))
    return docs, labels


DOCS = "doc_id long, text string, lang string, score double"


def test_held_out_accuracy(spark):
    docs, labels = make(600)
    out = q.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert len(out) == 600 and out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    truth = dict((a, b) for a, b, _ in labels)
    held = out[out.held_out]
    assert (held.predicted == [truth[i] for i in held.doc_id]).mean() > 0.95


def test_odd_rows(spark):
    docs, labels = make(60)
    odd = [(1000, None, "a", 1.0), (1001, "", None, None), (None, "no id", "a", 1.0), (1, docs[1][1], "a", 1.0), (1002, "w" * 3_000_000, "a", 1.0), (1003, "word " * 300_000, "a", 1.0)]
    marks = labels + [(1, None, None), (None, 1, 1), (5, 0, 0), (5, 0, 0)]
    df = spark.createDataFrame(docs + odd, DOCS)
    out = q.quality_scores(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).toPandas()
    assert len(out) == 66 and out.score.between(0, 1).all()
    assert out[out.doc_id == 1].score.nunique() == 1
    assert out[out.doc_id.isin([1000, 1001])].score.nunique() == 1


def test_without_labels_or_rows(spark):
    docs, labels = make(20)
    df, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in q.quality_scores(df, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in q.quality_scores(df, ones).collect()}) == 1
    assert q.quality_scores(df.limit(0), ones).count() == 0
    assert q.good_documents(df, ones).columns == df.columns


def test_batches_do_not_change_scores():
    docs, _ = make(30)
    bags = [d[1].encode().split() for d in docs]
    x, n = q.encode(bags)
    alone = [q.encode([b]) for b in bags]
    assert np.allclose(x, np.concatenate([a for a, _ in alone])) and n.tolist() == [int(m[0]) for _, m in alone]
    model = q.fit(x, n, np.array([i % 2 for i in range(30)], np.float32))
    assert np.allclose(model.scores(x, n), [model.scores(*a)[0] for a in alone], atol=1e-5)


def test_attention_prefers_the_telling_passage():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(400):
        x = rng.normal(0, 0.3, (6, q.WIDTH)).astype(np.float32)
        if i % 2:
            x[rng.integers(6), :10] += 3
        bags.append(x)
        labels.append(i % 2)
    model = q.fit(np.concatenate(bags), np.full(400, 6), np.array(labels, np.float32))
    hits = [np.argmax(model.attention(model.hidden(b))) == np.argmax(b[:, :10].sum(1)) for b, y in zip(bags, labels) if y]
    assert np.mean(hits) > 0.9


def test_scores_against_a_plain_loop(spark, monkeypatch):
    """Each passage encoded and each document pooled one by one, without blocks or batches."""
    import math

    docs, labels = make(80)
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = q.fitted(df, marks)
    w = model.weights
    want = {}
    for i, text, *_ in docs:
        words = text.encode().split()
        total, pooled = 0.0, np.zeros(q.HIDDEN)
        for at in range(0, max(1, len(words)), q.PASSAGE):
            h = model.hidden(q.encode([words[at : at + q.PASSAGE]])[0])[0].astype(float)
            e = math.exp(min(30, max(-30, float((np.tanh(h @ w["v"]) * (1 / (1 + np.exp(-(h @ w["u"]))))) @ w["a"]))))
            total, pooled = total + e, pooled + e * h
        want[i] = 1 / (1 + math.exp(-float(pooled / total @ w["c"] + w["d"][0])))
    for r in q.scored(df, model).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.score == round(r.score, 6)


def test_blocks_hold_whole_passages(monkeypatch):
    rng = random.Random(4)
    for block in (7, 50, 1000):
        monkeypatch.setattr(q, "_BLOCK", block)
        for text in ("", " ", "a", "w" * 90, " ".join("x" * rng.randint(1, 9) for _ in range(300)) + "  ", "a\tb\n" * 200):
            parts = list(q._blocks(text))
            assert [w for p in parts for w in p] == text.encode().split()
            assert all(len(p) % q.PASSAGE == 0 for p in parts[:-1])


def test_clashing_names(spark):
    docs, labels = make(30)
    df = spark.createDataFrame(docs, DOCS).withColumnRenamed("score", "__score")
    out = q.good_documents(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == df.columns and out.where("__score = 0.5").count() == out.count()
