"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Every passage is encoded (letters, words by hashed
bucket, repetition, lengths); gated attention, learned from document labels alone, weighs the encodings, and the weighted
sum is scored.  The model is fitted on a sample of labelled rows that SAMPLE_ROWS and
SAMPLE_CHARS bound; every row of the table is scored over its whole text.

Defined results: null text counts as empty, and an empty text is a bag of one passage
without words; without labels of both kinds the score of every row is the smoothed
share of label 1; a row repeated, or with a null doc_id, is scored like any other;
of several labels of a doc_id their mean counts; other columns are ignored.  Scores are rounded to
six places, so how rows are batched doesn't show; long texts are read in blocks that end with a passage.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hinted, saved, table, unused

PASSAGE = 64
#: Bounds of the sample that the model is fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 40_000_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 128, 0.01, 1e-4
_BLOCK = 1 << 20

_CLASS = np.concatenate([np.arange(128), 128 + (np.arange(128) >> 3)])
_CLASSES = int(_CLASS.max()) + 1
WORDS = 128
WIDTH = _CLASSES + 4 + WORDS
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, whole passages at a time: blocks end after a word, and what a passage lacks comes with the next block."""
    text, at, held = text or "", 0, []
    while True:
        end = at + _BLOCK
        gap = _SPACE.search(text, end) if end < len(text) else None
        stop = gap.start() if gap else len(text)
        held += text[at:stop].encode("utf-8", "surrogatepass").split()
        at = stop
        if at >= len(text):
            break
        whole = len(held) // PASSAGE * PASSAGE
        if whole:
            yield held[:whole]
            held = held[whole:]
    yield held


def encode(bags: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the bags' words, and the number of passages of each bag."""
    n_words = np.fromiter(map(len, bags), np.int64, len(bags))
    passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(passages) - passages
    total = int(n_words.sum())
    within = np.arange(total) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    of = np.repeat(first, n_words) + within // PASSAGE
    size, words = int(passages.sum()), list(chain.from_iterable(bags))
    lengths = np.fromiter(map(len, words), np.int64, total)
    codes = np.fromiter(map(hash, words), np.int64, total)  # only compared with each other, so any process's seed will do
    raw = np.frombuffer(b"".join(words), np.uint8)
    counts = np.bincount(np.repeat(of, lengths) * _CLASSES + _CLASS[raw], minlength=size * _CLASSES).reshape(size, _CLASSES)
    n_bytes, n = counts.sum(1), np.bincount(of, minlength=size)
    again = np.zeros(total, bool)
    again[1:] = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
    key = np.sort((of << 40) | (codes & ((1 << 40) - 1)))
    fresh = np.ones(total, bool)
    fresh[1:] = key[1:] != key[:-1]
    some = np.maximum(n, 1)
    out = np.empty((size, WIDTH), np.float32)
    buckets = np.fromiter(map(zlib.crc32, words), np.int64, total) % WORDS
    counted = np.bincount(of * WORDS + buckets, minlength=size * WORDS).reshape(size, WORDS)
    out[:, _CLASSES + 4 :] = np.sqrt(counted / some[:, None])
    out[:, :_CLASSES] = np.sqrt(counts / np.maximum(n_bytes, 1)[:, None])
    out[:, _CLASSES] = np.log1p(n_bytes / some)
    out[:, _CLASSES + 1] = np.bincount(of, weights=again, minlength=size) / some
    out[:, _CLASSES + 2] = np.bincount(key >> 40, weights=fresh, minlength=size) / some
    out[:, _CLASSES + 3] = n / PASSAGE
    return out, passages


@dataclass
class Model:
    """Encoder (w, b), gated attention (v, u, a) and scorer (c, d) over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) * self.scale, -8, 8) @ self.weights["w"] + self.weights["b"])

    def attention(self, h: np.ndarray) -> np.ndarray:
        w = self.weights
        return (np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"])))) @ w["a"]

    def scores(self, x: np.ndarray, passages: np.ndarray) -> np.ndarray:
        h = self.hidden(x)
        e = np.exp(np.clip(self.attention(h), -30, 30))
        at = np.cumsum(passages) - passages
        z = np.add.reduceat(e[:, None] * h, at) / np.add.reduceat(e, at)[:, None]
        return 1 / (1 + np.exp(-(z @ self.weights["c"] + self.weights["d"][0])))


def fit(x: np.ndarray, passages: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the log loss of the bags; gradients by hand."""
    rng = np.random.default_rng(seed)
    scale = 1 / np.maximum(x.std(0), 0.02)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / math.sqrt(shape[0]), shape).astype(np.float32)

    w = {"w": start(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": start(HIDDEN, GATE), "u": start(HIDDEN, GATE), "a": start(GATE), "c": start(HIDDEN), "d": np.zeros(1, np.float32)}
    model = Model(x.mean(0), scale.astype(np.float32), w)
    x = np.clip((x - model.mean) * model.scale, -8, 8)
    first = np.cumsum(passages) - passages
    m1, m2, step = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            bags = order[at : at + BATCH]
            n = passages[bags]
            starts = np.cumsum(n) - n
            rows = np.repeat(first[bags] - starts, n) + np.arange(n.sum())
            of, xs = np.repeat(np.arange(len(bags)), n), x[rows]
            h = np.tanh(xs @ w["w"] + w["b"])
            t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
            e = np.exp(np.clip((t * s) @ w["a"], -30, 30))
            p = e / np.add.reduceat(e, starts)[of]
            z = np.add.reduceat(p[:, None] * h, starts)
            g = (1 / (1 + np.exp(-(z @ w["c"] + w["d"][0]))) - labels[bags]) / len(bags)
            dz = g[:, None] * w["c"]
            dp = (h * dz[of]).sum(1)
            de = p * (dp - np.add.reduceat(p * dp, starts)[of])
            dts = de[:, None] * w["a"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = (p[:, None] * dz[of] + dt @ w["v"].T + ds @ w["u"].T) * (1 - h * h)
            grads = {"w": xs.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}
            step += 1
            for k, q in grads.items():
                q = q + DECAY * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * q
                m2[k] = 0.999 * m2[k] + 0.001 * q * q
                w[k] -= (RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([b"".join(encode([words])[0].tobytes() for words in _blocks(t)) for t in batch], dtype=object)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, text, label of labelled rows outside the held-out third: the first by a hash, within the bounds."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.avg("quality").alias("label"))
    marks = saved(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "marks")
    sized = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(hinted(marks), "doc_id")
    sized = saved(sized.withColumn("size", F.char_length("text") + 1).where(F.col("size") <= chars), "sample")
    if (sized.agg(F.sum("size")).first()[0] or 0) > chars:
        share = chars / max(1, sized.agg(F.sum("size")).first()[0])
        sized = sized.where(F.pmod(F.xxhash64(F.lit("size"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return sized.select("doc_id", "text", "label")


def fitted(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | float:
    """The model, or where the labels are all of one kind the smoothed share of label 1."""
    encoded = F.pandas_udf(_encoded, T.BinaryType())
    got = training_sample(docs, labels, rows, chars).select("doc_id", "label", encoded("text").alias("x")).collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    y = np.array([r.label for r in got], np.float32)
    if len(got) < 2 or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]
    return fit(np.concatenate(parts), np.array([len(p) for p in parts]), y)


def _scorer(model: Model | float):
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out, bags, held, size = [], [], [], 0

            def flush() -> None:
                nonlocal bags, held, size
                if held:
                    x, n = encode(bags)
                    at, merged = 0, []
                    for k in held:
                        merged.append(int(n[at : at + k].sum()))
                        at += k
                    out.append(model.scores(x, np.array(merged)))
                bags, held, size = [], [], 0

            if isinstance(model, float):
                yield pd.Series(np.full(len(batch), model))
                continue
            for text in batch:
                k = 0
                for words in _blocks(text):
                    bags.append(words)
                    size += len(words)
                    k += 1
                held.append(k)
                if size > 100_000:
                    flush()
            flush()
            yield pd.Series(np.round(np.concatenate(out).astype(np.float64), 6) if out else np.zeros(0))

    return F.pandas_udf(score, T.DoubleType())


def scored(docs: DataFrame, model: Model | float, name: str = "score") -> DataFrame:
    """docs with the score of each row's whole text."""
    return docs.withColumn(name, _scorer(model)(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fitted(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all columns."""
    (score,) = unused(docs, "__score")
    return scored(docs, fitted(docs, labels), score).where(F.col(score) >= 0.5).drop(score)


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
