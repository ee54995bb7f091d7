"""Language identification in two steps: the language family first, then the language within it.

A text is counted by the letters' byte pairs and triples (A-Z lower-cased, what is no letter in ASCII is a
space), hashed into WIDTH features, whose square roots of shares make a vector of length one.  A
multinomial logistic model tells families apart; within a family every two languages have a linear
support vector machine (squared hinge loss, dual coordinate descent), and the language that wins most of its
duels is predicted; of several that win as many the one with the larger sum of margins, then the smaller name.

FAMILIES names the family of a language tag's first part; a language that it doesn't hold is a family of its
own.  The models are fitted on a sample: at most SAMPLE_ROWS rows, the same number of each of the LANGUAGES most frequent
languages, equal texts once.  Every row of the table is scored over its whole text, long ones block by block.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text where nothing can be
learned from; with one language every text with a letter is of it; a lang that is null, or a row without letters, teaches
nothing; rows repeated or with a null doc_id (never held out) are scored like any other; other
columns are ignored.  The score is the family's probability times the mean probability of the language's duels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import saved, table

WIDTH = 2048
#: Bounds of the sample that the models are fitted on.
SAMPLE_ROWS, LANGUAGES = 4_000, 200
UNKNOWN = "und"
#: Bytes that are counted at once.
BLOCK = 1 << 20
STEPS, RATE, DECAY = 300, 0.3, 1e-4
EPOCHS, COST = 20, 10.0

#: Languages of each family (fixed values).
_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga cy br gd",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "iranian": "fa ku ps tg",
    "malayo-polynesian": "id ms jv tl mg",
}
FAMILIES = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def family(lang: str) -> str:
    return FAMILIES.get(re.split("[-_]", lang.lower())[0], lang)


def features(texts: list[str]) -> np.ndarray:
    """One row of unit length for each text (zero where it has no two bytes)."""
    out = np.zeros((len(texts), WIDTH))
    shift = np.uint32(32 - WIDTH.bit_length() + 1)
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
        for at in range(0, max(len(raw) - 1, 0), BLOCK):
            own = raw[at : at + BLOCK + 2].astype(np.uint32)
            pairs = (own[:-1] << np.uint32(8) | own[1:])[:BLOCK]
            triples = own[:-2] << np.uint32(16) | own[1:-1] << np.uint32(8) | own[2:]
            codes = np.concatenate([pairs * np.uint32(2246822519), triples * np.uint32(2654435761)]) >> shift
            out[k] += np.bincount(codes, minlength=WIDTH)
        total = out[k].sum()
        if total:
            out[k] = np.sqrt(out[k] / total)
    return out


def machine(x: np.ndarray, y: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights (and a last one for the bias) of a linear support vector machine; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    rng, alpha, w = np.random.default_rng(seed), np.zeros(len(x)), np.zeros(x.shape[1])
    ridge = 0.5 / COST
    diagonal = (x * x).sum(1) + ridge
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + ridge * alpha[i]
            new = max(alpha[i] - slope / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def logistic(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Weights of a multinomial logistic model, a column for each of n classes, by Adam over all rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, m, v, hot = np.zeros((x.shape[1], n)), 0.0, 0.0, np.eye(n)[y]
    share = hot.mean(0)
    weight = (hot @ (1 / (n * share)))[:, None] / len(x)  # families count alike
    for step in range(1, STEPS + 1):
        g = x.T @ (weight * (_softmax(x @ w) - hot)) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Model:
    """Families by name with their languages by name; weights of the families, then of each family's duels in order."""

    families: list[tuple[str, list[str]]]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language and score of every row of features."""
        z = np.hstack([x, np.ones((len(x), 1))]) @ self.weights
        n = len(self.families)
        of_family = _softmax(z[:, :n])
        best = of_family.argmax(1)
        lang, score, at = np.empty(len(x), object), of_family[np.arange(len(x)), best], n
        for f, (_, langs) in enumerate(self.families):
            duels = list(combinations(range(len(langs)), 2))
            rows = np.flatnonzero(best == f)
            margins = z[rows, at : at + len(duels)]
            at += len(duels)
            wins, sums, chance = (np.zeros((len(rows), len(langs))) for _ in range(3))
            for k, (a, b) in enumerate(duels):
                own = margins[:, k]
                sure = 1 / (1 + np.exp(-2 * np.clip(own, -30, 30)))
                wins[:, a] += own >= 0
                wins[:, b] += own < 0
                sums[:, a] += own
                sums[:, b] -= own
                chance[:, a] += sure
                chance[:, b] += 1 - sure
            order = np.lexsort((np.broadcast_to(-np.arange(len(langs)), wins.shape), sums, wins))  # by wins, then sums, then name
            top = order[:, -1] if len(rows) else np.zeros(0, int)
            lang[rows] = np.array(langs, object)[top]
            if duels:
                score[rows] *= chance[np.arange(len(rows)), top] / (len(langs) - 1)
        return lang, score


def fit(x: np.ndarray, langs: list[str]) -> Model:
    known = sorted(set(langs))
    families = sorted({family(lang) for lang in known})
    grouped = [(f, [lang for lang in known if family(lang) == f]) for f in families]
    place = {f: i for i, f in enumerate(families)}
    columns = [logistic(x, np.array([place[family(lang)] for lang in langs]), len(families))]
    own = np.array(langs, object)
    for _, members in grouped:
        for a, b in combinations(members, 2):
            rows = np.flatnonzero((own == a) | (own == b))
            columns.append(machine(x[rows], np.where(own[rows] == a, 1.0, -1.0))[:, None])
    return Model(grouped, np.hstack(columns))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        out = []
        for text in batch:
            out.append(features([text])[0].astype(np.float32).tobytes() if _LETTER.search(text) else None)
        yield pd.Series(out, dtype=object)


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> DataFrame:
    """lang and features x of the sample."""
    taught = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = taught.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    quota = max(1, rows // max(1, len(counts)))
    shares = [(r["lang"], min(1.0, 1.5 * quota / r["count"])) for r in counts]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")  # LANGUAGES rows at most
    spot = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    some = taught.where("text IS NOT NULL").join(F.broadcast(shares), "lang").where(spot < F.col("share"))
    some = some.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))
    some = saved(some.select("lang", "digest", F.pandas_udf(_counted, T.BinaryType())("text").alias("x")).where("x IS NOT NULL"), "sample")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("digest"))
    return some.withColumn("nth", nth).where(F.col("nth") <= quota).select("lang", "digest", "x")


def fitted(docs: DataFrame, rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> Model | None:
    """The models, or None where there is nothing to learn from."""
    got = sorted(training_sample(docs, rows, languages).collect(), key=lambda r: (r.lang, r.digest))
    if not got:
        return None
    return fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(np.float64), [r.lang for r in got])


def _predictor(model: Model | None):
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            lang, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            own = batch.tolist()
            rows = [i for i, t in enumerate(own) if model is not None and t and _LETTER.search(t)]
            for at in range(0, len(rows), 1000):
                part = rows[at : at + 1000]
                lang[part], score[part] = model.predict(features([own[i] for i in part]))
            yield pd.DataFrame({"lang_pred": lang, "score": np.round(np.clip(score, 0, 1), 6)})

    return F.pandas_udf(predict, "lang_pred string, score double")


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    out = docs.select("doc_id", _predictor(model)("text").alias("p"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fitted(docs))
