"""Secret scans by a battery of randomness tests.

Base spans come from fixed patterns.  Beside them every long token, in a base span or not,
is tried as a secret: its encoding is inferred from its characters, and eight tests ask how far it is from
random text of that encoding: chi-squared uniformity over the alphabet, over its letters whatever their case, over kinds (digits,
capitals, small letters), over vowels and over pairs of kinds; runs tests over kinds and over vowels among neighbouring
letters; and lag-one serial correlation.  The logarithms of their p-values are combined with weights.

A run is cut at every '=' that is not padding at its end; what no alphabet holds is cut at '/',
and what still has none at '-' and '_'.  Pieces of SHORTEST or more characters are tried.
Plain numbers and letters in one case (or capitalised) are not.

What ordinary tokens reach is known from a fixed reference, the same for every table: for each
alphabet and length band REFERENCE tokens of each of several kinds (words of a vocabulary and made-up syllables, in the cases
that the alphabet has, with and without dates and counters, joined as paths and slugs are).  The weights are those that tell
random tokens best from it (Fisher's discriminant).  A token's p-value is the share of reference tokens that look as
random; of each kind, beyond the TAIL lowest, it goes on falling at the exponential rate of these, down to LEAST.  What looks less random than RANDOM_SHARE of random tokens do is never found.  In every length band the Benjamini-Hochberg rule keeps the share of false
finds at RATE.  So how rare secrets may be depends on how far the tests tell a length apart, and how
large the table is doesn't matter.

Defined results: null text counts as empty; rows are scanned one by one, so repeated rows
and null ids come back as they are; a whole text is scanned whatever its length; spans are
in code points with exclusive ends; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

RATE, REFERENCE, SHORTEST = 0.01, 10_000, 20
TAIL, LEAST, RANDOM_SHARE = 100, 1e-9, 0.97
KINDS = ("assign", "access", "hex", "random")
#: Patterns of the base spans (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_-]))?" % SHORTEST)
_CUTS = (re.compile(r"[^/]+"), re.compile(r"[^/_-]+"))
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = [
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _LOWER.upper() + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base62", _DIGITS + _LOWER.upper() + _LOWER),
    ("base64", _LOWER.upper() + _LOWER + _DIGITS + "+/"),
    ("base64url", _LOWER.upper() + _LOWER + _DIGITS + "-_"),
]
_PLACES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS}
_SETS = [(name, frozenset(chars)) for name, chars in ALPHABETS]
#: P-values are counted by tenths of a decade, from 1 down to LEAST.
BINS = round(-10 * math.log10(LEAST)) + 1
BANDS = (20, 24, 28, 32, 40, 48, 64, 96, 128, 256)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the fixed patterns, by start and then by kind as listed."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(h in low for h in _HINTS):
            out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds every character of the token; None for words and plain numbers."""
    body = token.rstrip("=")
    if not body or body.isdigit() or _WORD.fullmatch(body):
        return None
    used = set(body)
    return next((name for name, chars in _SETS if used <= chars), None)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """start, end, alphabet of every piece to be tried."""
    for m in TOKEN.finditer(text):
        pieces = [m.span()]
        for cut in (None, *_CUTS):
            left = []
            for a, b in pieces:
                for x, y in [c.span() for c in cut.finditer(text, a, b)] if cut else [(a, b)]:
                    body = text[x:y].rstrip("=")
                    if len(body) < SHORTEST:
                        continue
                    name = encoding(body)
                    if name:
                        yield x, y, name
                    elif not body.isdigit() and not _WORD.fullmatch(body):
                        left.append((x, y))
            pieces = left


def _classes(chars: str) -> dict[str, np.ndarray]:
    """For each character: its kind (digit, capital or sign, small letter; without gaps), its letter whatever the case (without gaps), and whether it is a letter and a vowel."""
    kinds = np.unique([0 if c.isdigit() else 2 if c.islower() else 1 for c in chars], return_inverse=True)[1]
    letters = np.unique([c.lower() if c.isalpha() else "0" for c in chars], return_inverse=True)[1]
    return {"kind": kinds, "letter": letters, "is_letter": np.array([c.isalpha() for c in chars]), "is_vowel": np.array([c in "aeiouAEIOU" for c in chars])}


_CLASS = {name: _classes(chars) for name, chars in ALPHABETS}
#: Natural logarithms of p-values that count, at most.
_MOST = 60.0
_erfc = np.vectorize(math.erfc, otypes=[float])


def _upper(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(z / math.sqrt(2))


def _counted(x: np.ndarray, size: int) -> np.ndarray:
    m = len(x)
    return np.bincount((np.arange(m)[:, None] * size + x).ravel(), minlength=m * size).reshape(m, size)


def _uniform(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Chi-squared p-values of rows of counts (Wilson-Hilferty: the cube root of chi-squared over its freedom is nearly normal)."""
    want = counts.sum(1, keepdims=True) * shares
    chi, k = ((counts - want) ** 2 / want).sum(1), len(shares) - 1
    return _upper(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def _two_sided(away: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """P-values of normal deviations; where there is no spread nothing is known."""
    return np.where(spread > 1e-9, 2 * _upper(np.abs(away) / np.sqrt(np.where(spread > 1e-9, spread, 1))), 1.0)


def battery(x: np.ndarray, name: str) -> np.ndarray:
    """Minus the logarithm of the p-value of each test, for tokens of one length (two characters at least): x holds their places in the alphabet."""
    of = _CLASS[name]
    size, (_, n) = len(of["kind"]), x.shape
    kind_shares, letter_shares = (np.bincount(of[c]) / size for c in ("kind", "letter"))
    kinds, letters, vowels = of["kind"][x], of["is_letter"][x], of["is_vowel"][x]
    k = len(kind_shares)
    per = _counted(kinds, k).astype(float)
    two, three = (per**2).sum(1), (per**3).sum(1)
    runs = 1 + (kinds[:, 1:] != kinds[:, :-1]).sum(1)
    runs_spread = (two * (two + n * (n + 1)) - 2 * n * three - n**3) / (n * n * (n - 1.0))
    one_kind = per.max(1) == n  # as far from random as runs can be
    share = of["is_vowel"].sum() / of["is_letter"].sum()
    n_letters, n_vowels = letters.sum(1), vowels.sum(1)
    both = letters[:, 1:] & letters[:, :-1]
    turns, n_both, turn = (both & (vowels[:, 1:] != vowels[:, :-1])).sum(1), both.sum(1), 2 * share * (1 - share)
    off = x - x.mean(1, keepdims=True)
    power = (off * off).sum(1)
    near = (off[:, 1:] * off[:, :-1]).sum(1) / np.where(power > 0, power, 1)
    found = [
        _uniform(_counted(x, size), np.full(size, 1 / size)),
        _uniform(_counted(of["letter"][x], len(letter_shares)), letter_shares),
        _uniform(per, kind_shares),
        np.where(one_kind, 0.0, _two_sided(runs - 1 - (n * n - two) / n, runs_spread)),
        np.where(power > 0, 2 * _upper(np.abs(near + 1 / n) * math.sqrt(n)), 0.0),
        _two_sided(n_vowels - n_letters * share, n_letters * share * (1 - share)),
        _uniform(_counted(kinds[:, :-1] * k + kinds[:, 1:], k * k), np.outer(kind_shares, kind_shares).ravel()),
        _two_sided(turns - n_both * turn, n_both * turn * (1 - turn)),
    ]
    return np.minimum(-np.log(np.clip(np.stack(found, 1), 1e-300, 1.0)), _MOST)


def _band(n: int) -> int:
    return max(b for b in range(len(BANDS)) if BANDS[b] <= n)


#: What the reference's words are made of.
_PARTS = (
    "account action address amount archive array backup balance batch border branch buffer build button cache call center channel check class client code column command common "
    "config content control convert count create current data date default delete detail device display document download element email enable engine entry error event export "
    "factory field file filter format frame function gateway global group handler header height history image import index input instance interface internal item job key label "
    "language layout length level library limit line link list local location log manager map master max member memory menu message method model module monitor name network node "
    "number object option order output package page panel parent path pattern payment point policy position process product profile project property provider query queue range "
    "read record region release remote report request resource response result return role root route rule sample schedule schema search section select server service session "
    "setting shape shared size source stage start state status storage store stream string style submit system table target task template test text thread time title total "
    "trace transfer type update upload user value vector version view width window worker write"
).split()
_HEX_PARTS = "ad add bad bead bed cab cafe dad dead deaf deed face fad fade fed fee feed ace ab be da fa fab dab bee".split()
#: Cases of which a part gets one at random.
_CASES = {"mixed": ["lower", "capitalize", "upper"], "acronyms": ["capitalize"] * 6 + ["upper"]}
#: For each alphabet the kinds of ordinary tokens: case of the words, share of numbers among the parts, sign between parts.
_ORDINARY = {
    "hex": [("lower", 0.5, ""), ("lower", 0.8, "")],
    "HEX": [("upper", 0.5, ""), ("upper", 0.8, "")],
    "base32": [("upper", 0.2, ""), ("upper", 0.5, "")],
    "base36": [("lower", 0.1, ""), ("lower", 0.2, ""), ("lower", 0.5, "")],
    "base62": [("capitalize", 0.0, ""), ("capitalize", 0.2, ""), ("capitalize", 0.5, ""), ("acronyms", 0.0, ""), ("acronyms", 0.2, ""), ("mixed", 0.2, "")],
    "base64": [("capitalize", 0.1, "/"), ("mixed", 0.2, "/"), ("lower", 0.2, "/"), ("mixed", 0.2, "+")],
    "base64url": [("lower", 0.2, "-"), ("mixed", 0.3, "-"), ("lower", 0.2, "_"), ("mixed", 0.3, "_"), ("upper", 0.2, "_")],
}


def ordinary(rng: np.random.Generator, name: str, n: int, kind: tuple[str, float, str], count: int) -> np.ndarray:
    """Places of `count` ordinary tokens of n characters: each begins with a part of one long text of parts."""
    case, numbers, sign = kind
    digits = [c for c in _PLACES[name] if c.isdigit()]
    words = _HEX_PARTS if name in ("hex", "HEX") else _PARTS
    made = "bcdf" if name in ("hex", "HEX") else "bcdfghjklmnprstvwz"
    vowels = "ae" if name in ("hex", "HEX") else "aeiou"
    parts = []
    for _ in range(count + n):
        if rng.random() < numbers:
            year, month, day, low = rng.integers(1990, 2035), rng.integers(1, 13), rng.integers(1, 29), rng.integers(0, 1000)
            part = [f"{year}", f"{year}{month:02}{day:02}", f"{low % 10}", f"{low:04}"][rng.integers(4)]
            part = "".join(c if c in digits else digits[int(c) % len(digits)] for c in part)
        else:
            if rng.random() < 0.5:
                part = words[rng.integers(len(words))]
            else:
                part = "".join(made[int(abs(rng.normal()) * 6) % len(made)] + vowels[rng.integers(len(vowels))] for _ in range(rng.integers(1, 5)))
            part = getattr(part, _CASES[case][rng.integers(len(_CASES[case]))] if case in _CASES else case)()
        parts.append(part + (sign if rng.random() < 0.8 else ""))
    places = np.array([_PLACES[name][c] for c in "".join(parts)])
    first = np.cumsum([0, *map(len, parts)])[:count]
    return places[first[:, None] + np.arange(n)]


@dataclass
class Reference:
    """Weights of the tests, the sum that RANDOM_SHARE of random tokens stay under, and for each kind of ordinary token the lowest sums, in order."""

    weights: np.ndarray
    most: float
    lowest: list[np.ndarray]
    count: int

    def sums(self, found: np.ndarray) -> np.ndarray:
        return np.sqrt(found) @ self.weights

    def p_values(self, found: np.ndarray) -> np.ndarray:
        """P-values of rows of battery(): the larger, the more ordinary tokens look as random."""
        y, out = self.sums(found), np.zeros(len(found))
        for low in self.lowest:
            edge = low[TAIL]
            rate = 1 / max(float((edge - low[:TAIL]).mean()), 1e-9)
            far = (TAIL + 1) / self.count * np.exp(np.minimum(rate * (y - edge), 0.0))
            near = np.searchsorted(low, y, "right") / self.count
            out += np.where(y <= edge, far, np.where(y >= low[-1], 1.0, near)) / len(self.lowest)
        return np.where(y > self.most, 1.0, np.clip(out, LEAST, 1.0))


def battery_in_parts(x: np.ndarray, name: str) -> np.ndarray:
    return np.concatenate([battery(x[at : at + 2_000], name) for at in range(0, len(x), 2_000)])


@lru_cache(maxsize=None)
def reference(name: str, band: int) -> Reference:
    rng, n = np.random.default_rng([band, [a for a, _ in ALPHABETS].index(name)]), BANDS[band]
    random = battery_in_parts(rng.integers(0, len(_PLACES[name]), (4_000, n)), name)
    kinds = [battery_in_parts(ordinary(rng, name, n, kind, REFERENCE), name) for kind in _ORDINARY[name]]
    a, b = np.sqrt(random), np.sqrt(np.concatenate(kinds))
    weights = np.linalg.solve(np.cov(a.T) + np.cov(b.T) + 0.01 * np.eye(a.shape[1]), b.mean(0) - a.mean(0))
    lowest = [np.sort(np.sqrt(found) @ weights)[: max(TAIL + 1, REFERENCE // 10)] for found in kinds]
    return Reference(weights, float(np.quantile(a @ weights, RANDOM_SHARE)), lowest, REFERENCE)


SPANS = "array<struct<start: int, end: int, kind: string>>"
FOUND = f"doc_id string, base {SPANS}, tried array<struct<start: int, end: int, name: string, band: int, tests: array<double>>>"
JUDGED = f"doc_id string, base {SPANS}, tried array<struct<start: int, end: int, band: int, bin: int>>"


def batteries(tokens: list[tuple[str, str]]) -> list[np.ndarray]:
    """battery() of each (token, alphabet); those of one length and alphabet are tested together."""
    groups: dict[tuple[str, int], list[int]] = {}
    for i, (token, name) in enumerate(tokens):
        groups.setdefault((name, len(token)), []).append(i)
    out: list = [None] * len(tokens)
    for (name, _), rows in groups.items():
        places = _PLACES[name]
        for at in range(0, len(rows), 1_000):
            part = rows[at : at + 1_000]
            for i, own in zip(part, battery(np.array([[places[c] for c in tokens[i][0]] for i in part]), name)):
                out[i] = own
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        base, spans, tokens = [], [], []
        for row, text in enumerate(pdf["text"]):
            text = text or ""
            base.append([dict(zip(("start", "end", "kind"), x)) for x in base_spans(text)])
            for x, y, name in candidates(text):
                spans.append((row, x, y))
                tokens.append((text[x:y].rstrip("="), name))
        tried: list[list[dict]] = [[] for _ in base]
        for (row, x, y), (token, name), own in zip(spans, tokens, batteries(tokens)):
            tried[row].append({"start": x, "end": y, "name": name, "band": _band(len(token)), "tests": own})
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": base, "tried": tried})


def _judged(references: dict[tuple[str, int], Reference]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tried in pdf["tried"]:
                own = []
                for t in tried:
                    p = references[t["name"], t["band"]].p_values(np.asarray(t["tests"], float)[None])[0]
                    own.append({"start": t["start"], "end": t["end"], "band": t["band"], "bin": bin_of(p)})
                rows.append(own)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": pdf["base"], "tried": rows})

    return run


def bin_of(p: float) -> int:
    return min(BINS - 1, int(-10 * math.log10(p) + 1e-9))


def _referred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [reference(name, int(band)) for name, band in zip(pdf["name"], pdf["band"])]
        yield pd.DataFrame({"name": pdf["name"], "band": pdf["band"], "weights": [r.weights for r in got], "most": [r.most for r in got], "lowest": [list(r.lowest) for r in got]})


def limits(tried: dict[tuple[int, int], int], rate: float = RATE) -> list[int]:
    """For each length band the smallest bin that counts as random (BINS: none), by Benjamini-Hochberg; a bin's p-value is its largest."""
    out = []
    for band in range(len(BANDS)):
        all_tried = sum(n for (b, _), n in tried.items() if b == band)
        best, found = BINS, 0
        for b in range(BINS - 1, -1, -1):
            found += tried.get((band, b), 0)
            if found and 10 ** (-b / 10) <= rate * found / all_tried:
                best = b
        out.append(best)
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and random, arrays of spans (start, end and kind)."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, so that pandas keeps ids beside nulls
    found = saved(rows.mapInPandas(_scan, FOUND), "spans")
    pairs = found.select(F.explode("tried").alias("t")).select("t.name", "t.band").distinct().repartition("name", "band")  # each alphabet with each band at most
    got = pairs.mapInPandas(_referred, "name string, band int, weights array<double>, most double, lowest array<array<double>>").collect()
    references = {(r["name"], r["band"]): Reference(np.array(r["weights"]), r["most"], [np.array(x) for x in r["lowest"]], REFERENCE) for r in got}
    judged = saved(found.mapInPandas(_judged(references), JUDGED), "judged")
    # len(BANDS) * BINS rows at most
    tried = {(r["band"], r["bin"]): r["n"] for r in judged.select(F.explode("tried").alias("t")).groupBy("t.band", "t.bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = F.array(*[F.lit(b) for b in limits(tried)])
    found_random = F.filter("tried", lambda t: t["bin"] >= F.element_at(least, t["band"] + 1))
    found_random = F.transform(found_random, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return judged.select(F.col("doc_id").cast(kind).alias("doc_id"), "base", found_random.alias("random"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s.alias("s"))
    every = F.transform(F.array_sort(F.transform(F.concat("base", "random"), order)), lambda s: s["s"])
    return found.select("doc_id", *[of(k) for k in KINDS[:3]], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))
