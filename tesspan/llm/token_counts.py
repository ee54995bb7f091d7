"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole.  The byte lengths of its tokens give every
token's span in the text; the spans are interval-joined with the character spans of
fields or sections.  A token that crosses a boundary is allotted by RULE:

first   to the section of its first byte
most    to the section that holds most of its bytes, the earlier one on a tie
split   to each section by its share of the bytes

Defined results: null text counts as empty and has no token; an empty text has no
sections unless spans are given; bytes outside all spans count as `outside`; spans are
cut to the text and must not overlap; rows are treated one by one, so repeated rows and
null ids come back as they are; other columns are ignored.  Runs of white space of any
length are encoded: the vocabulary's word pattern takes such a run but for its last character as
one word, so a long one is handed to the merge table as a word (see tokens()).

The vocabulary file is read where the tasks run: its path must be there on every executor.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own word pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern's \\s has it, in runs that cost the pattern's look-ahead more than a cut (it would overflow at about a million).
_LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{32,}")
RULES = ("first", "most", "split")


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file of ranks, and the bytes of each token."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def tokens(text: str, path: str = VOCABULARY) -> list[int]:
    """The tokens of a whole text.

    No word of the pattern reaches over the start of a run of white space, and of a run before other
    text the pattern's `\\s+(?!\\S)` takes all but the last character (at the text's end, all).  So cutting
    there gives the tokens that the pattern gives, and the run itself needs no pattern.
    """
    encoding, _ = encoder(path)
    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : stop])
        at = stop
    return out + encoding.encode_ordinary(text[at:]) if at else encoding.encode_ordinary(text)


def token_ends(text: str, path: str = VOCABULARY) -> np.ndarray:
    """The byte offset at which each token of the text ends."""
    return np.cumsum(encoder(path)[1][np.asarray(tokens(text, path), dtype=np.int64)])


def lines(text: str) -> list[tuple[int, int]]:
    """The sections that the query counts: lines, each with its line end."""
    cuts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(text)]])).tolist()
    return list(zip(edges[:-1], edges[1:]))


def attribute(text: str, spans: list[tuple[int, int]], rule: str = "most", path: str = VOCABULARY) -> tuple[np.ndarray, float, int, int]:
    """Tokens of each span, tokens outside all, tokens that cross a boundary, all tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = token_ends(text, path)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte at which each character starts
    own = np.array([(at[min(max(a, 0), len(at) - 1)], at[min(max(b, 0), len(at) - 1)]) for a, b in spans], dtype=np.int64).reshape(-1, 2)
    order = np.argsort(own[:, 0], kind="stable")
    own = own[order]
    filled = own[:, 1] > own[:, 0]
    live = own[filled]
    if (live[1:, 0] < live[:-1, 1]).any():
        raise ValueError("sections overlap")
    # pieces: the live sections and the gaps between them; piece of a byte = searchsorted over the edges
    edges = np.unique(np.concatenate([[0], live.ravel(), [len(raw)]])).astype(np.int64)
    piece = np.full(max(1, len(edges)), -1, np.int64)
    piece[np.searchsorted(edges, live[:, 0])] = np.flatnonzero(filled)
    first = np.searchsorted(edges, starts, "right") - 1
    last = np.searchsorted(edges, ends - 1, "right") - 1
    got = np.zeros(len(piece))
    whole = first == last
    np.add.at(got, first[whole], 1)
    if rule == "first":
        np.add.at(got, first[~whole], 1)
    elif not whole.all():
        # a cell for each crossing token and piece that it lies in
        crossing = np.flatnonzero(~whole)
        width = last[crossing] - first[crossing] + 1
        head = np.cumsum(width) - width
        over = np.repeat(first[crossing] - head, width) + np.arange(width.sum())
        token = np.repeat(crossing, width)
        held = np.minimum(edges[over + 1], ends[token]) - np.maximum(edges[over], starts[token])
        if rule == "most":
            ties = np.flatnonzero(held == np.repeat(np.maximum.reduceat(held, head), width))
            np.add.at(got, over[ties[np.unique(token[ties], return_index=True)[1]]], 1)
        else:
            np.add.at(got, over, held / np.repeat(np.add.reduceat(held, head), width))
    out = np.zeros(len(own))
    np.add.at(out, piece[piece >= 0], got[piece >= 0])
    back = np.zeros(len(own))
    back[order] = out
    return back, float(got[piece < 0].sum()), int((~whole).sum()), len(ends)


COUNTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_sections", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
        T.StructField("outside", T.DoubleType()),
        T.StructField("section_tokens", T.ArrayType(T.DoubleType())),
    ]
)


def section_counts(docs: DataFrame, spans: str | None = None, rule: str = "most", path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_sections, n_crossing, outside, section_tokens.

    spans: a column of array<struct<start, end>> in characters; the lines of the text if None.
    """

    def counts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *given in batches:
            rows = []
            for i, text in enumerate(texts):
                text = text or ""
                own = lines(text) if not given else [(s["start"], s["end"]) for s in ([] if given[0].iloc[i] is None else given[0].iloc[i]) if s is not None]
                per, outside, crossing, n = attribute(text, own, rule, path)
                rows.append((n, len(own), crossing, outside, per.tolist()))
            yield pd.DataFrame(rows, columns=COUNTS.fieldNames())

    of = F.pandas_udf(_typed(counts, bool(spans)), COUNTS)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.col(spans).alias("spans")] if spans else []))
    return text.select("doc_id", of("text", *(["spans"] if spans else [])).alias("c")).select("doc_id", "c.*")


def _typed(counts, with_spans: bool):
    """The same function with the type hints by which Spark tells kinds of pandas_udf apart."""
    if with_spans:

        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            return counts(batches)
    else:

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            return counts((b,) for b in batches)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]] if with_spans else Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def with_token_count(docs: DataFrame, name: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """docs with the number of tokens of each whole text."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([len(tokens(t, path)) for t in batch], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(count, T.LongType())(F.coalesce("text", F.lit(""))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(table(spark, sf_dir, "documents"))
