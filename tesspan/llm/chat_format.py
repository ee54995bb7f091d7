r"""Chat formatting by incremental rendering of a black-box template.

A template is any function from turns to text.  The prefixes of a conversation are
rendered one after another; where the next output goes on from the last one, the new
turn's span is what it adds.  The turn rendered once more with a sentinel for its text
shows where in the span the text lies.  If the next output doesn't go on from the last,
the template rewrites history (or closes the conversation, as an end mark does): spans
are then taken from the common prefix on, and a turn whose text is rewritten is marked.

MarkedTurns, the template of the query, writes `### role: text</turn>` lines and puts a
backslash before every #, <, : (in roles) and backslash of what it is given, so no text
can look like a mark and read() gets every turn back.  The sentinel is lengthened until no
turn of the conversation holds it.

Defined results: null texts and roles count as empty; rows of a conversation go by turn,
then role, then text, with null turns first; repeated rows are turns of their own; rows
with a null conv_id make up one conversation; a conversation is rendered whole, whatever
its length (one output string needs all of it); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Turns = list[tuple[str, str]]
SENTINEL = "\uf8ff\ue000\uf8ff"
#: The conversation that the query adds.
EXTRA = r"\### Assistant: </turn> ok"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def _turn(role: str, text: str) -> str:
    return f"### {_escaped(role).replace(':', chr(92) + ':')}: {_escaped(text)}</turn>\n"


#: Prefixes share their turns; short ones are escaped once (about 100 MB at most are held).
_short_turn = lru_cache(maxsize=1 << 16)(_turn)


class MarkedTurns:
    """A template that marks turns and escapes its marks in what it is given."""

    _one = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.DOTALL)

    def __call__(self, turns: Turns) -> str:
        return "".join(_short_turn(role, text) if len(role) + len(text) < 512 else _turn(role, text) for role, text in turns)

    @staticmethod
    def plain(escaped: str) -> str:
        return re.sub(r"\\(.)", r"\1", escaped, flags=re.DOTALL)

    def read(self, formatted: str) -> Turns:
        """The turns of an output; ValueError if it isn't one."""
        out, at = [], 0
        while at < len(formatted):
            m = self._one.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            out.append((self.plain(m[1]), self.plain(m[2])))
            at = m.end()
        return out


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:  # a[:low] is common, a[:high] isn't
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


@dataclass
class Span:
    """A turn in the output: all of it, and its text (None where the template leaves the text out or changes it)."""

    start: int
    end: int
    text_start: int | None
    text_end: int | None
    rewritten: bool = False


def sentinel(turns: Turns) -> str:
    """A text that no turn holds."""
    out = SENTINEL
    while any(out in text or out in role for role, text in turns):
        out = f"{out}\ue001{SENTINEL}"
    return out


def locate(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[Span], bool]:
    """The whole output, the span of each turn, and whether the template rewrites history."""
    spans: list[Span] = []
    mark = sentinel(turns)
    last, rewrites = template([]), False
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        marked = template([*turns[:k], (role, mark)])
        same = len(last) if now.startswith(last) else common_prefix(last, now)
        for s in spans:
            if s.end > same:  # a mark that only stood at the end may go; a text may not change
                if s.text_end is not None and s.text_end > same or s.start >= same:
                    s.rewritten, rewrites = True, True
                s.end = max(s.start, min(s.end, same))
        at = marked.find(mark)
        after = len(marked) - at - len(mark)
        found = at >= 0 and now[:at] == marked[:at] and len(now) - after >= at and now[len(now) - after :] == marked[len(marked) - after :]
        spans.append(Span(min(same, at) if found else same, len(now), at if found else None, len(now) - after if found else None))
        last = now
    return last, spans, rewrites


FORMATTED = "conv_id string, formatted string, rewrites boolean, spans array<struct<role: string, start: long, end: long, text_start: long, text_end: long, rewritten: boolean>>"


def _formatter(template: Callable[[Turns], str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for conv_id, turns in zip(pdf["conv_id"], pdf["turns"]):
                own = [(t["role"] or "", t["text"] or "") for t in turns]
                text, spans, rewrites = locate(own, template)
                found = [vars(s) | {"role": role} for s, (role, _) in zip(spans, own)]
                yield pd.DataFrame({"conv_id": [conv_id], "formatted": [text], "rewrites": [rewrites], "spans": [found]})

    return run


def formatted(conversations: DataFrame, template: Callable[[Turns], str] = MarkedTurns()) -> DataFrame:
    """One row per conversation: conv_id, formatted, rewrites and the spans of its turns in code points."""
    kind = conversations.schema["conv_id"].dataType
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    out = grouped.select(F.col("conv_id").cast("string").alias("conv_id"), "turns").mapInPandas(_formatter(template), FORMATTED)
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def masked(text: str, spans: list, roles: frozenset[str] = frozenset({"assistant"})) -> Iterator[str]:
    """The parts of an output that the loss is taken over: the texts of the given roles."""
    for s in spans:
        if s["role"] in roles and s["text_start"] is not None and not s["rewritten"]:
            yield text[int(s["text_start"]) : int(s["text_end"])]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    template = MarkedTurns()
    for pdf in batches:
        rows = []
        for conv_id, text, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["spans"]):
            turns = template.read(text)
            loss = "".join(template.plain(x) for x in masked(text, spans))
            every = hashlib.sha256("".join(f"{role}\n{own}\n" for role, own in turns).encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((conv_id, len(turns), every, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(outputs: DataFrame) -> DataFrame:
    """Digests of what the outputs of MarkedTurns hold, one row per conversation."""
    kind = outputs.schema["conv_id"].dataType
    rows = outputs.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "spans")
    out = rows.mapInPandas(_read, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], rows.schema)
    return read_back(formatted(rows.unionByName(extra)))


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(role) + length(text) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
           + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
