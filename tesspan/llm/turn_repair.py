r"""Repair of conversation structure by layers of cost over bitsets of grammar states.

A well-formed conversation is empty, or an optional system turn and then one or more pairs of user and assistant:
`(s?(ua)+)?` over the roles' initials.  Its states are START, after system, after user, after
assistant; START and after assistant accept.  Edits cost: keep 0, rerole to user or assistant 1,
delete 2 (required for blank and duplicate turns), insert an empty user or assistant turn 5; a truncated turn that
isn't deleted costs 5 more.

Layer k holds for every place between turns the set of states, as four bits, from which the rest
of the conversation can be made well-formed at a cost of exactly k.  A layer comes from those 1, 2, 5 and 6 below it
by a table look-up for each turn, as approximate bit-parallel matching does it.  The first layer that holds START at the first
place gives the cost; walking forward through the layers and taking the first possible edit in
ASCII order (D, I, K, R) gives the least of the cheapest audits.  Long conversations are cut into segments of SEGMENT turns from
the end: what a segment passes on is the cost from each of its four states, so layers stay
shallow and time and memory grow with the turns alone.

Two passes: one over digests, roles and flags finds the audits (a byte a turn is held), one brings each conversation's texts
behind its audit in order, so texts are streamed and never held together.  Both deal rows by
conversation, as an audit, and the hash of a whole conversation, is one value of one conversation.

Defined results: null role or text is one space; rows go by turn with nulls first, then role, then the
text's SHA-256; rows with a null conv_id make up one conversation; a row repeated is a turn of its own, and the
later one is a duplicate; a role that is empty or starts with another letter can't be kept; rows that
are not present (see audits) only keep their conversation in the result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SEGMENT = 64
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ACCEPTING = 1 << _START | 1 << _ASSISTANT
_NEXT = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: Where a turn given the role it needs leads from each state.
_GIVEN = [_USER, _USER, _ASSISTANT, _USER]
_CLASSES = "sua?"
#: A turn's byte: its class, and whether it has to go, or is truncated.
_MUST_GO, _CUT = 4, 8
WHITE = " \t\n\x0b\x0c\r"


def _before(step: dict[int, int] | list[int]) -> list[int]:
    """For each set of states those from which a step leads into it."""
    pairs = list(step.items() if isinstance(step, dict) else enumerate(step))
    return [sum(1 << a for a, b in pairs if states >> b & 1) for states in range(16)]


_BEFORE_KEEP = [_before(_NEXT.get(c, {})) for c in _CLASSES]
_BEFORE_GIVEN = _before(_GIVEN)


class Layers:
    """The layers of one segment; base[k] are the states that may follow it at a cost of exactly k."""

    def __init__(self, codes: bytes, base: list[int], last: bool):
        self.codes, self.base, self.last = codes, base, last
        self.rows: list[list[int]] = []

    def grow(self) -> int:
        """Add the next layer; the states at the first place that it holds."""
        k, n, codes, rows = len(self.rows), len(self.codes), self.codes, self.rows
        none = [0] * (n + 1)
        one, two, five, six = [rows[k - d] if k >= d else none for d in (1, 2, 5, 6)]
        now = self.base[k] if k < len(self.base) else 0
        if self.last:
            now |= _BEFORE_GIVEN[five[n]]
        own = [now]
        for i in range(n - 1, -1, -1):
            code = codes[i]
            after = i + 1
            states = two[after] | _BEFORE_GIVEN[five[i]]
            if not code & _MUST_GO:
                if code & _CUT:
                    states |= _BEFORE_KEEP[code & 3][five[after]] | _BEFORE_GIVEN[six[after]]
                else:
                    states |= _BEFORE_KEEP[code & 3][now] | _BEFORE_GIVEN[one[after]]
            now = states
            own.append(now)
        own.reverse()
        rows.append(own)
        return now

    def costs(self, wanted: int) -> dict[int, int]:
        """The least cost from each of the states in wanted."""
        out: dict[int, int] = {}
        while wanted:
            new = self.grow() & wanted
            for s in range(4):
                if new >> s & 1:
                    out[s] = len(self.rows) - 1
            wanted &= ~new
        return out

    def _holds(self, k: int, i: int, state: int) -> bool:
        return k >= 0 and self.rows[k][i] >> state & 1 == 1

    def walk(self, state: int, k: int) -> tuple[str, int]:
        """The least audit from a state at a cost of k in all, and the state that it ends in."""
        out, i, n = [], 0, len(self.codes)
        while not (i == n and k < len(self.base) and self.base[k] >> state & 1):
            code = self.codes[i] if i < n else _MUST_GO
            extra = TRUNCATED if code & _CUT else 0
            kept = _NEXT.get(_CLASSES[code & 3], {}).get(state)
            given = _GIVEN[state]
            if i < n and self._holds(k - DELETE, i + 1, state):
                out.append("D")
                i, k = i + 1, k - DELETE
            elif (i < n or self.last) and self._holds(k - INSERT, i, given):
                out.append("I")
                state, k = given, k - INSERT
            elif not code & _MUST_GO and kept is not None and self._holds(k - KEEP - extra, i + 1, kept):
                out.append("K")
                state, i, k = kept, i + 1, k - KEEP - extra
            else:
                out.append("R")
                state, i, k = given, i + 1, k - REROLE - extra
        return "".join(out), state


def _bases(costs: dict[int, int]) -> list[int]:
    least = min(costs.values())
    out = [0] * (max(costs.values()) - least + 1)
    for s, cost in costs.items():
        out[cost - least] |= 1 << s
    return out


def cheapest(codes: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and least audit of the turns with these bytes."""
    starts = list(range(0, len(codes), segment)) or [0]
    base, behind, total = [_ACCEPTING], [], 0
    for at in reversed(starts):  # the segments' bases are kept, their layers are not
        behind.append(base)
        layers = Layers(codes[at : at + segment], base, at == starts[-1])
        costs = layers.costs(15 if at else 1)
        total += min(costs.values())
        base = _bases(costs)
    audit, state = [], _START
    for at in starts:
        base = behind.pop()
        if at:
            layers = Layers(codes[at : at + segment], base, at == starts[-1])
            own = layers.costs(1 << state)[state]
        else:
            own = len(layers.rows) - 1
        part, state = layers.walk(state, own)
        audit.append(part)
    return total, "".join(audit)


AUDIT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = frozenset({"su", "ua", "au"})


class _Conversation:
    """What is held of a conversation while its turns are read: a byte for each, and counts."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.counts = dict.fromkeys(_NUMBERS, 0)
        self.initial: str | None = None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        place = _CLASSES.find(initial) if initial in ("s", "u", "a") else 3
        self.codes.append(place | (_MUST_GO if blank or duplicate else _CUT if truncated else 0))
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.high  # turns come in order
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, conv_id: str | None) -> tuple:
        if self.turns:
            self.counts["gaps"] = self.high - self.low + 1 - self.turns
        self.counts["cost"], audit = cheapest(bytes(self.codes))
        return (conv_id, *self.counts.values(), audit)


def _audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in AUDIT.split(", ")]
    held, last = None, None
    for pdf in batches:
        out = []
        for conv_id, turn, timed, initial, blank, again, cut, present in zip(*[pdf[c] for c in ("conv_id", "turn", "timed", "initial", "blank", "again", "cut", "present")]):
            if held is None or conv_id != last:
                if held is not None:
                    out.append(held.row(last))
                held, last = _Conversation(), conv_id
            if present:
                held.add(int(turn) if timed else None, initial, blank, again, cut)
        if out:
            yield pd.DataFrame(out, columns=names)
    if held is not None:
        yield pd.DataFrame([held.row(last)], columns=names)


def _ordered(rows: DataFrame, *more: Column | str) -> DataFrame:
    by_turn = F.col("turn").asc_nulls_first()
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *more, by_turn, "role", "digest")


def _prepared(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    present = F.coalesce("present", F.lit(False)) if "present" in conversations.columns else F.lit(True)
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), present.alias("present"),
    )


def audits(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id (as text), gaps, blank, duplicate, truncated, illegal, cost, audit.

    conversations: conv_id, turn, role, text; where it has a boolean column present, rows without it only
    name their conversation.
    """
    rows = _prepared(conversations)
    bare = F.rtrim("text", F.lit(WHITE))
    narrow = rows.select(
        "conv_id", "turn", F.when(F.col("present"), F.col("role")).alias("role"), F.when(F.col("present"), F.col("digest")).alias("digest"), "present",
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    narrow = narrow.repartition("conv_id").withColumn("again", again)
    by_turn = F.col("turn").asc_nulls_first()
    narrow = narrow.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), by_turn, "role", "digest", "again").select(
        "conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("timed"),
        F.coalesce(F.substring("role", 1, 1), F.lit("")).alias("initial"), "blank", "again", "cut", "present",
    )
    return narrow.mapInPandas(_audited, AUDIT)


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, list[int] | None, str, str, str, str]]:
    """conv_id, numbers, audit, edit, role, text of every edit but deletions, and one row with an empty edit ahead of each conversation."""
    conv_id, audit, at, state, last = None, "", 0, _START, 0

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _GIVEN[state]
            at += 1
            yield conv_id, None, "", "I", "user" if state == _USER else "assistant", ""

    for pdf in batches:
        for own, ahead, numbers, role, text in zip(*[pdf[c] for c in ("conv_id", "ahead", "numbers", "role", "text")]):
            if ahead:
                conv_id, audit, at, state, last = own, text, 0, _START, len(text.rstrip("I"))
                yield conv_id, [int(x) for x in numbers], audit, "", "", ""
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "K":
                state = _NEXT[role[0]][state]
                yield conv_id, None, "", "K", role, text
            elif edit == "R":
                state = _GIVEN[state]
                yield conv_id, None, "", "R", "user" if state == _USER else "assistant", text
            if at == last:  # nothing but insertions is left
                yield from inserted()
        yield None, None, "", "batch", "", ""


def _behind_audits(conversations: DataFrame, found: DataFrame) -> DataFrame:
    rows = _prepared(conversations).where("present")
    rows = rows.select("conv_id", F.lit(False).alias("ahead"), F.lit(None).cast("array<bigint>").alias("numbers"), "turn", "role", "digest", "text")
    heads = found.select(
        "conv_id", F.lit(True).alias("ahead"), F.array(*[F.col(c) for c in _NUMBERS]).alias("numbers"), F.lit(None).cast("bigint").alias("turn"),
        F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
    )
    return _ordered(heads.unionByName(rows), F.col("ahead").desc()).select("conv_id", "ahead", "numbers", "role", "text")


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out, place = [], 0
    for conv_id, numbers, _, edit, role, text in _edited(batches):
        if edit == "batch":
            yield pd.DataFrame(out, columns=["conv_id", "place", "edit", "role", "text"])
            out = []
        elif not edit:
            place = 0
        else:
            out.append((conv_id, place, edit, role, text))
            place += 1


def repaired(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place, edit (K, R or I), role, text.  found: what audits() gave."""
    kind = conversations.schema["conv_id"].dataType
    rows = _behind_audits(conversations, audits(conversations) if found is None else found)
    out = rows.mapInPandas(_turns, "conv_id string, place long, edit string, role string, text string")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", *_NUMBERS, "audit", "repaired_sha256"]
    out, head, sha, first = [], None, None, True
    for conv_id, numbers, audit, edit, role, text in _edited(batches):
        if edit == "batch":
            if out:
                yield pd.DataFrame(out, columns=names)
            out = []
        elif not edit:
            if head is not None:
                out.append((*head, sha.hexdigest()))
            head, sha, first = (conv_id, *numbers, audit), hashlib.sha256(), True
        else:
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
    if head is not None:
        yield pd.DataFrame([(*head, sha.hexdigest())], columns=names)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its counts of faults, cost, audit and repaired_sha256."""
    kind = conversations.schema["conv_id"].dataType
    rows = _behind_audits(conversations, audits(conversations))
    out = rows.mapInPandas(_digests, AUDIT + ", repaired_sha256 string")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by crc32 of `conv_id:turn`, dropped ones marked as not present."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")), F.lit(20)).alias("kind")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind)
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: CRC-32 of ASCII text in SQL: a table of 256 steps, and one step for each character.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) t(i)))"""


def crc_sql(text: str) -> str:
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda x, b: xor(x >> 8, steps[(xor(x, b) & 255) + 1])), 4294967295)"


def _oracle() -> str:
    add = lambda x, cost, edit, role: (
        f"CASE WHEN {x} IS NULL THEN NULL ELSE {{'k': printf('%09d', substr({x}.k, 1, 9)::INT + {cost}) || substr({x}.k, 10) || '{edit}', 't': {x}.t || {role}}} END"
    )
    insert = lambda x, role: add(x, 5, "I", f"chr(10) || '{role}:'")
    extra = "CASE WHEN cut THEN 5 ELSE 0 END"
    keep = lambda x, c: f"CASE WHEN NOT must_go AND initial = '{c}' THEN {add(x, extra, 'K', 'chr(10) || role || chr(58) || text')} END"
    rerole = lambda x, role: f"CASE WHEN NOT must_go THEN {add(x, f'1 + {extra}', 'R', f'''chr(10) || '{role}:' || text''')} END"
    delete = lambda x: add(x, 2, "D", "''")
    least = lambda *xs: f"list_min(list_filter([{', '.join(xs)}], lambda q: q IS NOT NULL))"
    y2 = least("x2", insert("x0", "user"), insert("x1", "user"), insert("x3", "user"))
    steps = {
        0: delete("x0"),
        1: least(delete("x1"), keep("x0", "s")),
        2: least(delete("y2"), *[f(x, c) for x in ("x0", "x1", "y3") for f, c in ((keep, "u"), (rerole, "user"))]),
        3: least(delete("y3"), keep("y2", "a"), rerole("y2", "assistant")),
    }
    return rf"""
WITH RECURSIVE {CRC_TABLE},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations, crc_table
),
harm AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare
  FROM harm
),
faults AS (
  SELECT *, left(role, 1) AS initial, bare = '' AS blank,
         bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM ranked
),
turns AS (SELECT *, blank OR again AS must_go, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM faults),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id
),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'k': '000000000', 't': ''}} AS x0, NULL::STRUCT(k VARCHAR, t VARCHAR) AS x1,
         NULL::STRUCT(k VARCHAR, t VARCHAR) AS x2, NULL::STRUCT(k VARCHAR, t VARCHAR) AS x3 FROM stats
  UNION ALL
  SELECT conv_id, i, {steps[0]}, {steps[1]}, {steps[2]}, {steps[3]}
  FROM (SELECT *, {least("x3", insert("y2", "assistant"))} AS y3
        FROM (SELECT w.x0, w.x1, w.x2, w.x3, t.conv_id, t.i, t.must_go, t.cut, t.initial, t.role, t.text, {y2} AS y2
              FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1))
),
ends AS (
  SELECT conv_id, {least("x0", "x3", insert("y2", "assistant"))} AS best
  FROM (SELECT w.*, {y2} AS y2 FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i)
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(best.k, 1, 9)::BIGINT, 0) AS cost,
       coalesce(substr(best.k, 10), '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP12_SQL = _oracle()
