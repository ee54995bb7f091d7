r"""A trie of conversation prefixes: what conversations share from their first turns on.

A conversation becomes its path: for every turn a record of RECORD bytes (SHA-256 of role and text, and the number of
code points of the text).  Texts themselves are never shuffled.  Equal paths are one row with a count, the smallest
id and the digest of all ids, so copies of a conversation weigh nothing further on.

Paths are dealt by the digest of their first turn.  Subtries of at most GROUP_TURNS turns are hashed into
buckets, and each bucket builds its subtries as dictionaries of pointers inside applyInPandas, with sums
taken from the children up (a node comes before its children, so walking the nodes backwards is a
postorder without recursion).  A larger subtrie is dealt again by the next turn: its top, down to the last turn that all
its paths share, becomes a chain of nodes of its own, and what lies below is dealt by the turn after that, again
and again until every part is small.  A single path can't be dealt further: it is held by one task.  Sums of parts go back
up through the chains, one aggregation a round.

The ids that end at a node are hashed in order.  They are sorted by range first, so a node at which a third of all conversations
end is spread over tasks; only its joined pieces pass through one task, as SHA-256 reads in order.

Defined results: null role or text is empty; rows go by turn with nulls first, then by the digest of role and text; rows
with a null conv_id are no conversation and are left out; a repeated row is a turn of its own; an empty table has
no node; empty texts are turns like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, saved, table
from .turn_repair import CRC_TABLE, crc_sql

RECORD = 36
#: Turns (over distinct paths) from which a subtrie is dealt by its next turn.
GROUP_TURNS = 50_000
#: Characters of joined ids in one row.
PIECE = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = [x.split()[0] for x in NODE.split(", ")]


def _record() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(digest, F.lpad(F.hex(F.char_length(text).cast("long")), 8, "0"))


def paths(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id and path of every conversation, with the key (one value in a conversation) by which rows are dealt."""
    names = list(dict.fromkeys([key, "conv_id"]))
    rows = conversations.where("conv_id IS NOT NULL").select(*names, "turn", _record().alias("record")).repartition(key)
    grouped = rows.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("turn", "record"))).alias("turns"))
    return grouped.select(*names, F.unhex(F.array_join(F.transform("turns", lambda t: t["record"]), "")).alias("path"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path: the first crc32(id) % 6 turns of the conversation that opens the id's hundred, then the own turns after as many."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("base", F.expr("conv_id - conv_id % 100"))
    heads = paths(rows.where("conv_id = base"), "base").select("base", F.expr(f"substring(path, 1, {5 * RECORD})").alias("head"))
    own = paths(rows, "base").withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int"))
    head = F.expr(f"substring(coalesce(head, X''), 1, {RECORD} * h)")
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, F.expr(f"substring(path, {RECORD} * h + 1)")).alias("path"))


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of the ids of one path in order, joined by commas."""
    key, path, first, n, ids, size = None, b"", 0, 0, [], 0
    for pdf in batches:
        out = []
        for own, conv_id, own_path in zip(pdf["key"], pdf["conv_id"], pdf["path"]):
            if own != key or size > PIECE:
                if n:
                    out.append((key, path, first, n, ",".join(ids)))
                key, path, first, n, ids, size = own, own_path, conv_id, 0, [], 0
            ids.append(str(conv_id))
            size += len(ids[-1]) + 1
            n += 1
        yield pd.DataFrame(out, columns=["key", "path", "first", "n", "ids"])
    if n:
        yield pd.DataFrame([(key, path, first, n, ",".join(ids))], columns=["key", "path", "first", "n", "ids"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "w", "m", "ends"]
    key, path, w, m, sha = None, b"", 0, 0, None
    for pdf in batches:
        out = []
        for own, own_path, first, n, ids in zip(*[pdf[c] for c in ("key", "path", "first", "n", "ids")]):
            if own != key:
                if sha is not None:
                    out.append((path, w, m, sha.hexdigest()))
                key, path, w, m, sha = own, own_path, 0, first, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
            w += n
        yield pd.DataFrame(out, columns=names)
    if sha is not None:
        yield pd.DataFrame([(path, w, m, sha.hexdigest())], columns=names)


def distinct_paths(rows: DataFrame) -> DataFrame:
    """path, w (conversations), m (the smallest id), ends (digest of all ids in order) of rows (conv_id, path)."""
    rows = saved(rows.select(F.sha2("path", 256).alias("key"), "conv_id", "path"), "rebuilt")
    pieces = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(_pieces, "key string, path binary, first long, n long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInPandas(_hashed, "path binary, w long, m long, ends string")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The subtries of a bucket: a dictionary leads from (parent, turn) to the child."""
    child: dict[tuple, int] = {}
    parent, depth, convs, least, points, ends, up = [], [], [], [], [], [], []
    for group, path, w, m, done, at, above, above_id in zip(*[pdf[c] for c in ("g", "path", "w", "m", "ends", "at", "up", "pm")]):
        node: object = group
        for d in range(at, len(path) // RECORD):
            key = (node, path[RECORD * d : RECORD * (d + 1)])
            found = child.get(key)
            if found is None:
                found = child[key] = len(parent)
                parent.append(node if d > at else -1)
                up.append((above, above_id) if d == at else None)
                depth.append(d + 1)
                convs.append(0)
                least.append(m)
                points.append(int.from_bytes(key[1][32:], "big"))
                ends.append(NOTHING)
            node = found
            convs[node] += w
            least[node] = min(least[node], m)
        ends[node] = done
    n = len(parent)
    kids, leaves, saved_tokens = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        saved_tokens[i] += (convs[i] - 1) * points[i]
        leaves[i] = leaves[i] or 1
        if up[i] is None:
            p = parent[i]
            kids[p] += 1
            leaves[p] += leaves[i]
            saved_tokens[p] += saved_tokens[i]
    above = [least[p] if u is None else u[1] for p, u in zip(parent, up)]
    return pd.DataFrame(dict(zip([*_NODE, "up"], [least, depth, above, convs, kids, leaves, saved_tokens, ends, [u and u[0] for u in up]])))


def _shared_turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hi: how many turns the first and the last path of a group share, and so all of them."""
    for pdf in batches:
        hi = []
        for low, high in zip(pdf["low"], pdf["high"]):
            k, most = 0, min(len(low), len(high)) // RECORD
            while k < most and low[RECORD * k : RECORD * (k + 1)] == high[RECORD * k : RECORD * (k + 1)]:
                k += 1
            hi.append(k)
        yield pdf.assign(hi=hi).drop(columns="high")


CHAIN = "g string, up string, pm string, at int, low binary, w long, m long, hi int"


def _chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for up, pm, at, low, w, m, hi, done, kids, leaves, below in zip(*[pdf[c] for c in ("up", "pm", "at", "low", "w", "m", "hi", "ends", "kids", "leaves", "below")]):
            total = int(below)
            for d in range(hi, at, -1):
                total += (w - 1) * (int.from_bytes(low[RECORD * d - 4 : RECORD * d], "big") if d else 0)
                top, last = d == at + 1, d == hi
                rows.append((m, d, (None if pm is None else int(pm)) if top else m, w, int(kids) if last else 1, max(1, int(leaves)), total, done if last else NOTHING, up if top else None))
        yield pd.DataFrame(rows, columns=[*_NODE, "up"]).astype({"parent_conv_id": "object"})


def trie(rows: DataFrame, group_turns: int = GROUP_TURNS) -> DataFrame:
    """The nodes of the trie over rows (conv_id long, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    known = saved(distinct_paths(rows), "paths")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turnless = F.length("path") == 0
    n, least, done = known.agg(F.sum("w"), F.min("m"), F.max(F.when(turnless, F.col("ends")))).first()
    if n is None:
        return spark.createDataFrame([], NODE)
    root = spark.range(1).select(F.lit("").alias("g"), *[F.lit(None).cast("string").alias(c) for c in ("up", "pm")], F.lit(-1).alias("at"), F.lit(b"").alias("low"))
    stubs = [root.withColumns({"w": F.lit(n), "m": F.lit(least), "hi": F.lit(0), "ends": F.lit(done).cast("string")})]
    built = []
    todo = known.where(~turnless).select("path", "w", "m", "ends", F.lit(0).alias("at"), F.lit("").alias("up"), F.lit(least).alias("pm"))
    while True:
        group = F.sha2(F.concat("up", F.hex(F.expr(f"substring(path, {RECORD} * at + 1, 32)"))), 256)
        todo = saved(todo.withColumn("g", group), "dealt")
        turns = F.expr(f"length(path) DIV {RECORD} - at")
        big = saved(todo.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(turns).alias("turns")).where(f"turns > {group_turns} AND n > 1").select("g"), "big")
        some = not big.isEmpty()
        sides = hinted(big) if some else None
        small = todo.join(sides, "g", "left_anti") if some else todo
        total = small.agg(F.sum(turns)).first()[0] or 0
        buckets = max(parts, math.ceil(4 * total / group_turns))
        small = small.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        built.append(saved(small.groupBy("bucket").applyInPandas(_build, NODE + ", up string"), "built"))
        if not some:
            break
        large = todo.join(sides, "g")
        stats = large.groupBy("g", "up", F.col("pm").cast("string").alias("pm"), "at").agg(
            F.min("path").alias("low"), F.sum("w").alias("w"), F.min("m").alias("m"), F.max("path").alias("high")
        )
        stats = saved(stats.mapInPandas(_shared_turns, CHAIN), "chains")
        tops = hinted(saved(stats.select("g", "hi", F.col("m").alias("least")), "tops"))
        large = saved(large.join(tops, "g"), "large")
        over = f"length(path) > {RECORD} * hi"
        ends = large.where(f"NOT ({over})").select("g", "ends")
        stubs.append(saved(stats.join(ends, "g", "left"), "stubs"))
        todo = large.where(over).select("path", "w", "m", "ends", F.col("hi").alias("at"), F.col("g").alias("up"), F.col("least").alias("pm"))
    chains = []
    while stubs:  # from the deepest round up; what was built in a round hangs from that round's stubs
        tops = [x.where("up IS NOT NULL").select("up", "n_leaves", "saved_tokens") for x in (built[len(stubs) - 1], *chains[-1:])]
        below = tops[0] if len(tops) == 1 else tops[0].unionByName(tops[1])
        below = below.groupBy(F.col("up").alias("g")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        own = stubs.pop().join(below, "g", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("kids", "leaves", "below")})
        own = own.withColumn("ends", F.coalesce("ends", F.lit(NOTHING)))
        chains.append(saved(own.mapInPandas(_chains, NODE + ", up string"), "chain"))
    out = built + chains
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0].select(*_NODE)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP13_SQL = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id
),
hashed AS (SELECT conv_id, turns, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM own, crc_table),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS seq
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
),
prefixes AS (SELECT conv_id, seq[1:d] AS prefix, d, d = len(seq) AS done FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM built)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(prefix[d].t), 0) AS tokens,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (done), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, d
),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT prefix[1:d] AS prefix, sum(tokens)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
  FROM (SELECT n.prefix, tokens, k.prefix IS NULL AS leaf, unnest(range(depth + 1)) AS d FROM nodes n LEFT JOIN kids k ON k.prefix = n.prefix)
  GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.prefix = n.prefix LEFT JOIN kids k ON k.prefix = n.prefix
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""
