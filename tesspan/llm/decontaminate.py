"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

The texts are lower-cased and cut into words once and stored.  Collection counts of
the benchmark's words say which words of each window are rarest; the index stores the
postings of those words: word -> document, positions.  Lists are intersected after
moving each position by the word's place in its item, so the lists of one occurrence meet at one offset.

Phrase matches: offsets at which enough of the rarest words meet are verified word by word.
Proximity matches: an item is near a document if for some window its RAREST rarest words (by collection
count, then place) occur there with offsets no more than `slop` apart.  Every phrase match is near.

Items of more than SEGMENT windows are cut into overlapping segments, so that each window is in one; equal
segments are looked up once.  Documents are compared by blocks of words.  So a row holds a bounded number of words,
however long an item or a document is and however often they align.

Defined results: null texts have no words; items without a word have no windows;
documents and items are told apart by row, so repeated ids do not mix; items that share
an id count once; a null item_id adds hits but is in no list; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, anti, hinted, saved, sized, table, unused

WINDOW, RAREST, SLOP = 13, 3, 8
SEGMENT, BLOCK = 256, 4096
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """The words of text, A-Z lower-cased, with one space between."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.trim(F.regexp_replace(F.coalesce(low, F.lit("")), _OTHER, " "))


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _count(spaced: Column) -> Column:
    return F.when(spaced == "", F.lit(0)).otherwise(F.char_length(spaced) - F.char_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def stored_words(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, spaced of every row; rid tells rows apart."""
    out = docs.select("doc_id", spaced_words(F.col("text")).alias("spaced"))
    return saved(out.select(F.monotonically_increasing_id().alias("rid"), "doc_id", _count(F.col("spaced")).alias("n_words"), "spaced"), "words")


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct segments (iid, words, length of a window) of all items that have a word, and their owners (iid, item_id)."""
    rows = items.select("item_id", _words(spaced_words(F.col("text"))).alias("words")).where(F.size("words") > 0)
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(SEGMENT)))
    rows = rows.select("item_id", "words", first.alias("at")).select("item_id", F.slice("words", F.col("at") + 1, F.lit(SEGMENT + WINDOW - 1)).alias("words"))
    rows = saved(rows.withColumn("sha", F.sha2(F.array_join("words", " "), 256)), "items")
    own = rows.groupBy("sha").agg(F.first("words").alias("words"))
    own = saved(own.select(F.monotonically_increasing_id().alias("iid"), "sha", "words", F.least(F.lit(WINDOW), F.size("words")).alias("length")), "segments")
    owners = saved(rows.select("item_id", "sha").distinct().join(own.select("iid", "sha"), "sha").select("iid", "item_id"), "owners")
    return own.drop("sha"), owners


def _known(words: DataFrame) -> tuple[DataFrame, bool]:
    """A distinct word list, saved, and whether it is small enough to broadcast."""
    words = saved(words.distinct(), "list")
    rows, size = sized(words)
    small = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    return (F.broadcast(words) if small else words), small


def collection_counts(stored: DataFrame, items: DataFrame) -> DataFrame:
    """word, n: how often each word of the items occurs in all documents (only those that do)."""
    vocabulary, small = _known(items.select(F.explode("words").alias("word")))
    tokens = stored.where("n_words > 0").select(F.explode(F.split("spaced", " ")).alias("word"))
    if small:
        return saved(tokens.join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    return saved(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word"), "counts")


def rarest_sets(items: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """sid, iid, places (an array of place, word): the rarest places of every window that can occur, equal sets of a segment once."""
    places = items.select("iid", "length", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    places = places.join(counts, "word", "left").withColumn("n_docs", F.coalesce(counts["n"], F.lit(0))).drop(counts["n"])
    first = F.greatest(F.lit(0), F.col("place") - F.col("length") + 1)
    last = F.least(F.col("place"), F.col("n") - F.col("length"))
    rows = places.withColumn("start", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("iid", "start")
    rows = rows.withColumn("least", F.min("n_docs").over(w)).where("least > 0")
    rows = rows.withColumn("nth", F.row_number().over(w.orderBy("n_docs", "place"))).where(F.col("nth") <= rarest)
    sets = rows.groupBy("iid", "start").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("places"))
    return saved(sets.select("iid", "places").distinct().select(F.monotonically_increasing_id().alias("sid"), "iid", "places"), "sets")


def rarest_places(sets: DataFrame) -> DataFrame:
    """iid, place, word: the places that are in some set."""
    return saved(sets.select("iid", F.explode("places").alias("p")).select("iid", "p.place", "p.word").distinct(), "places")


def positional_index(stored: DataFrame, words: DataFrame) -> DataFrame:
    """word, rid, positions (ascending): the postings of the given words in every document, written once."""
    listed, _ = _known(words.select("word"))
    tokens = stored.where("n_words > 0").select("rid", F.posexplode(F.split("spaced", " ")).alias("pos", "word"))
    return saved(tokens.join(listed, "word").groupBy("word", "rid").agg(F.sort_array(F.collect_list("pos")).alias("positions")), "postings")


def moved_postings(index: DataFrame, places: DataFrame) -> DataFrame:
    """rid, iid, place, at: postings moved by the word's place, so that an occurrence's lists meet at one at."""
    rows = index.join(hinted(places), "word").select("rid", "iid", "place", F.explode("positions").alias("pos"))
    return rows.select("rid", "iid", "place", (F.col("pos") - F.col("place")).alias("at"))


def meeting(moved: DataFrame, items: DataFrame, slop: int, rarest: int = RAREST) -> DataFrame:
    """The rows of moved that share a band of offsets with as many of a segment's places as a window needs.

    Offsets go to two overlapping bands of twice the slop, so any that lie within it share a band.  Places are told
    apart modulo 64, as those of a window are.
    """
    wide = 2 * max(slop, 1)
    bands = F.array(F.floor(F.col("at") / wide) * 2, F.floor((F.col("at") + slop) / wide) * 2 + 1)
    rows = moved.withColumn("band", F.explode(bands))
    seen = rows.groupBy("rid", "iid", "band").agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("seen"))
    need = hinted(items.select("iid", F.least(F.lit(rarest), "length").alias("need")))
    seen = hinted(saved(seen.join(need, "iid").where(F.bit_count("seen") >= F.col("need")).select("rid", "iid", "band"), "bands"))
    return saved(rows.join(seen, ["rid", "iid", "band"]).select("rid", "iid", "place", "at").distinct(), "meeting")


def alignments(moved: DataFrame, items: DataFrame, rarest: int = RAREST) -> DataFrame:
    """rid, iid, at: offsets at which as many of a segment's rarest words meet as one window needs."""
    need = items.select("iid", F.least(F.lit(rarest), "length").alias("need"))
    met = moved.groupBy("rid", "iid", "at").agg(F.count(F.lit(1)).alias("met"))
    return saved(met.join(hinted(need), "iid").where("met >= need").select("rid", "iid", "at"), "found")


def near(moved: DataFrame, sets: DataFrame, slop: int, rarest: int = RAREST) -> DataFrame:
    """rid, iid where the places of some set have offsets within slop: from each offset, a look at those up to slop further."""
    members = sets.select("sid", "iid", F.size("places").alias("need"), F.posexplode("places").alias("nth", "p")).select("sid", "iid", "need", "nth", F.col("p.place").alias("place"))
    rows = moved.join(hinted(saved(members, "members")), ["iid", "place"])
    w = Window.partitionBy("rid", "sid").orderBy("at").rangeBetween(0, slop)
    there = sum(F.coalesce(F.max(F.when(F.col("nth") == k, 1)).over(w), F.lit(0)) for k in range(rarest))
    return rows.select("rid", "iid", (there >= F.col("need")).alias("near")).where("near").select("rid", "iid").distinct()


def occurrences(stored: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """rid, iid, first, last: the document positions of every exact occurrence of a window (repeated where segments share windows).

    Documents that have an alignment are cut into blocks of words with as many words more as a segment has.
    """
    found = found.withColumn("block", F.floor(F.greatest(F.col("at"), F.lit(0)) / BLOCK).cast("int"))
    texts = stored.select("rid", "spaced").join(hinted(saved(found.select("rid").distinct(), "rids")), "rid").select("rid", F.split("spaced", " ").alias("words"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / BLOCK).cast("int")),
        lambda b: F.struct(b.alias("block"), F.slice("words", b * BLOCK + 1, F.lit(BLOCK + SEGMENT + WINDOW)).alias("words")),
    )
    texts = texts.select("rid", F.explode(blocks).alias("b")).select("rid", "b.block", "b.words")
    asked = items.select("iid", F.col("words").alias("own"), "length")
    rows = texts.join(hinted(saved(found, "found")), ["rid", "block"])
    first = F.greatest(F.col("at"), F.lit(0))
    rows = rows.join(hinted(items.select("iid", F.size("words").alias("size"))), "iid")
    held = F.slice("words", (first - F.col("block") * BLOCK + 1).cast("int"), F.col("size") + F.least(F.col("at"), F.lit(0)).cast("int"))
    rows = rows.select("rid", "iid", "at", held.alias("held")).join(hinted(asked), "iid")
    skip = F.greatest(-F.col("at"), F.lit(0)).cast("int")  # words of the segment before the document's start
    same = F.zip_with("held", F.slice("own", skip + 1, F.size("own")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    rows = rows.select("rid", "iid", "length", first.alias("first"), same.alias("same"))
    last = F.size("same") - F.col("length")
    starts = F.filter(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda s: F.forall(F.slice("same", s + 1, F.col("length")), lambda x: x),
    )
    rows = rows.select("rid", "iid", "length", "first", F.explode(starts).alias("start"))
    return rows.select("rid", "iid", (F.col("first") + F.col("start")).alias("first"), (F.col("first") + F.col("start") + F.col("length") - 1).alias("last"))


def hit_words(found: DataFrame) -> DataFrame:
    """rid, n_hit: the words inside any occurrence, by one pass over a document's occurrences in order."""
    spans = found.groupBy("rid", "first").agg(F.max("last").alias("last"))
    before = F.max("last").over(Window.partitionBy("rid").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(before, F.lit(-1)))
    return spans.select("rid", F.greatest(new, F.lit(0)).alias("new")).groupBy("rid").agg(F.sum("new").cast("long").alias("n_hit"))


def _listed(found: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    """rid and the sorted distinct item ids of its segments, as an array column of that name."""
    rows = saved(found.select("rid", "iid").distinct(), "pairs").join(hinted(owners), "iid")
    return rows.groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias(name))


def _index(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored words, segments, their owners, rarest sets and moved postings."""
    stored, (segments, owners) = stored_words(docs), item_windows(items)
    sets = rarest_sets(segments, collection_counts(stored, segments))
    places = rarest_places(sets)
    return stored, segments, owners, sets, moved_postings(positional_index(stored, places), places)


def contamination(docs: DataFrame, items: DataFrame, slop: int | None = SLOP) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with a slop also n_near and near_items_sha256."""
    stored, segments, owners, sets, moved = _index(docs, items)
    if slop is not None:
        moved = meeting(moved, segments, slop)
    exact = saved(occurrences(stored, segments, alignments(moved, segments)), "exact")
    hits = saved(hit_words(exact).join(_listed(exact, owners, "item_ids"), "rid", "left"), "hits")
    out = stored.select("rid", "doc_id", "n_words").join(hinted(hits), "rid", "left")
    of = lambda name: F.coalesce(name, F.array().cast("array<string>"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), of("item_ids")
    columns = [
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    ]
    if slop is not None:
        out = out.join(hinted(saved(_listed(near(moved, sets, slop), owners, "near_ids"), "near")), "rid", "left")
        columns += [F.size(of("near_ids")).cast("long").alias("n_near"), F.sha2(F.array_join(of("near_ids"), ","), 256).alias("near_items_sha256")]
    return out.select(*columns)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id of every document and item that are near, once for each row of docs."""
    stored, segments, owners, sets, moved = _index(docs, items)
    found = saved(near(meeting(moved, segments, slop), sets, slop), "near")
    found = saved(found.join(hinted(owners), "iid").select("rid", "item_id").distinct(), "near")
    return stored.select("rid", "doc_id").join(hinted(found), "rid").select("doc_id", "item_id")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all columns.  Ids that rows share are judged by each row's text."""
    out = saved(contamination(docs, items, None).select("doc_id", "contaminated"), "contaminated")
    bad = saved(out.groupBy("doc_id").agg(F.max("contaminated").alias("bad"), F.min("contaminated").alias("all_bad")).where("bad"), "bad")
    if bad.where("NOT all_bad OR doc_id IS NULL").isEmpty():
        return anti(docs, bad, "doc_id")
    (key,) = unused(docs, "__key")
    keyed = docs.withColumn(key, F.sha2(F.to_json(F.struct("doc_id", "text")), 256))
    named = saved(keyed.select(F.col(key).alias("doc_id"), "text"), "keyed")
    bad = saved(contamination(named, items, None).where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "bad")
    return anti(keyed, bad, key).drop(key)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), il AS (SELECT row_number() OVER () AS iid, item_id, ws, least(13, len(ws)) AS l FROM i WHERE len(ws) > 0),
iw AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[s:s + l - 1], ' ') AS g
  FROM (SELECT item_id, l, ws, unnest(range(1, len(ws) - l + 2)) AS s FROM il)
), dw AS (
  SELECT doc_id, l, s, array_to_string(ws[s:s + l - 1], ' ') AS g
  FROM (SELECT doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) AS s
        FROM d, (SELECT DISTINCT l FROM iw) WHERE len(ws) >= l)
), m AS (SELECT doc_id, item_id, l, s FROM dw JOIN iw USING (l, g)),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1
), dp AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
c AS (SELECT word, count(*) AS n FROM dp WHERE word IN (SELECT unnest(ws) FROM il) GROUP BY 1),
wp AS (
  SELECT iid, item_id, l, start, start + k AS place, ws[start + k + 1] AS word
  FROM (SELECT iid, item_id, l, ws, start, unnest(range(0, l)) AS k FROM (SELECT *, unnest(range(0, len(ws) - l + 1)) AS start FROM il))
), wr AS (
  SELECT *, row_number() OVER (PARTITION BY iid, start ORDER BY n, place) AS nth, min(n) OVER (PARTITION BY iid, start) AS low
  FROM (SELECT wp.*, coalesce(c.n, 0) AS n FROM wp LEFT JOIN c USING (word))
), wset AS (
  SELECT DISTINCT item_id, list(nth_place ORDER BY nth_place) AS places
  FROM (SELECT iid, item_id, start, {'place': place, 'word': word} AS nth_place FROM wr WHERE low > 0 AND nth <= 3) GROUP BY iid, item_id, start
), wt AS (SELECT row_number() OVER () AS sid, item_id, places, len(places) AS need FROM wset),
wm AS (SELECT sid, item_id, need, unnest(range(1, need + 1)) AS nth, unnest(places) AS p FROM wt),
nr AS (
  SELECT doc_id, item_id, need, count(DISTINCT nth) OVER (PARTITION BY doc_id, sid ORDER BY pos - p.place RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING) AS met
  FROM wm JOIN dp ON p.word = dp.word
), n AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM nr WHERE met = need) GROUP BY 1
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       coalesce(n_near, 0) AS n_near, sha256(coalesce(near, '')) AS near_items_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
