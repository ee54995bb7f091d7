"""WARC records in seekable Zstandard bundles.

Pages become WARC records: a response, or where another page has an equal payload a
revisit of the one with the largest page_id.  Records are grouped into independent
Zstandard frames; a bundle ends with a seek table in a skippable frame, so any frame can
be read alone.  Each bundle comes with an index of record id -> frame and offset in it.
Bundles are rows of a table that Spark commits (a lost task writes nothing); files()
puts them on a shared mount as .warc.zst files.

Defined results: a null html is an empty payload, a null url an empty target; payloads
shorter than the given least size are all responses; rows repeated with the same page_id
and payload are each written as the same record; a null page_id is never the one that
others revisit; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hinted, saved, table

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 128 << 10, 2 << 20, 3
#: Fixed values of the seekable format and of the revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL = "".join(map(chr, range(33, 127))).replace("%", "")

BUNDLES = "bundle string, content binary, records array<struct<record_id: string, frame: int, offset: long, length: long>>"
PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{sha1}>"


def record(page_id: int | None, url: str | None, payload: bytes, leader: int | None, date: str) -> tuple[str, bytes]:
    """The id and the bytes of a record; leader: the page that it revisits."""
    sha1 = digest(payload)
    own = record_id(page_id, sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if leader is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if leader is None else 'revisit'}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=_URL)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        *([] if leader is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(leader, sha1)}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return own, ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and where it ends."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    end = stop + 4 + int(headers["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} isn't closed")
    return headers, data[stop + 4 : end], end + 4


class Bundle:
    """Collects records into frames; close() gives the whole bundle and its index."""

    def __init__(self) -> None:
        self.parts, self.sizes, self.index = [], [], []
        self.open, self.open_size, self.size = [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, own: str, data: bytes) -> None:
        if self.open_size and self.open_size + len(data) > FRAME_BYTES:
            self.flush()
        self.index.append((own, len(self.parts), self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)

    def flush(self) -> None:
        if self.open:
            frame = self.zip.compress(b"".join(self.open))
            self.parts.append(frame)
            self.sizes.append((len(frame), self.open_size))
            self.size += len(frame)
            self.open, self.open_size = [], 0

    def close(self) -> tuple[bytes, list[tuple[str, int, int, int]]]:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        tail = entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(tail)) + tail, self.index


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and plain size of every frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, len(bundle) - 9 - (n - k) * width)
        out.append((at, packed, plain))
        at += packed
    return out


def frame(bundle: bytes, k: int) -> bytes:
    start, packed, plain = seek_table(bundle)[k]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def read_record(bundle: bytes, k: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry; only its frame is decompressed."""
    headers, block, _ = parse(frame(bundle, k), offset)
    return headers, block


def _writer(date: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, nth, bundle = f"{TaskContext.get().partitionId():06d}", 0, Bundle()

        def closed() -> pd.DataFrame:
            content, index = bundle.close()
            return pd.DataFrame({"bundle": [f"{name}-{nth:06d}"], "content": [content], "records": [[dict(zip(("record_id", "frame", "offset", "length"), x)) for x in index]]})

        for pdf in batches:
            for page, url, html, leader in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["leader"]):
                payload = (html or "").encode("utf-8", "surrogatepass")
                bundle.add(*record(None if page is None else int(page), url, payload, None if leader is None else int(leader), date))
                if bundle.size + bundle.open_size // 4 >= BUNDLE_BYTES:
                    yield closed()
                    nth, bundle = nth + 1, Bundle()
        if bundle.index:
            yield closed()

    return write


def archives(pages: DataFrame, least: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write all pages: bundle, content, records (the index) of every bundle.

    Only page ids and digests are shuffled, to find equal payloads; the table of those that occur more than
    once is joined to the pages (broadcast if it is small), and the pages themselves are written where they are read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = rows.where(F.octet_length("html") >= least).select("page_id", F.sha2("html", 256).alias("key"))
    several = saved(keys.groupBy("key").agg(F.max("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1 AND leader IS NOT NULL").drop("n"), "payloads")
    several = hinted(several)
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least, F.sha2("html", 256))).join(several, "key", "left")
    revisit = F.when(F.col("page_id").eqNullSafe(F.col("leader")), None).otherwise(F.col("leader"))
    # as text, so that pandas doesn't turn ids beside nulls into floats
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", revisit.cast("string").alias("leader"))
    return saved(rows.mapInPandas(_writer(date), BUNDLES), "archives")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unzip = zstandard.ZstdDecompressor()
    for pdf in batches:
        for content in pdf["content"]:
            for start, packed, plain in seek_table(content):
                data, at, rows = unzip.decompress(content[start : start + packed], max_output_size=plain), 0, []
                while at < len(data):
                    headers, block, at = parse(data, at)
                    rows.append(_page(headers, block))
                if rows:
                    yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]).astype({"page_id": "Int64", "refers_to": "Int64"})


def _page(headers: dict[str, str], block: bytes) -> tuple:
    of = lambda own: int(own.split(":")[2]) if own.split(":")[2] else None
    kind, sha1 = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x[16:] for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")))
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't whole")
    refers = of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return of(headers["WARC-Record-ID"]), unquote(headers["WARC-Target-URI"]), size, sha1, kind, refers, payload.decode("utf-8", "surrogatepass") if kind == "response" else None


def read_back(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, payloads checked against their digests."""
    return bundles.select("content").mapInPandas(_read, PAGES)


def located(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, offset, length: the index for looking up single records."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.record_id", "bundle", "r.frame", "r.offset", "r.length")


def files(bundles: DataFrame, folder: str) -> None:
    """Each bundle as <bundle>.warc.zst in a folder that all executors mount; a task that runs again replaces whole files."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            part = f"{folder}/.{row.bundle}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(row.content)
            os.replace(part, f"{folder}/{row.bundle}.warc.zst")

    bundles.select("bundle", "content").foreachPartition(put)


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_back(archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
    '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits,
    max(page_id) OVER (PARTITION BY hex) AS leader FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT
         + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM b
"""
