import base64
import glob
import hashlib

import pytest
import zstandard

from tesspan.llm import warc as w

BIG = "é<p>" * 90_000
ROWS = [(1, "http://a/ b\r\nX: y", "same"), (5, "u", "same"), (3, None, "same"), (2, "http://é/%20", None), (7, "x", ""), (4, "x", BIG), (6, "y", BIG), (8, "y", "lone\r\n\r\n"), (9, "y", "twice"), (9, "y", "twice"), (None, "z", "same"), (None, "z", "nobody"), (None, "z", "nobody")]


def brute(rows, least):
    out = []
    for p, _, h in rows:
        payload = (h or "").encode()
        ids = [q for q, _, g in rows if (g or "").encode() == payload and q is not None]
        leader = max(ids) if ids and len(payload) >= least else p
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((p, len(payload), sha1, "response" if p == leader else "revisit", None if p == leader else leader))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    bundles = w.archives(frame(spark, ROWS), least)
    back = w.read_back(bundles)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()]
    assert sorted(got, key=str) == brute(ROWS, least)
    urls = {(r.page_id, r.url) for r in back.collect()}
    assert urls == {(p, u or "") for p, u, _ in ROWS}
    texts = {r.page_id: r.html for r in back.where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert all(t == (dict((p, h) for p, _, h in ROWS)[p] or "") for p, t in texts.items())


def test_seek(spark, tmp_path):
    many = [(i, f"http://h/{i}", f"page {i} " * (i % 50) * 20) for i in range(400)]
    bundles = w.archives(frame(spark, many).repartition(3))
    content = {r.bundle: bytes(r.content) for r in bundles.collect()}
    assert any(len(w.seek_table(c)) > 1 for c in content.values())
    for r in w.located(bundles).collect():
        headers, _ = w.read_record(content[r.bundle], r.frame, r.offset)
        assert headers["WARC-Record-ID"] == r.record_id
    for c in content.values():  # any reader of Zstandard streams can read a bundle from end to end
        whole = zstandard.ZstdDecompressor().stream_reader(c, read_across_frames=True).read()
        assert whole == b"".join(w.frame(c, k) for k in range(len(w.seek_table(c))))
    w.files(bundles, str(tmp_path / "out"))
    assert {open(f, "rb").read() for f in glob.glob(f"{tmp_path}/out/*.warc.zst")} == set(content.values())


def test_empty(spark):
    assert w.read_back(w.archives(frame(spark, []))).count() == 0
