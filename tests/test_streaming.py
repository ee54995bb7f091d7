"""Growing files, tables of batches and live intervals, against plain counterparts."""

import random

import pytest
from pyspark.sql import functions as F

from tesspan.queries.source_queries import _append_logs
from tesspan.streaming import lines, liveness
from tesspan.streaming.sink import BatchTable
from tesspan.streaming.tail import follow


def texts_of(reader, start, end):
    return [(p, at, line) for part in reader.partitions(start, end) for b in reader.read(part) for p, at, line in zip(*b.to_pydict().values())]


def expected(path, data, start=0):
    out, at = [], start
    for line in data[: data.rfind(b"\n") + 1][start:].split(b"\n")[:-1]:
        if line.strip():
            out.append((path, at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("options", [{}, {"maxBytesPerTrigger": "40"}, {"splitBytes": "7"}, {"maxBytesPerTrigger": "25", "splitBytes": "10"}])
@pytest.mark.parametrize("block", [5, 1 << 20])
def test_offsets_give_every_whole_line_once(tmp_path, options, block, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(3)
    reader = lines.LineReader({"path": str(tmp_path), "glob": "*.log", **options})
    at, got, data = reader.initialOffset(), [], {}
    (tmp_path / "other.txt").write_bytes(b"no\n")
    for _ in range(25):
        name = rng.choice(["a.log", "b.log"])
        piece = "".join(rng.choice(["x", "é", "\n", "\r\n", " ", "long line here ", "\n\n"]) for _ in range(rng.randint(0, 12))).encode()
        data[name] = data.get(name, b"") + (piece + b"\xff\n" if rng.random() < 0.1 else piece)
        (tmp_path / name).write_bytes(data[name])
        new = reader.latestOffset()
        got += texts_of(reader, at, new)
        at = new
    while (new := reader.latestOffset()) != at:
        got += texts_of(reader, at, new)
        at = new
    want = [x for name, raw in data.items() for x in expected(str(tmp_path / name), raw)]
    assert sorted(got) == sorted(want)
    again = lines.LineReader({"path": str(tmp_path), "glob": "*.log", **options})  # a restart asks for what was committed
    assert texts_of(again, at, at) == [] and again.latestOffset() == at


def test_backlog_is_skipped_on_demand(tmp_path):
    data = b"".join(b"line %03d\n" % i for i in range(100))
    (tmp_path / "a").write_bytes(data + b"half")
    reader = lines.LineReader({"path": str(tmp_path), "skipBacklogBytes": "50"})
    got = texts_of(reader, reader.initialOffset(), reader.latestOffset())
    assert [g[2] for g in got] == [f"line {i:03}" for i in range(95, 100)]


def test_missing_folder_and_shorter_file(tmp_path):
    reader = lines.LineReader({"path": str(tmp_path / "later")})
    assert reader.initialOffset() == {} == reader.latestOffset()
    (tmp_path / "later").mkdir()
    (tmp_path / "later" / "a").write_bytes(b"one\ntwo\n")
    at = reader.latestOffset()
    assert len(texts_of(reader, {}, at)) == 2
    (tmp_path / "later" / "a").write_bytes(b"1\n")
    assert reader.latestOffset() == at


def test_driver_opens_no_file_and_small_files_are_dealt(tmp_path, monkeypatch):
    """Planning a batch takes a listing alone, and thousands of small files don't land in one task."""
    for i in range(3000):
        (tmp_path / f"{i}.log").write_bytes(b"line\nhalf")
    reader, opened, found = lines.LineReader({"path": str(tmp_path)}), [], lines.opened

    class Store:
        def __init__(self, store):
            self.get_file_info = store.get_file_info

        def open_input_file(self, path):
            opened.append(path)
            return found(path)[0].open_input_file(path)

    monkeypatch.setattr(lines, "opened", lambda path: (Store(found(path)[0]), found(path)[1]))
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert not opened
    assert len(parts) > 2 and max(len(p.pieces) for p in parts) < 1200
    assert sum(b.num_rows for b in reader.read(parts[0])) == len(parts[0].pieces) == len(opened)
    assert not any(p.pieces for p in reader.partitions(end, reader.latestOffset()))


def test_a_line_is_given_by_the_batch_that_holds_its_end(tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 3)
    log, reader, at, got = tmp_path / "a", lines.LineReader({"path": str(tmp_path)}), {}, []
    for text in (b"one\nlong li", b"ne with", b" more\n\nla", b"st\n"):
        with log.open("ab") as f:
            f.write(text)
        new = reader.latestOffset()
        got.append([(s, line) for _, s, line in texts_of(reader, at, new)])
        at = new
    assert got == [[(0, "one")], [], [(4, "long line with more")], [(25, "last")]]


def test_logs_appended_again_are_the_same(spark, tmp_path):
    """A writer that fails and starts anew leaves what it would have left, and nothing but the logs lies in the folder."""
    rows = [("7", 0, 0, "ab\nc"), ("7", 1, 4, "é\n"), ("none", 0, 0, "x")]
    pieces = spark.createDataFrame(rows, "run string, nth long, at long, piece string")
    for _ in range(2):
        _append_logs(pieces, str(tmp_path / "in"))
    _append_logs(spark.createDataFrame([("7", 0, 7, "end\n")], pieces.schema), f"file://{tmp_path}/in")
    assert {p.name: p.read_bytes() for p in (tmp_path / "in").iterdir()} == {"run=7.jsonl": "ab\ncé\nend\n".encode(), "run=none.jsonl": b"x"}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, log = tmp_path / "in", tmp_path / "in" / "run=1" / "m.jsonl"
    log.parent.mkdir(parents=True)
    record = '{"timestep": %d, "fps": 1, "learning_rate": 0.1, "algorithm": "PPO"}\n'
    text = "".join(record % i if i % 5 else "not json\n" for i in range(50))
    stream = lines.appended_metrics(spark, str(folder))
    table = BatchTable(spark, str(tmp_path / "out"), stream.schema)
    for cut in (0, 700, 1500, len(text)):
        log.write_text(text[:cut])
        q = follow(stream, table.put, str(tmp_path / "check"), every="0 seconds")
        q.processAllAvailable()
        q.stop()
    assert sorted(r.timestep for r in table.read().collect()) == [i for i in range(50) if i % 5]


def test_a_batch_counts_once(spark, tmp_path):
    schema = spark.range(1).schema
    one, two = BatchTable(spark, str(tmp_path / "t"), schema), BatchTable(spark, str(tmp_path / "t"), schema)
    assert one.read().count() == 0 and one.read().columns == ["id", "batch"]
    one.put(spark.range(3), 0)
    two.put(spark.range(3), 0)
    one.put(spark.range(5), 1)
    spark.range(9).write.parquet(str(tmp_path / "t" / "data" / ("0" * 32)))  # a failed attempt
    (tmp_path / "t" / "commits" / f"1.{'f' * 32}").touch()  # a second writer of batch 1, later by name
    spark.range(5).write.parquet(str(tmp_path / "t" / "data" / ("f" * 32)))
    assert sorted((r.id, r.batch) for r in two.read().collect()) == sorted([(i, 0) for i in range(3)] + [(i, 1) for i in range(5)])
    assert sorted((r.id, r.batch) for r in two.latest("id").collect()) == [(i, 1) for i in range(5)]


def test_intervals_in_any_order():
    rng = random.Random(4)
    for _ in range(300):
        times = [rng.randint(0, 60) for _ in range(rng.randint(1, 25))]
        silence = rng.randint(0, 5)
        want = []
        for t in sorted(times):
            if want and t - want[-1][1] <= silence:
                want[-1] = (want[-1][0], t, want[-1][2] + 1)
            else:
                want.append((t, t, 1))
        now, rest = [], list(times)
        while rest:
            k = rng.randint(1, len(rest))
            now, rest = liveness.joined(now, rest[:k], silence), rest[k:]
        assert now == want


def test_open_intervals_are_those_of_the_last_batch(spark):
    rows = [("a", 0, 5, 2, True, 0), ("a", 0, 8, 3, True, 1), ("a", 0, 8, 3, False, 2), ("a", 50, 50, 1, True, 2), ("b", 1, 1, 1, True, 0), ("c", 1, 2, 2, True, 0), ("c", 1, 2, 2, False, 3)]
    df = spark.createDataFrame(rows, "run string, live_from long, last_record long, n long, live boolean, batch long")
    df = df.withColumn("live_from", F.timestamp_seconds("live_from")).withColumn("last_record", F.timestamp_seconds("last_record"))
    got = {(r.run, int(r.live_from.timestamp()), r.n, r.live) for r in liveness.current(df).collect()}
    assert {(r[0], r[2], r[3]) for r in got} == {("a", 3, False), ("a", 1, True), ("b", 1, True), ("c", 2, False)} and len(got) == 4


def test_a_run_has_one_timer_however_many_intervals():
    from tesspan.streaming.liveness import Liveness

    class Handle:
        def __init__(self):
            self.kept, self.timers, self.calls = [], set(), 0

        def getListState(self, *_):
            return self

        def exists(self):
            return bool(self.kept)

        def get(self):
            return iter(self.kept)

        def put(self, kept):
            self.kept = list(kept)

        def clear(self):
            self.kept = []

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, t):
            self.calls += 1
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def getCurrentWatermarkInMs(self):
            return 52_000

    handle, second = Handle(), 1_000_000
    live = Liveness(second)
    live.init(handle)
    opened = list(live.handleInputRows(("a",), iter([{"us": k * 10 * second} for k in range(9)]), None))
    assert len(opened) == 9 and len(handle.timers) == handle.calls == 1
    handle.timers.clear()  # the timer expires
    closed = list(live.handleExpiredTimer(("a",), handle, None))
    assert [(r["live_from"] // second, r["live"]) for r in closed] == [(k * 10, False) for k in range(6)]
    assert handle.timers == {61_001} and [i[0] // second for i in handle.kept] == [60, 70, 80]
