"""Lines appended to growing files, as a streaming source of its own.

An offset is a byte position for each file (named below the folder): how much of it was there.  A batch takes the lines that end
between two such positions, so the driver lists files and opens none; a last line without its end waits for the rest, and the task that
finds its end looks back for its start.  Positions are in the checkpoint, so a restarted stream goes on in the middle of a file and gives no line twice.

Options: path (a folder; any store that pyarrow.fs opens from driver and executors), glob (names of the files, default *),
maxBytesPerTrigger (of each file; a line comes with the batch that holds its end), splitBytes (bytes that one task reads, of one or many
files, an opened file counting as OPEN more), and skipBacklogBytes: of more than that in one batch only the last so many bytes are read, from their first whole line on.

Defined results: lines end with \\n or \\r\\n; empty ones are skipped; bytes that are no UTF-8 become the replacement character; a
file that got shorter gives nothing until it is longer than it was; files and folders may appear at any time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.warehouse import METRICS, valid_metrics

SCHEMA = "path string, start long, line string"
_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("line", pa.string())])
BLOCK = 1 << 20

#: What opening a file is taken to cost, in bytes read.
OPEN = 64 << 10


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


def newline_before(file, start: int, end: int) -> int:
    """The position after the last line end in [start, end); start if there is none."""
    step = min(BLOCK, 4 << 10)
    while end > start:
        at = max(start, end - step)
        file.seek(at)
        found = file.read(end - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end, step = at, min(BLOCK, step * 4)
    return start


@dataclass
class Piece:
    """The lines of a file that end in [start, end) and begin at or behind floor."""

    name: str
    start: int
    end: int
    floor: int


@dataclass
class Pieces(InputPartition):
    """What one task reads."""

    pieces: list[Piece]


class LineReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*")
        number = lambda name, default: int(options.get(name, default))
        self.cap, self.split, self.skip = number("maxBytesPerTrigger", 0), number("splitBytes", 64 << 20), number("skipBacklogBytes", 0)
        self.taken: dict[str, int] | None = None  # unknown after a restart, until a batch is planned

    def _opened(self) -> tuple[fs.FileSystem, str]:
        store, root = opened(self.root)
        return store, root.rstrip("/") + "/"

    def initialOffset(self) -> dict:
        self.taken = {}
        return {}

    def latestOffset(self) -> dict:
        store, root = self._opened()
        out = dict(self.taken or {})
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch(info.base_name, self.glob):
                continue
            name = info.path.removeprefix(root)
            start = out.get(name, 0)
            if info.size > start:
                out[name] = min(info.size, start + self.cap) if self.cap and self.taken is not None else info.size
        return dict(sorted(out.items()))  # in one order, as Spark compares offsets as texts

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        _, root = self._opened()
        start = {path.removeprefix(root): at for path, at in start.items()}  # checkpoints of before hold whole paths
        end = {path.removeprefix(root): at for path, at in end.items()}
        self.taken = {**start, **end}
        out: list[Pieces] = []
        room = 0
        for name, stop in sorted(end.items()):
            first = start.get(name, 0)
            at = max(first, stop - self.skip) if self.skip else first
            floor = at if at > first else 0
            while at < stop:
                to = min(stop, at + self.split)
                cost = to - at + OPEN
                if cost > room:
                    out.append(Pieces([]))
                    room = self.split
                out[-1].pieces.append(Piece(name, at, to, floor))
                at, room = to, room - cost
        return out

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, root = self._opened()
        paths, starts, lines, size = [], [], [], 0
        for piece in partition.pieces:
            for at, some in self._lines(store, root, piece):
                paths += [root + piece.name] * len(some)
                starts += at
                lines += some
                size += sum(map(len, some))
                if size >= BLOCK:
                    yield self._batch(paths, starts, lines)
                    paths, starts, lines, size = [], [], [], 0
        if lines:
            yield self._batch(paths, starts, lines)

    @staticmethod
    def _batch(paths: list[str], starts: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(starts, pa.int64()), pa.array(lines, pa.string())], schema=_ARROW)

    def _lines(self, store: fs.FileSystem, root: str, piece: Piece) -> Iterator[tuple[list[int], list[str]]]:
        """Starts and texts of a piece's lines, a block at a time."""
        with store.open_input_file(root + piece.name) as file:
            at, read, held, first = piece.start, piece.start, b"", True
            file.seek(read)
            while read < piece.end:
                block = file.read(min(BLOCK, piece.end - read))
                if not block:
                    break
                read += len(block)
                held += block
                if b"\n" not in block:
                    continue
                if first:
                    at, held = self._whole(file, piece, held)
                    file.seek(read)
                    first = False
                whole = held.rfind(b"\n") + 1
                starts, lines = [], []
                for line in held[:whole].split(b"\n")[:-1]:
                    if line.strip():
                        starts.append(at)
                        lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1
                held = held[whole:]
                yield starts, lines

    @staticmethod
    def _whole(file, piece: Piece, held: bytes) -> tuple[int, bytes]:
        """held, which is what begins at the piece's start, from the start of its first line on, and where that is; a first line that begins before the floor is left out."""
        low = max(0, piece.floor - 1)
        begin = newline_before(file, low, piece.start)
        if piece.floor and begin == low:
            cut = held.find(b"\n") + 1
            return piece.start + cut, held[cut:]
        file.seek(begin)
        return begin, file.read(piece.start - begin) + held


class LineSource(DataSource):
    """Whole lines of growing files: path, start (the line's byte position), line."""

    @classmethod
    def name(cls) -> str:
        return "tesspan_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LineReader:
        return LineReader(self.options)


def appended_lines(spark: SparkSession, folder: str, glob: str = "*", **options: int) -> DataFrame:
    """A stream of the lines that are and will be appended to the files of a folder and those below it."""
    spark.dataSource.register(LineSource)
    stream = spark.readStream.format(LineSource.name()).option("path", folder).option("glob", glob)
    for name, value in options.items():
        stream = stream.option(name, str(value))
    return stream.load()


def appended_metrics(spark: SparkSession, folder: str, glob: str = "*.jsonl", **options: int) -> DataFrame:
    """The valid training records of growing JSON-lines files, with path and start; lines that don't parse are skipped."""
    lines = appended_lines(spark, folder, glob, **options)
    parsed = lines.select("path", "start", F.from_json("line", METRICS).alias("record"))
    return valid_metrics(parsed.select("path", "start", "record.*"))
