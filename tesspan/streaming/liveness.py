"""Which runs are live: a run goes live with a record and falls silent when none has come for a while of event time.

Each run's state is a short list of intervals that may still grow.  A record joins the intervals that it is no further from than `silence`
(two of them become one if it lies between); the run's event-time timer closes its intervals once the watermark has passed
their last record by more than that, so state is dropped when a run falls silent.  Records in disorder by less than
the watermark's delay change nothing; later ones are dropped by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "run string, live_from long, last_record long, n long, live boolean"
_STATE = "first long, last long, n long"


def joined(intervals: list[tuple[int, int, int]], times: list[int], silence: int) -> list[tuple[int, int, int]]:
    """Intervals (first, last, number of records) in order, with more records; all in microseconds."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted([*intervals, *((t, t, 1) for t in times)]):
        if out and first - out[-1][1] <= silence:
            own = out[-1]
            out[-1] = (own[0], max(own[1], last), own[2] + n)
        else:
            out.append((first, last, n))
    return out


def _rows(run, intervals: list[tuple[int, int, int]], live: bool) -> Iterator[Row]:
    for first, last, n in intervals:
        yield Row(run=run, live_from=first, last_record=last, n=n, live=live)


class Liveness(StatefulProcessor):
    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("intervals", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = [row["us"] for row in rows]
        known = self._known()
        now = joined(known, times, self.silence)
        self.state.put(now)
        self._set_timer(known, now)
        yield from _rows(key[0], now, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        closed = [i for i in known if self._ends(i) <= mark]
        rest = [i for i in known if self._ends(i) > mark]
        if rest:
            self.state.put(rest)
            self.handle.registerTimer(self._ends(rest[0]))
        else:
            self.state.clear()
        yield from _rows(key[0], closed, False)

    def _known(self) -> list[tuple[int, int, int]]:
        return [tuple(int(x) for x in i) for i in self.state.get()] if self.state.exists() else []

    def _ends(self, interval: tuple[int, int, int]) -> int:
        """The millisecond in which an interval is over."""
        return (interval[1] + self.silence) // 1000 + 1

    def _set_timer(self, known: list[tuple[int, int, int]], now: list[tuple[int, int, int]]) -> None:
        """A run has one timer, for its first interval, which ends before the others; when it expires, all that are over are closed at once."""
        have, wanted = ({self._ends(i) for i in intervals[:1]} for intervals in (known, now))
        for t in have - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - have:
            self.handle.registerTimer(t)

    def close(self) -> None:
        pass


def liveness(records: DataFrame, silence_seconds: int = 10, delay: str = "10 seconds") -> DataFrame:
    """The live intervals of a stream of records (run, ts), in update mode.

    Each batch gives the open intervals of the runs it has records of (live), and the intervals that have ended (not live), each
    of these once.  The state store has to be the one of RocksDB, as keyed timers need it.
    """
    rows = records.select(F.col("run").cast("string").alias("run"), F.col("ts").cast("timestamp").alias("ts")).where("run IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    found = rows.groupBy("run").transformWithState(Liveness(silence_seconds * 1_000_000), outputStructType=OUT, outputMode="update", timeMode="eventtime")
    return found.select("run", F.timestamp_micros("live_from").alias("live_from"), F.timestamp_micros("last_record").alias("last_record"), "n", "live")


def current(rows: DataFrame) -> DataFrame:
    """The intervals as they stand, from all that liveness() gave with its batch: those that ended, and the open ones of each run's last batch."""
    ended = rows.where("NOT live")
    last = rows.where("live").groupBy("run").agg(F.max("batch").alias("batch"))
    open_ = rows.where("live").join(last, ["run", "batch"])
    open_ = open_.join(ended.select("run", F.col("live_from")), ["run", "live_from"], "left_anti")
    return ended.unionByName(open_).drop("batch")
