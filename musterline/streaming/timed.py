"""Keyed state with a time to live, and timers that end jobs nobody ended.

Both processors run on event time: state is bounded by what the watermark has not passed.  Streams need the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).  A whole table can be
taken as one batch.
"""

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from musterline import constants as K

NEW, REPEATED = "NEW", "REPEATED"
NO_END = "NO_END_IN_TIME"
_ENDS = (K.STATUS_COMPLETED, K.STATUS_FAILED)


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _timer(micros: int) -> int:
    """Timers are set in milliseconds: the first that is not earlier."""
    return -(-micros // 1000)


class FirstWins(StatefulProcessor):
    """The first file of a hash is new; the same hash is repeated for ``horizon`` microseconds, then new again."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = self.accepted.get()[0] if self.accepted.exists() else None
        before = at
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            fresh = at is None or row["at"] - at >= self.horizon
            if fresh:
                at = row["at"]
            yield Row(id=row["id"], file_hash=key[0], filename=row["filename"], verdict=NEW if fresh else REPEATED)
        if at != before:
            if before is not None:
                self.handle.deleteTimer(_timer(before + self.horizon))
            self.accepted.update((at,))
            self.handle.registerTimer(_timer(at + self.horizon))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


class JobWatch(StatefulProcessor):
    """Ends of jobs: as reported, or ``FAILED`` where nothing follows ``PROCESSING`` within ``patience`` microseconds."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = self.started.get()[0] if self.started.exists() else None
        before = at
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            if at is not None and row["at"] - at >= self.patience:
                yield self._ended(key, at, at + self.patience, K.STATUS_FAILED, NO_END)
                at = None
            if row["status"] == K.STATUS_PROCESSING:
                at = row["at"]
            elif row["status"] in _ENDS and at is not None:
                yield self._ended(key, at, row["at"], row["status"], None)
                at = None
        if at != before:
            if before is not None:
                self.handle.deleteTimer(_timer(before + self.patience))
            if at is None:
                self.started.clear()
            else:
                self.started.update((at,))
                self.handle.registerTimer(_timer(at + self.patience))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.started.exists():
            at = self.started.get()[0]
            self.started.clear()
            yield self._ended(key, at, at + self.patience, K.STATUS_FAILED, NO_END)

    def close(self) -> None:
        pass

    @staticmethod
    def _ended(key: Any, start: int, end: int, status: str, reason: str | None) -> Row:
        return Row(job=key[0], started=start, ended=end, status=status, reason=reason)


def _timed(df: DataFrame, event_time: str, lateness: str) -> DataFrame:
    """Zoned event time for the watermark and the same as microseconds, which is what state keeps."""
    zoned = df.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return zoned.withColumn("at", F.unix_micros(event_time)).withWatermark(event_time, lateness)


def first_within(files: DataFrame, horizon: timedelta, event_time: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """``(id, file_hash, filename, verdict)`` for every file (id, file_hash, filename, event time).

    A hash is remembered for ``horizon`` after the file that was accepted, then forgotten by a timer, so
    state is bounded by the files of that time.  Files later than ``lateness`` are dropped.
    """
    rows = _timed(files.select("id", "file_hash", "filename", event_time), event_time, lateness)
    return rows.groupBy("file_hash").transformWithState(
        statefulProcessor=FirstWins(_micros(horizon)), outputStructType="id long, file_hash string, filename string, verdict string",
        outputMode="Append", timeMode="EventTime",
    )


def watched_jobs(events: DataFrame, patience: timedelta, event_time: str = "created_at", lateness: str = "1 day") -> DataFrame:
    """``(job, started_at, ended_at, status, reason)`` as jobs end, from events (id, job, status, event time).

    A job that starts anew before its end is one job from then on.  An end without a start says nothing.
    State is one number per job that is running.
    """
    rows = _timed(events.select("id", "job", "status", event_time), event_time, lateness)
    ended = rows.groupBy("job").transformWithState(
        statefulProcessor=JobWatch(_micros(patience)), outputStructType="job string, started long, ended long, status string, reason string",
        outputMode="Append", timeMode="EventTime",
    )
    return ended.select("job", _moment("started").alias("started_at"), _moment("ended").alias("ended_at"), "status", "reason")


def _moment(column: str):
    return F.timestamp_micros(column).cast("timestamp_ntz")


def ended_jobs(events: DataFrame, patience: timedelta, event_time: str = "created_at") -> DataFrame:
    """What :func:`watched_jobs` has told once all timers have passed, from a whole table of events.

    Each start looks at the event behind it, so a job's events are read once, in order.
    """
    behind = Window.partitionBy("job").orderBy(event_time, "id")
    seen = events.where(F.col("status").isin(K.STATUS_PROCESSING, *_ENDS)).select(
        "job", "status", F.col(event_time).alias("started_at"),
        F.lead(event_time).over(behind).alias("_at"), F.lead("status").over(behind).alias("_status"),
    )
    limit = F.col("started_at") + F.lit(patience)
    late = F.col("_at").isNull() | (F.col("_at") >= limit)
    return seen.where((F.col("status") == K.STATUS_PROCESSING) & (late | (F.col("_status") != K.STATUS_PROCESSING))).select(
        "job", "started_at", F.when(late, limit).otherwise(F.col("_at")).alias("ended_at"),
        F.when(late, K.STATUS_FAILED).otherwise(F.col("_status")).alias("status"), F.when(late, NO_END).alias("reason"),
    )
