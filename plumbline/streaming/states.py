"""Stateful streams: stuck jobs go back to the queue, repeated failures lock a key.

Both keep one small value per key in the state store and an event-time timer that ends it. Rows of a
key are taken in the order of their time within a micro-batch, and what a timer would have done before
a row is done before it, so the rows that come out do not depend on how the stream is cut into batches
as long as later batches hold later rows. A timer only matters for keys that hear nothing more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ZERO = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)


@contextmanager
def timers_allowed(spark: SparkSession) -> Iterator[None]:
    """Streams with timers need the RocksDB state store; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _micros(at: pd.Timestamp) -> int:
    at = at.to_pydatetime()
    return ((at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at) - _ZERO) // _MICRO


def _time(micros: int) -> datetime:
    return _ZERO + micros * _MICRO


def _ordered(rows: Iterable[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """(time in microseconds, row number, other columns) of a key's rows, by time and number; rows without a time are left out."""
    found = [(_micros(r[0]), *r[1:]) for pdf in rows for r in pdf[columns].itertuples(index=False, name=None) if not pd.isna(r[0])]
    return sorted(found, key=lambda r: r[:2])


class _OneValue(StatefulProcessor):
    """A processor with one value of long fields and at most one timer."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.schema)

    def until(self, end: int | None) -> None:
        """The key's timer: a millisecond after ``end``, or none."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
        if end is not None:
            self.handle.registerTimer(end // 1000 + 1)

    def close(self) -> None:
        pass


class StuckJobs(_OneValue):
    """Jobs that were claimed and not finished in time: queued again, or failed after so many attempts.

    Kinds: claim (of a job that is not running and has not failed), done (of a running one), reset (of
    any: queued with no attempts). A finished job that is claimed begins anew.
    """

    schema = "started long, attempts long, failed boolean"

    def __init__(self, key: str, length: timedelta, attempts: int):
        self.key, self.length, self.most = key, length // _MICRO, attempts

    def _stuck(self, started: int | None, attempts: int, now: int) -> bool:
        return started is not None and now > started + self.length

    def _row(self, key, started: int, attempts: int) -> tuple:
        return key, _time(started + self.length), "failed" if attempts >= self.most else "queued", attempts

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "at", "status", "attempts"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        started, attempts, failed = self.value.get() if self.value.exists() else (None, 0, False)
        out = []
        for at, _, kind in _ordered(rows, ["at", "number", "kind"]):
            if self._stuck(started, attempts, at):
                out.append(self._row(key[0], started, attempts))
                failed, started = attempts >= self.most, None
            if kind == "reset":
                started, attempts, failed = None, 0, False
            elif kind == "claim" and started is None and not failed:
                started, attempts = at, attempts + 1
            elif kind == "done" and started is not None:
                started, attempts = None, 0
        self.value.update((started, attempts, failed))
        self.until(None if started is None else started + self.length)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        started, attempts, failed = self.value.get()
        if started is not None:
            self.value.update((None, attempts, attempts >= self.most))
            yield self._frame([self._row(key[0], started, attempts)])


class Locks(_OneValue):
    """The k-th failure within a window locks a key until the oldest of those k leaves the window.

    The state is the last k - 1 failures; it goes when the newest of them has left the window.
    """

    schema = "times array<bigint>"

    def __init__(self, key: str, window: timedelta, most: int):
        self.key, self.window, self.most = key, window // _MICRO, most

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = list(self.value.get()[0]) if self.value.exists() else []
        out = []
        for at, number in _ordered(rows, ["at", "number"]):
            times = [x for x in times if x > at - self.window] + [at]
            kth = times[-self.most] if len(times) >= self.most else None
            out.append((number, key[0], None if kth is None else _time(kth + self.window)))
            times = times[-self.most :]
        self.value.update((times,))
        self.until(times[-1] + self.window if times else None)
        if out:
            yield pd.DataFrame(out, columns=["number", self.key, "locked_until"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        return iter(())


def stuck_jobs(events: DataFrame, key: str, late: str = "1 hour", minutes: int = 15, attempts: int = 3) -> DataFrame:
    """key, at, status (queued or failed), attempts, from a stream of (key: long, at: timestamp, number, kind).

    ``number`` orders rows of the same time. Rows with a null key are left out.
    """
    rows = events.filter(f"`{key}` is not null").withWatermark("at", late).groupBy(key)
    return rows.transformWithStateInPandas(StuckJobs(key, timedelta(minutes=minutes), attempts), f"{key} long, at timestamp, status string, attempts long", "Append", "EventTime")


def locks(failures: DataFrame, key: str, late: str = "1 hour", minutes: int = 15, most: int = 5) -> DataFrame:
    """number, key, locked_until (null: not locked) of each failure in a stream of (key: long, at, number: long)."""
    rows = failures.filter(f"`{key}` is not null").withWatermark("at", late).groupBy(key)
    return rows.transformWithStateInPandas(Locks(key, timedelta(minutes=minutes), most), f"number long, {key} long, locked_until timestamp", "Append", "EventTime")
