"""Admission and throttling over streams, with state that ends: each key has a timer in event time, and what it holds is dropped when the
watermark has passed the time from which on it can decide nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_DAY = 86_400_000
_OUT = "event_id long, admitted boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; queries started from now on have it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


def _read(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch in order of time."""
    rows = pd.concat(list(parts), ignore_index=True)
    return rows.sort_values(["ts", "event_id"], ignore_index=True)


class DailyAdmission(StatefulProcessor):
    """How much was admitted of each (user, type) of a part of a day, in one value; a timer at the day's end.

    A call reads and writes a part's state once, however many keys it holds: with a key a call, most of the time went to single reads.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.counts = handle, handle.getValueState("counts", "keys array<string>, n array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, rows = self.counts.get(), _read(rows)
        counts = dict(zip(*held, strict=True)) if held else {}
        if not held:
            self.handle.registerTimer(int(_millis(rows["ts"]).iloc[0]) // _DAY * _DAY + _DAY)
        before = rows["of"].map(counts).fillna(0).astype("int64") if counts else 0
        place = before + rows.groupby("of", sort=False).cumcount()
        for of, n in rows["of"].value_counts(sort=False).items():
            counts[of] = min(counts.get(of, 0) + n, max(self.limit, 0))
        self.counts.update((list(counts), [int(n) for n in counts.values()]))
        yield pd.DataFrame({"event_id": rows["event_id"], "admitted": place < self.limit})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        yield from ()

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """The times at which a user was admitted within the last seconds; a timer where the last of them stops counting."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.reach = limit, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, rows, admitted = [r[0] for r in self.times.get()], _read(rows), []
        for t in _millis(rows["ts"]).tolist():
            times = [x for x in times if t - x <= self.reach]
            admitted.append(len(times) < self.limit)
            if admitted[-1]:
                times.append(t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.times.put([(t,) for t in times])
            self.handle.registerTimer(times[-1] + self.reach + 1)
        else:
            self.times.clear()
        yield pd.DataFrame({"event_id": rows["event_id"], "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def daily_admission(events: DataFrame, limit: int, delay: str = "1 hour", parts: int = 256) -> DataFrame:
    """event_id, admitted for a stream (event_id, user_id, event_type, ts): the first `limit` events of each user, type and day, in order of
    arrival and within a micro-batch of time. Events later than `delay` behind the latest are dropped, as are those without a time; a
    day's state goes once it is that far behind. Times count in UTC days. A day's keys are dealt to `parts` that a task takes one by one."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type").where("ts is not null").withWatermark("ts", delay)
    of = F.to_json(F.struct("user_id", "event_type")).alias("of")
    keyed = rows.select("ts", "event_id", of, F.floor(F.unix_millis("ts") / _DAY).alias("day"), F.pmod(F.xxhash64("user_id", "event_type"), F.lit(parts)).alias("part"))
    return keyed.groupBy("day", "part").transformWithStateInPandas(DailyAdmission(limit), _OUT, "append", "eventTime")


def throttled(events: DataFrame, limit: int, seconds: int, delay: str = "1 hour") -> DataFrame:
    """event_id, admitted for a stream (event_id, user_id, ts): an event passes if fewer than `limit` admitted ones of its user lie within
    `seconds` before it. Late events: as in daily_admission; a user's times go when the watermark is `seconds` past the last of them."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id").where("ts is not null").withWatermark("ts", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(Throttle(limit, seconds), _OUT, "append", "eventTime")
