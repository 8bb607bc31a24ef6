"""Streams of events: windowed counts, daily admission, throttling with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and their value per window and type; batch and stream alike (a stream drops what is later than `late`)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def daily_admission(events: DataFrame, limit: int) -> DataFrame:
    """event_id, admitted: the first `limit` events of each user, type and day, in order of arrival. The count of a key's day is its state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        for rows in parts:
            rows = rows.sort_values(["ts", "event_id"])
            place = n + pd.Series(range(len(rows)), index=rows.index)
            n += len(rows)
            yield pd.DataFrame({"event_id": rows["event_id"], "admitted": place < limit})
        state.update((min(n, max(limit, 0)),))

    keyed = events.withColumn("day", F.to_date("ts")).select("user_id", "event_type", "day", "event_id", "ts")
    return keyed.groupBy("user_id", "event_type", "day").applyInPandasWithState(run, "event_id long, admitted boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, admitted: passes if fewer than `limit` admitted events of the user lie within `seconds` before. State: those times."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        for rows in parts:
            rows = rows.sort_values(["ts", "event_id"])
            out = []
            for t in (rows["ts"].astype("datetime64[us]").astype("int64")).tolist():
                times = [x for x in times if t - x <= seconds * 1_000_000]
                out.append(len(times) < limit)
                if out[-1]:
                    times.append(t)
            yield pd.DataFrame({"event_id": rows["event_id"], "admitted": out})
        state.update((times,))

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(run, "event_id long, admitted boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout)


def index_new(stream: DataFrame, target: str, checkpoint: str, key: str = "chunk_id"):
    """Append each micro-batch's rows whose key the target doesn't hold yet; a batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        once = batch.dropDuplicates([key])
        try:
            held = batch.sparkSession.read.parquet(target).select(key)
        except Exception as e:  # only a target that isn't there yet is empty; any other failure must not pass for it
            if "PATH_NOT_FOUND" not in str(e):
                raise
            held = None
        (once if held is None else once.join(held, key, "left_anti")).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
