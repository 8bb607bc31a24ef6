"""Streams of event rows into a partitioned log, each row once whatever happens between.

A micro-batch is published as one version under its stream's and its own number; one that runs again after a stop finds
itself in the log, and files of one that stopped before that belong to no version. Rows that lie further back than `delay`
behind the latest time of earlier batches go to partitions of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.versions import Versions


def append_batch(log: Versions, rows: DataFrame, batch: str, time_col: str, delay: str) -> int:
    """One micro-batch, with columns day and late beside its own; the version. Rows without a time have no day and are not late."""
    high = max((e["facts"]["high"] for e in log.log() if e["facts"].get("high")), default=None)
    ts = F.col(time_col).cast("timestamp")
    late = ts < F.lit(high).cast("timestamp") - F.expr(f"interval {delay}") if high else F.lit(False)
    top = rows.agg(F.max(time_col).cast("string")).first()[0]
    marked = rows.withColumn("day", F.to_date(time_col)).withColumn("late", F.coalesce(late, F.lit(False)))
    return log.append(marked, batch=batch, by=("day", "late"), facts={"high": max(filter(None, (high, top)), default=None)})


def log_events(stream: DataFrame, log: Versions, checkpoint: str, *, name: str = "events", time_col: str = "ts", delay: str = "1 day", then: Callable[[int], None] = lambda _: None) -> StreamingQuery:
    """Start to append a stream to the log until what is there is read. `name` tells streams of one log apart; `then` runs behind each published
    batch, before the stream notes it as done."""

    def write(rows: DataFrame, number: int) -> None:
        append_batch(log, rows, f"{name}/{number}", time_col, delay)
        then(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
