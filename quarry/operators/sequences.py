"""Sequential logic: quotas, throttles, runs, carried values, sections."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def daily_quota(events: DataFrame, limit: int) -> DataFrame:
    """events with admitted: the first `limit` of each user, type and day. 0 denies all, below 0 admits all."""
    if limit <= 0:
        return events.withColumn("admitted", F.lit(limit < 0))
    order = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return events.withColumn("admitted", F.row_number().over(order) <= limit)


def throttle(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(event_id, admitted): an event passes if fewer than `limit` admitted events of its key lie within `seconds` before it.

    Only admitted events count, so each decision depends on those before: a key's events are taken in order, with the
    last `limit` admitted times as all the state. events: key, event_id, ts. Keys are dealt by hash, sorted, and run through in one
    pass that holds one batch: a key that holds most events takes long, as it must be taken in order, but no more memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window = None, deque()
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    now, window = key, deque()
                while window and t - window[0] > seconds * 1_000_000:
                    window.popleft()
                out.append(len(window) < limit)
                if out[-1]:
                    window.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.bool_())], ["event_id", "admitted"])

    timed = events.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(run, "event_id long, admitted boolean")


def table_headers(lines: DataFrame) -> DataFrame:
    """lines(doc, pos, line) with header: the first line of the run of table lines (two bars or more) that a line continues; else null."""
    is_row = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit(""))) >= 2
    order = Window.partitionBy("doc").orderBy("pos")
    parted = lines.withColumn("__row", is_row).withColumn("__run", F.sum((~is_row).cast("int")).over(order))
    run = Window.partitionBy("doc", "__run").orderBy("pos")
    head = F.first(F.when(F.col("__row"), F.col("line")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))
    first = F.sum(F.col("__row").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return parted.withColumn("header", F.when(F.col("__row") & ~first, head)).drop("__row", "__run")


def sections(lines: DataFrame, pattern: str) -> DataFrame:
    """Sections of lines(doc, pos, line) at heading lines: doc, section, heading, lines. What stands before the first heading has none."""
    heading = F.trim("line").rlike(pattern)
    number = F.sum(heading.cast("int")).over(Window.partitionBy("doc").orderBy("pos"))
    parted = lines.withColumn("section", number).withColumn("__h", F.when(heading, F.trim("line")))
    return parted.groupBy("doc", "section").agg(F.max("__h").alias("heading"), F.count_if(F.col("__h").isNull()).alias("lines"))


def carry(rows: DataFrame, value: str, key: str, *order: str) -> DataFrame:
    """rows with value carried forward over nulls within a key."""
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


_SUFFIX = r"^(.*?)((?:-[1-9][0-9]*)*)$"


def unique_names(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with unique: the name, or with the first of -2, -3, ... that makes it one no earlier row has, be it made or its own.

    Only names that are equal but for numbers at their end can meet. Where such a family has one name, its rows are numbered; the others are
    taken in order, in one pass that holds a counter and a mark for each name of a family. A null name stays null.
    """
    family = F.when(F.col(name).isNotNull(), F.regexp_extract(F.col(name), _SUFFIX, 1))
    mixed = rows.select(family.alias("__f"), F.col(name).alias("__n")).groupBy("__f").agg(F.min("__n").alias("__a"), F.max("__n").alias("__b")).where("__a <> __b").select("__f")
    marked = rows.withColumn("__f", family)
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    alone = marked.join(mixed, "__f", "left_anti").withColumn("unique", F.when(F.col(name).isNull() | (n == 1), F.col(name)).otherwise(F.concat_ws("-", F.col(name), n.cast("string")))).drop("__f")
    met = marked.join(mixed, "__f", "left_semi").select("__f", *rows.columns)
    at, names = met.columns.index(name), [*rows.columns, "unique"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, last = None, set(), {}

        def taken(x: str) -> bool:
            base, _, k = x.rpartition("-")
            return x in own or (k.isdigit() and k[:1] != "0" and 2 <= int(k) <= last.get(base, 1))

        for batch in batches:
            out = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if key != now:
                    now, own, last = key, set(), {}
                if not taken(x):
                    own.add(x)
                    out.append(x)
                    continue
                k = last.get(x, 1) + 1
                while taken(f"{x}-{k}"):
                    k += 1
                last[x] = k
                out.append(f"{x}-{k}")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], names)

    kind = StructType([*rows.schema.fields, StructField("unique", StringType())])
    # Dealt by a hash of its own: by __f alone it would be the join's own partitioning, Spark would leave it out, and a join that is split for skew
    # or turned into a broadcast at run time would part a family among tasks.
    return alone.select(*rows.columns, "unique").unionAll(met.repartition(F.xxhash64("__f")).sortWithinPartitions("__f", *order).mapInArrow(run, kind))


def slices(marks: DataFrame) -> DataFrame:
    """Each mark(doc, pos, n) with the text up to the next: doc, pos, length; n is the document's length."""
    nxt = F.lead("pos").over(Window.partitionBy("doc").orderBy("pos"))
    return marks.select("doc", "pos", (F.coalesce(nxt, F.col("n")) - F.col("pos")).alias("length"))
