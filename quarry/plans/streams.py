"""Queries of streams with state, the event log and the versioned index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.index_sync import sync_index
from quarry.sources.tables import shared_folder, table
from quarry.sources.versions import Versions
from quarry.streaming import event_log as L
from quarry.streaming import state as S


def _events(spark, d) -> DataFrame:
    """The table of events as a stream: all its files are there, so one micro-batch holds them."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")  # as a pattern it may be a file or a folder


def _written(spark, stream: DataFrame) -> DataFrame:
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    S.use_rocksdb(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def t02_admitted_stream(spark, d):
    return _written(spark, S.daily_admission(_events(spark, d), 2, "40 days"))


def t03_throttled_stream(spark, d):
    return _written(spark, S.throttled(_events(spark, d), 2, 6 * 3600, "40 days"))


def t01_event_log(spark, d):
    """The events as a stream appended to a log, twice with one checkpoint: the second run finds nothing to do."""
    at = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log = Versions(spark, f"{at}/log")
    for _ in range(2):
        L.log_events(_events(spark, d), log, f"{at}/checkpoint").awaitTermination()
    return log.read().groupBy("day", "late", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def c05_index_sync(spark, d):
    """Documents as chunks of an index, synced twice: first those with labels, their texts upside down where they are toxic, then all as they are."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("chunk_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = docs.join(labels, "doc_id").withColumn("text", F.when(F.col("toxic") == 1, F.reverse("text")).otherwise(F.col("text")))
    index = Versions(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    embed = lambda c: c.select("chunk_id", F.array(F.length("text_hash").cast("double"), F.conv(F.substring("text_hash", 1, 8), 16, 10).cast("double")).alias("vector"))
    runs = None
    for name, rows in (("first", first), ("second", docs), ("third", docs)):
        told = sync_index(index, rows.select("chunk_id", F.md5("text").alias("text_hash")), embed, 2, name, batches=2)
        runs = told if runs is None else runs.unionAll(told)
    return runs


QUERIES = {f.__name__: f for f in (t01_event_log, t02_admitted_stream, t03_throttled_stream, c05_index_sync)}

_THROTTLE = """
with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as r from events),
s as (select user_id, event_id, r, true as admitted, [t] as times from e where r = 1
  union all select user_id, event_id, r, len(live) < 2, case when len(live) < 2 then list_append(live, t) else live end
  from (select e.user_id, e.event_id, e.r, e.t, list_filter(s.times, lambda x: e.t - x <= 21600000000) as live from s join e on e.user_id = s.user_id and e.r = s.r + 1))
select event_id, admitted from s
"""

ORACLE = {
    "t01_event_log": "select ts::date as day, false as late, event_type, count(*) as n, sum(event_id)::bigint as ids from events group by 1, 3",
    "t02_admitted_stream": "select event_id, row_number() over (partition by user_id, event_type, ts::date order by ts, event_id) <= 2 as admitted from events",
    "t03_throttled_stream": _THROTTLE,
    "w08_throttle": _THROTTLE,
    "c05_index_sync": """
with l as (select doc_id, max(toxic) as toxic from labels group by 1), d as (select doc_id, coalesce(text, '') as t, toxic from documents left join l using (doc_id)),
n as (select count(*) as every, count(toxic) as labelled, count(*) filter (toxic is null or (toxic = 1 and reverse(t) <> t)) as due from d)
select 'first' as run, labelled as embedded, 0::bigint as pruned, labelled as held, 0::bigint as missing, true as ready from n
union all select 'second', due, 0, every, 0, true from n union all select 'third', 0, 0, every, 0, true from n
""",
}
