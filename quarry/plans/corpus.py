"""Queries of chunks, pages, events and their streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import chunking, html
from quarry.operators import sequences as S
from quarry.sources.tables import sources, table
from quarry.streaming import events as E


def c01_chunks(spark, d):
    return chunking.build_chunks(sources(table(spark, d, "documents"))).select("chunk_id", "source_id", "chunk_index", "token_count", F.md5("chunk_text").alias("text_md5"))


def c01_chunk_coverage(spark, d):
    """The words of each document's chunks (without stamps) are its own, in order, where no chunk was dropped."""
    s = sources(table(spark, d, "documents")).withColumn("title", F.lit("")).withColumn("doc", F.col("doc_id"))
    made = chunking.build_chunks(s, least=1).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    plain = F.array_join(F.transform("c", lambda x: X.collapse(F.replace(x["chunk_text"], F.lit("|"), F.lit("")))), " ")
    return made.join(s.select("source_id", "full_text", "doc"), "source_id").where(~F.contains("full_text", F.lit("|"))).select(F.col("doc").alias("doc_id"), F.md5(plain).alias("words_md5"))


def c01_all_coverage(spark, d):
    """The words of each document's chunks, without stamps and repeated headers, are its own, in order; tables too."""
    s = sources(table(spark, d, "documents")).withColumn("title", F.lit(""))
    made = chunking.build_chunks(s, least=1).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    rows = made.join(s.select("source_id", "full_text", "doc_id"), "source_id").select("doc_id", "full_text", F.col("c.chunk_text").alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [chunking.unrepeated(t.as_py(), c.as_py()) for t, c in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.string())], ["doc_id", "words"])

    return rows.mapInArrow(run, "doc_id long, words string").select("doc_id", F.md5("words").alias("words_md5"))


def x20_page_text(spark, d):
    return html.clean_pages(table(spark, d, "pages")).select("page_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def x22_page_sections(spark, d):
    lines = html.clean_pages(table(spark, d, "pages")).select(F.col("page_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return S.sections(lines, r"(?i)^(Sec\.?\s*[0-9]|Article\s|Division\s|Chapter\s)").select("doc", "section", "heading", "lines")


def w06_table_headers(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return S.table_headers(lines).where("header is not null").select("doc", "pos", F.md5("header").alias("header"))


def w14_sections(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.concat_ws(" ", F.when(F.col("turn") % 3 == 1, "Sec. 4"), "text").alias("line"))
    return S.sections(lines, r"^Sec\. [0-9]").select("doc", "section", "lines", F.md5("heading").alias("heading"))


def w11_carried(spark, d):
    e = table(spark, d, "events").withColumn("article", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return S.carry(e, "article", "user_id", "ts", "event_id").select("event_id", "article")


def w09_unique_names(spark, d):
    return S.unique_names(table(spark, d, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("name")), "name", "doc_id").select("doc_id", "unique")


def w10_slices(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("n"), F.explode(F.array(F.lit(0), F.floor(F.length("text") / 3).cast("int"), F.floor(F.length("text") / 2).cast("int"))).alias("pos")).distinct()
    return S.slices(t)


def w07_daily_quota(spark, d):
    return S.daily_quota(table(spark, d, "events"), 2).select("event_id", "admitted")


def w08_throttle(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return S.throttle(e, 2, 6 * 3600)


def t02_window_counts(spark, d):
    return E.window_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def w13_question_dedupe(spark, d):
    """Of each conversation's turns that ask the same, the first specific one (or the first), in order."""
    key = F.when(F.col("turn") % 3 == 0, "hours").when(F.col("turn") % 3 == 1, "parking").otherwise(F.concat(F.lit("x"), "turn"))
    c = table(spark, d, "conversations").select("conv_id", "turn", key.alias("key"), (F.col("turn") % 2 == 0).alias("generic"))
    return c.groupBy("conv_id", "key").agg(F.min_by("turn", F.struct("generic", "turn")).alias("chosen"), F.min("turn").alias("place"))


def t08_stage_trace(spark, d):
    """Turns of a conversation as stages: the last of each role."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id", "role").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (c01_chunks, c01_chunk_coverage, c01_all_coverage, x20_page_text, x22_page_sections, w06_table_headers, w14_sections, w11_carried, w09_unique_names, w10_slices, w07_daily_quota, w08_throttle, t02_window_counts, w13_question_dedupe, t08_stage_trace)}

ORACLE = {
    "c01_chunk_coverage": "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as words_md5 from documents where not contains(text, '|') and trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''",
    "c01_all_coverage": "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as words_md5 from documents where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''",
    "w06_table_headers": "with l as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents), r as (select *, length(line) - length(replace(line, '|', '')) >= 2 as is_row from l), g as (select *, sum((not is_row)::int) over (partition by doc order by pos) as run from r), h as (select *, first_value(line) over (partition by doc, run, is_row order by pos) as header, row_number() over (partition by doc, run, is_row order by pos) as k from g where is_row) select doc, pos::int as pos, md5(header) as header from h where k > 1",
    "w14_sections": "with l as (select conv_id as doc, turn as pos, case when turn % 3 = 1 then 'Sec. 4 ' || text else text end as line from conversations), g as (select *, trim(line) like 'Sec. 4 %' or trim(line) = 'Sec. 4' as h, sum((trim(line) like 'Sec. 4%')::int) over (partition by doc order by pos) as section from l) select doc, section::bigint as section, count(*) filter (not h) as lines, md5(max(case when h then trim(line) end)) as heading from g group by 1, 2",
    "w11_carried": "select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as article from events",
    "w09_unique_names": "with n as (select doc_id, source || '-' || lang as name, row_number() over (partition by source, lang order by doc_id) as r from documents) select doc_id, case when r = 1 then name else name || '-' || r end as unique from n",
    "w10_slices": "with t as (select distinct doc_id as doc, length(text) as n, unnest([0, length(text) // 3, length(text) // 2]) as pos from documents) select doc, pos::int as pos, (coalesce(lead(pos) over (partition by doc order by pos), n) - pos)::int as length from t",
    "w07_daily_quota": "select event_id, row_number() over (partition by user_id, event_type, ts::date order by ts, event_id) <= 2 as admitted from events",
    "t02_window_counts": "select ts::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "w13_question_dedupe": "with c as (select conv_id, turn, case turn % 3 when 0 then 'hours' when 1 then 'parking' else 'x' || turn end as key from conversations) select conv_id, key, coalesce(min(case when turn % 2 = 1 then turn end), min(turn)) as chosen, min(turn) as place from c group by 1, 2",
    "t08_stage_trace": "select conv_id, role, max(turn) as last_turn, count(*) as n from conversations group by 1, 2",
}
