"""Queries of checks, picks and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import validation as V
from quarry.plans.retrieval import _PLAINLY, _given
from quarry.sources.tables import table


def x27_url_problems(spark, d):
    p = table(spark, d, "pages")
    n = F.col("page_id")
    url = F.when(n % 6 == 0, F.lit(None).cast("string")).when(n % 6 == 1, F.concat(F.lit("ftp://h/"), n)).when(n % 6 == 2, F.concat(F.lit("https://www.example.com/"), n)).when(n % 6 == 3, "https://h.gov/TODO").otherwise(F.concat(F.lit("https://city"), n, F.lit(".gov/code")))
    return p.select("page_id", V.url_problem(url).alias("problem"))


def p19_reserved(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, " [Reserved]").when(F.col("p_partkey") % 4 == 1, " (REPEALED.)").when(F.col("p_partkey") % 4 == 2, " reserved parking").otherwise("")).alias("title"))
    return p.where(~V.is_reserved(F.col("title"))).select("p_partkey")


def x36_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.confidence_label((F.col("o_orderkey") % 100) / 100).alias("label"))


def j07_resolve(spark, d):
    """Customers as addresses: nation is the locality, market segment the county, region the state."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    county = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    rows = c.select("c_custkey", F.col("n_name").alias("locality"), county.alias("county"), F.col("r_name").alias("state"))
    k = F.col("n_nationkey")
    strategy = F.when(k % 3 == 0, "county").when(k % 3 == 1, "locality").otherwise("locality_and_county")
    rules = geo.select(k.alias("pos"), strategy.alias("strategy"), F.upper("n_name").alias("locality"), F.lit("building").alias("county"), F.lower("r_name").alias("state"), F.concat(F.lit("j"), k).alias("jurisdiction_id"))
    return V.resolve(rows, rules, "c_custkey")


def o06_pick(spark, d):
    p = table(spark, d, "part").select("p_brand", F.col("p_name").alias("title"), "p_size", "p_type")
    return V.pick(p, "p_brand", (~F.lower("p_type").contains("steel")).alias("a"), F.col("p_size"))


def x56_replies(spark, d):
    e = table(spark, d, "events").where("event_id % 5 = 0")
    n = F.col("event_id")
    body = F.concat(F.lit('{"decision":"'), F.col("event_type"), F.lit('","confidence":'), (n % 30) / 10.0, F.lit("}"))
    text = F.when(n % 20 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 20 == 5, "sorry").when(n % 20 == 10, "{}").otherwise(body)
    decision, confidence = V.parse_reply(text)
    return e.select("event_id", decision.alias("decision"), F.round(confidence, 6).alias("confidence"))


def x56_all_replies(spark, d):
    """Every event as a reply: of twenty in turn, five fenced, five without JSON, five without a decision, five plain."""
    e = table(spark, d, "events")
    n = F.col("event_id")
    body = F.concat(F.lit('{"decision":"'), F.col("event_type"), F.lit('","confidence":'), (n % 30) / 10.0, F.lit("}"))
    text = F.when(n % 20 < 5, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 20 < 10, "sorry").when(n % 20 < 15, "{}").otherwise(body)
    decision, confidence = V.parse_reply(text)
    return e.select("event_id", decision.alias("decision"), F.round(confidence, 6).alias("confidence"))


def x50_valid_citations(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_orderkey")
    cited = F.array(*[F.concat(F.lit("s"), n % k) for k in (3, 5, 7, 3)])
    kept, confidence = V.valid_citations(cited, F.array(F.lit("s1"), F.lit("s4"), F.lit("s6")), F.lit(0.8))
    return o.select("o_orderkey", F.array_join(kept, ",").alias("kept"), confidence.alias("confidence"))


def w03_reserved_hits(spark, d):
    return R.pick(R.candidates(*_given(spark, d)), runners=(5, 30, 2)).select("qid", "slot", "chunk_id")


def a12_status_counts(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("other"))


def a22_states(spark, d):
    return table(spark, d, "customer").select(F.upper(F.trim("c_mktsegment")).alias("state")).distinct()


def u05_ordered_distinct(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.array_join(F.array_distinct(F.array("source", "lang", "source", F.lit("x"), "lang")), ",").alias("items"))


def x29_merged_context(spark, d):
    c = table(spark, d, "conversations")
    asked = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("turn", F.concat_ws(": ", "role", F.substring("text", 1, 40)).alias("line"))))).alias("l"))
    return asked.select("conv_id", F.md5(F.concat(F.lit("Clarifications:\n- "), F.array_join(F.transform("l", lambda x: x["line"]), "\n- "))).alias("context_md5"))


def x29_whole_context(spark, d):
    """Each conversation's turns merged whole, without the white space around them; turns of white space alone are left out."""
    space = F.lit(" \t\n\r\x0b\x0c")
    c = table(spark, d, "conversations").withColumn("answer", F.trim("text", space)).where("answer <> ''")
    line = F.concat(F.trim("role", space), F.lit(": "), F.col("answer")).alias("line")
    asked = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line))).alias("l"))
    return asked.select("conv_id", F.md5(F.concat(F.lit("Clarifications:\n- "), F.array_join(F.transform("l", lambda x: x["line"]), "\n- "))).alias("context_md5"))


QUERIES = {f.__name__: f for f in (x27_url_problems, p19_reserved, x36_labels, j07_resolve, o06_pick, x56_replies, x56_all_replies, x50_valid_citations, w03_reserved_hits, a12_status_counts, a22_states, u05_ordered_distinct, x29_merged_context, x29_whole_context)}

ORACLE = {
    "x27_url_problems": "select page_id, case page_id % 6 when 0 then 'missing' when 1 then 'scheme' when 2 then 'placeholder' when 3 then 'todo' end as problem from pages",
    "p19_reserved": "select p_partkey from part where p_partkey % 4 >= 2",
    "x36_labels": "select o_orderkey, case when (o_orderkey % 100) / 100.0 >= 0.75 then 'high' when (o_orderkey % 100) / 100.0 >= 0.6 then 'medium' else 'low' end as label from orders",
    "j07_resolve": "with g as (select n_nationkey as k, n_name, r_name from nation join region on n_regionkey = r_regionkey), c as (select c_custkey, n_name, case when c_custkey % 5 <> 0 then lower(c_mktsegment) end as county, r_name from customer join g on c_nationkey = k), m as (select c.c_custkey, r.k, r.k % 3 = 0 as late from c join g r on c.r_name = r.r_name and case r.k % 3 when 1 then c.n_name = r.n_name when 0 then coalesce(c.county = 'building', false) else c.n_name = r.n_name and coalesce(c.county = 'building', true) end) select c.c_custkey, (select 'j' || k from m where m.c_custkey = c.c_custkey order by late, k limit 1) as jurisdiction_id from c",
    "o06_pick": "select p_brand, p_name as title from part qualify row_number() over (partition by p_brand order by not contains(lower(p_type), 'steel'), p_size, p_name) = 1",
    "x56_replies": "select event_id, case when event_id % 20 in (5, 10) then 'unknown' else event_type end as decision, case when event_id % 20 in (5, 10) then 0.0::double else round(least(1.0, (event_id % 30) / 10.0)::double, 6) end as confidence from events where event_id % 5 = 0",
    "x56_all_replies": "select event_id, case when event_id % 20 between 5 and 14 then 'unknown' else event_type end as decision, case when event_id % 20 between 5 and 14 then 0.0::double else round(least(1.0, (event_id % 30) / 10.0)::double, 6) end as confidence from events",
    "x50_valid_citations": "with k as (select o_orderkey, list_filter(['s' || (o_orderkey % 3), 's' || (o_orderkey % 5), 's' || (o_orderkey % 7)], lambda x: x in ('s1', 's4', 's6')) as l from orders), u as (select o_orderkey, list_filter(l, lambda x, i: list_position(l, x) = i) as l from k) select o_orderkey, array_to_string(l, ',') as kept, case when len(l) = 0 then 0.3::double else 0.8::double end as confidence from u",
    "w03_reserved_hits": _PLAINLY + ", h as (select r.qid, r.chunk_id, row_number() over (partition by r.qid order by r.rank) as i from ranked r where r.rank between 5 and 30 and not exists (select 1 from top8 t where t.qid = r.qid and t.chunk_id = r.chunk_id)), l as (select qid, max(slot) as last from top8 group by qid) select qid, slot::int as slot, chunk_id from top8 union all select qid, (last + i)::int, chunk_id from h join l using (qid) where i <= 2",
    "a12_status_counts": "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as done, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderstatus not in ('F', 'O')) as other from orders group by 1",
    "a22_states": "select distinct upper(trim(c_mktsegment)) as state from customer",
    "u05_ordered_distinct": "select doc_id, source || ',' || lang || ',x' as items from documents",
    "x29_merged_context": "select conv_id, md5('Clarifications:' || chr(10) || '- ' || string_agg(role || ': ' || left(text, 40), chr(10) || '- ' order by turn)) as context_md5 from conversations where trim(text) <> '' group by 1",
    "x29_whole_context": "with s as (select ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) as s) select conv_id, md5('Clarifications:' || chr(10) || '- ' || string_agg(trim(role, s) || ': ' || trim(text, s), chr(10) || '- ' order by turn)) as context_md5 from conversations, s where trim(text, s) <> '' group by 1",
}
