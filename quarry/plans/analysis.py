"""Queries of the analysis chain: users' turns are cases, their conversation's other turns are what they cite, documents are the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import analysis as A
from quarry.operators.validation import asked_once
from quarry.sources.tables import table


def c16_analysis(spark, d):
    """Every user's turn analysed. A citation names the document whose number is its text's length, if there is one; a turn of even length has
    no reply, one without a comma no district, and from the third turn on no details are missing; a conversation whose document is toxic lies in a jurisdiction that is not supported."""
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t")).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    u = t.where("role = 'user'").join(docs, F.col("conv_id") == F.col("doc_id"), "left").withColumn("j", F.coalesce("lang", F.lit("en"))).withColumn("missing", F.when(F.col("turn") < 2, X.missing_fields(F.col("t"))).otherwise(F.array().cast("array<string>")))
    told = F.struct(F.lit("restricted").alias("decision"), F.col("t").alias("summary"), F.lit(0.8).alias("confidence"), F.array(F.lit("c1"), F.lit("zz")).alias("citation_chunk_ids"), F.array(F.lit("What are the hours?")).alias("follow_up_questions"))
    text, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    cases = u.select(
        "id", F.col("t").alias("description"), text.alias("category"), text.alias("intent"), text.alias("use"), "missing", F.transform("missing", lambda m: F.concat(F.lit("Please provide "), m)).alias("questions"), X.triggers(F.col("t")).alias("triggers"), none.alias("notes"),
        F.when(F.contains("t", F.lit(",")), "R-1").otherwise("unknown").alias("district"), F.lit("parcel").alias("district_method"), F.lit(0.9).alias("district_confidence"), F.col("j").alias("jurisdiction_id"), F.col("j").alias("jurisdiction_name"), F.lit("en").alias("parent_id"), text.alias("state"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("supported"), F.lit(True).alias("index_ready"), none.alias("index_warnings"), F.when(F.length("t") % 2 == 1, F.to_json(told)).alias("reply"), text.alias("reply_error"),
    )
    other = t.select("conv_id", F.col("turn").alias("place"), F.col("t").alias("said"), F.concat(F.lit("doc-"), F.length("t")).alias("source_id"))
    citations = t.where("role = 'user'").select("id", "conv_id", "turn").join(other, "conv_id").where("place <> turn").select("id", "place", F.concat(F.lit("c"), "place").alias("chunk_id"), "source_id", F.substring("said", 1, 20).alias("title"), F.lit("").alias("section_ref"), text.alias("jurisdiction_id"), F.when(F.endswith("said", F.lit(".")), "2024-01-01").alias("effective_date"))
    sources = docs.select(F.concat(F.lit("doc-"), "doc_id").alias("source_id"), F.col("lang").alias("jurisdiction_id"), none.alias("states"))
    r = A.analyse(cases, citations, sources)
    joined = lambda c: F.array_join(c, "|")
    return r.select(
        "id", "status", "decision", F.round("confidence", 6).alias("confidence"), F.round("compliance.confidence", 6).alias("reply_confidence"), joined("compliance.citation_chunk_ids").alias("chunks"), F.size("cited").cast("long").alias("n_cited"), "valid", "coverage",
        joined("invalid_ids").alias("invalid_ids"), F.size("claims").cast("long").alias("n_claims"), joined("follow_up_questions").alias("follow_up"), joined("warnings").alias("warnings"), joined("checklist.permits").alias("permits"), joined(F.transform("stages", lambda s: s["status"])).alias("stages"),
    )


def w13_follow_ups(spark, d):
    """Each user's events as questions, in the words of their kind; what asks the same stands once."""
    kind = F.col("event_type")
    said = F.when(kind == "signup", "Please  provide operating hours").when(kind == "purchase", F.concat(F.lit(" When are the HOURS on "), F.to_date("ts").cast("string"), F.lit("?"))).when(kind == "view", "Please provide parking")
    said = said.when(kind == "click", F.concat(F.lit("Enough parking for event "), "event_id", F.lit("?"))).otherwise(F.concat(F.lit("What about\n"), kind))
    return asked_once(table(spark, d, "events").select("user_id", "event_id", said.alias("said")), "user_id", "event_id", "said")


QUERIES = {f.__name__: f for f in (c16_analysis, w13_follow_ups)}


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = {
    "w13_follow_ups": """
with q as (select user_id, event_id, event_type in ('signup', 'view') as generic, case event_type when 'signup' then 'Please provide operating hours' when 'purchase' then 'When are the HOURS on ' || ts::date || '?' when 'view' then 'Please provide parking' when 'click' then 'Enough parking for event ' || event_id || '?'
  else 'What about ' || event_type end as q, case event_type when 'signup' then 'h' when 'purchase' then 'h' when 'view' then 'p' when 'click' then 'p' else event_type end as k from events)
select user_id, min(event_id) as place, coalesce(arg_min(q, event_id) filter (not generic), arg_min(q, event_id)) as question from q group by user_id, k
""",
    "c16_analysis": f"""
with t as (select conv_id, turn, role, coalesce(text, '') as t, conv_id || '-' || turn as id from conversations),
docs as (select doc_id, lang, toxic from documents left join labels using (doc_id)),
u as (select t.*, lower(t) as lo, coalesce(lang, 'en') as j, coalesce(toxic, 0) <> 0 as off, case when contains(t, ',') then 'R-1' else 'unknown' end as district, length(t) % 2 = 1 as replied from t left join docs on conv_id = doc_id where role = 'user'),
v as (select u.*, case when turn >= 2 then [] else list_filter([case when len(regexp_extract_all(t, '\\S+')) < 8 then 'project scope and intended use' end, case when not contains(lo, 'hours') then 'operating hours' end, case when not contains(lo, 'employees') then 'number of employees' end,
  case when not contains(lo, 'renovation') and not contains(lo, 'construction') then 'construction scope' end], lambda x: x is not null) end as missing from u),
c as (select v.id, o.turn as place, 'c' || o.turn as chunk, 'doc-' || length(o.t) as source, doc_id is null as absent, coalesce(lang not in (v.j, 'en'), true) as elsewhere, not o.t like '%.' as undated from v join t o on v.conv_id = o.conv_id and v.turn <> o.turn left join docs on doc_id = length(o.t)),
firsts as (select id, source, min(place) as place, bool_or(absent)::int + bool_or(elsewhere)::int as n from c where absent or elsewhere group by all),
bad as (select id, string_agg(source, '|' order by place) as invalid, sum(n)::bigint as n from firsts group by 1),
g as (select id, count(*) as n, list(chunk order by place) as chunks, coalesce(list(source || ' is missing an effective date.' order by place) filter (undated), []) as undated from c group by 1),
w as (select v.*, case when off then 0 else coalesce(g.n, 0) end as n, chunks, undated, invalid, bad.n as n_bad, case when off or g.n is null then 'none' when replied then 'model' else 'rules' end as way from v left join g using (id) left join bad using (id)),
x as (select *, case when off then 0.3::double else greatest(0.1, least(0.98, 0.82 - least(0.35, 0.07 * len(missing)) + least(0.15, 0.05 * n) - case when n = 0 then 0.28 else 0 end))::double end as confidence, way = 'model' and not list_contains(chunks, 'c1') as bare from w),
y as (select *, confidence < 0.6 or n = 0 or district = 'unknown' as low from x)
select id, case when off then 'low_confidence' when len(missing) > 0 then 'needs_clarification' when low then 'low_confidence' else 'success' end as status,
  case way when 'none' then 'unknown' when 'model' then 'restricted' else case when district = 'unknown' then 'unknown' when contains(lo, 'bakery') and contains(lo, 'garage') then 'conditional' else 'likely_allowed' end end as decision,
  round(confidence, 6) as confidence, (case way when 'none' then 0.3 when 'rules' then 0.5 else case when bare then 0.3 else 0.8 end end)::double as reply_confidence,
  case way when 'none' then '' when 'rules' then array_to_string(chunks, '|') else case when bare then '' else 'c1' end end as chunks, n::bigint as n_cited, n > 0 and invalid is null as valid, (case when n > 0 and invalid is null then 1 else 0 end)::double as coverage,
  case when off then '' else coalesce(invalid, '') end as invalid_ids, case when off or n = 0 then 1 else coalesce(n_bad, 0) end::bigint as n_claims,
  case when off then {_sql(A.CONTACT_FOR)} else array_to_string(list_concat(case when way = 'model' then ['What are the hours?'] else [] end, list_transform(list_filter(missing, lambda m: way <> 'model' or m <> 'operating hours'), lambda m: 'Please provide ' || m)), '|') end as follow_up,
  case when off then j || ' is not currently supported.|' || {_sql(A.CONTACT)} || '|' || {_sql(A.NO_CITATIONS)} else array_to_string(list_concat(
    case way when 'none' then [{_sql(A.NO_CITATIONS)}, {_sql(A.NO_ORDINANCES)}] when 'rules' then ['model analysis fallback engaged: no reply'] else case when bare then ['Invalid citation IDs were removed: c1, zz', 'Confidence capped because no valid citation IDs were supplied.'] else ['Invalid citation IDs were removed: zz'] end end,
    coalesce(undated, []), case when low then [{_sql(A.LOW[0])}, {_sql(A.LOW[1])}] else [] end), '|') end as warnings,
  case when n > 0 then {_sql('|'.join(A.WITH[1]))} else {_sql('|'.join(A.WITHOUT[1]))} end as permits,
  array_to_string([case when not off and len(missing) > 0 then 'needs_clarification' else 'completed' end, case when district = 'unknown' then 'warning' else 'completed' end, case when off then 'skipped' when n > 0 then 'completed' else 'warning' end,
    case when off then 'skipped' when len(missing) > 0 then 'needs_clarification' when low then 'warning' else 'completed' end, 'completed'], '|') as stages from y
""",
}
