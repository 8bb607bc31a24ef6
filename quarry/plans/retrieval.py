"""Queries of retrieval: benchmark items are requests, documents are chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.sources.tables import requests, sources, table


def _given(spark, d):
    s = sources(table(spark, d, "documents"))
    chunks = s.select(F.col("source_id").alias("chunk_id"), "jurisdiction_id", "section_ref", "districts", "uses", F.col("full_text").alias("text"))
    return requests(table(spark, d, "benchmark")), chunks


def p04_tag_filter(spark, d):
    _, c = _given(spark, d)
    keep = R.tag_filter(F.lit("d1"), F.lit("u1"), F.col("districts"), F.col("uses"))
    wide = R.tag_filter(F.lit("d1"), F.lit("u1"), F.col("districts"), F.col("uses"), strict=False)
    return c.where(wide).select("chunk_id", keep.alias("strict"))


def x48_scores(spark, d):
    return R.candidates(*_given(spark, d)).select("qid", "chunk_id", F.round("score", 6).alias("score"))


def o05_ranked(spark, d):
    return R.rank(R.candidates(*_given(spark, d))).where("rank <= 20").select("qid", "rank", "chunk_id")


def w01_diversified(spark, d):
    return R.pick(R.candidates(*_given(spark, d))).select("qid", "slot", "chunk_id")


def w02_marker_reserve(spark, d):
    return R.pick(R.candidates(*_given(spark, d)), marked=R.MARKED[:1]).select("qid", "slot", "chunk_id")


def w04_measure_reserve(spark, d):
    q, c = _given(spark, d)
    q = q.withColumn("description", F.when(F.col("qid") % 2 == 0, F.concat("description", F.lit(" What is the minimum LOT AREA here?"))).otherwise(F.col("description")))
    n = F.substring("chunk_id", 5, 20).cast("long")
    c = c.withColumn("text", F.when(n % 5 == 0, F.concat("text", F.lit(" Lot area 12,000 square feet."))).when(n % 5 == 1, F.concat("text", F.lit(" Height 35 feet."))).otherwise(F.col("text")))
    return R.pick(R.candidates(q, c), measures=2).select("qid", "slot", "chunk_id")


def retrieve_requests(spark, d):
    return R.retrieve(*_given(spark, d)).select("qid", "slot", "chunk_id", F.round("score", 6).alias("score"))


def c03_cosine_retrieve(spark, d):
    return R.retrieve(*_given(spark, d), cosine=True).select("qid", "slot", "chunk_id", F.round("score", 6).alias("score"))


def c02_hybrid_retrieve(spark, d):
    return R.hybrid_retrieve(*_given(spark, d)).select("qid", "slot", "chunk_id", F.round("score", 6).alias("score"))


def p07_vector_hits(spark, d):
    return R.vector_hits(*_given(spark, d)).select("qid", "kind", "rank", "chunk_id", F.round("score", 6).alias("score"))


def c04_registry_retrieve(spark, d):
    return R.registry_retrieve(*_given(spark, d))


def o04_cosine_top(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("v").alias("q"))
    return R.cosine_top(q, e, 10).select("qid", "rank", "vec_id", F.round("score", 6).alias("score"))


def u01_merged_hits(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label", F.col("v").alias("q"))
    a, b = R.cosine_top(q, e, 20).drop("rank"), R.cosine_top(q, e.where("vec_id % 2 = 0"), 10).drop("rank")
    return R.merge_hits(a, b).select("qid", "vec_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (p04_tag_filter, x48_scores, o05_ranked, w01_diversified, w02_marker_reserve, w04_measure_reserve, retrieve_requests, c03_cosine_retrieve, c02_hybrid_retrieve, p07_vector_hits, c04_registry_retrieve, o04_cosine_top, u01_merged_hits)}

_BASE = """
with c as (select 'doc-' || doc_id as chunk_id, doc_id, case when doc_id % 11 = 0 then '*' else lang end as j, case when doc_id % 13 = 0 then '' else source end as section_ref,
  case when doc_id % 7 = 0 then ['*'] when doc_id % 7 = 1 then ['unknown'] else ['d' || (doc_id % 5)] end as districts,
  case when doc_id % 6 = 0 then ['general'] when doc_id % 6 = 1 then ['principal_uses', 'u' || (doc_id % 3)] else ['u' || (doc_id % 3)] end as uses, {text} as text from documents),
q as (select item_id as qid, (['en', 'fr', 'de', 'es'])[item_id % 4 + 1] as j, case when item_id % 6 = 5 then 'unknown' else 'd' || (item_id % 5) end as district, 'u' || (item_id % 3) as use, {description} as description from benchmark),
qt as (select *, trim(regexp_replace(use || ' ' || district || ' ' || description, '\\s+', ' ', 'g')) as query from q),
qk as (select *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) as qtok from qt),
ck as (select *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as ctok from c),
met as (select qid, query, chunk_id, section_ref, uses, text, case when district = 'unknown' then 1.0::double when list_contains(districts, district) or list_contains(districts, '*') then 2.0 when list_contains(districts, 'unknown') then 1.2 else 0.0 end
   + case when list_contains(uses, use) or list_contains(uses, 'general') then 2.0::double else 0.0 end + len(list_intersect(qtok, ctok))::double / greatest(1, len(qtok)) as score
  from ck join qk on (ck.j = qk.j or ck.j = '*') where (district = 'unknown' or list_has_any(districts, [district, '*', 'unknown'])) and list_has_any(uses, [use, 'general'])),
ranked as (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from met where score > 0),
sec as (select *, row_number() over (partition by qid, case when section_ref = '' then chunk_id else section_ref end order by rank) as n from ranked),
top8 as (select * exclude (n), row_number() over (partition by qid order by rank) as slot from sec where n <= 2 qualify slot <= 8)
"""
_PLAINLY = _BASE.format(text="text", description="text")
_MARKED = """, held as (select qid, count(*) filter (list_contains(uses, 'principal_uses')) as have, max(slot) as last from top8 group by qid),
more as (select r.qid, r.chunk_id, r.score, r.text, r.query, r.rank, row_number() over (partition by r.qid order by r.rank) as i, have, last from ranked r join held using (qid) where list_contains(r.uses, 'principal_uses') and not exists (select 1 from top8 t where t.qid = r.qid and t.chunk_id = r.chunk_id)),
marked as (select qid, slot, chunk_id, score from top8 union all select qid, last + i, chunk_id, score from more where i <= 2 - have)
"""
_VECTOR = """list_transform(range(64), lambda i: coalesce({cells}[i::int], 0))"""
#: Hashing embeddings: tokens in cells, summed per text, at length 1.
_EMBEDDED = """, tk as (select 'c' as s, chunk_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from c union all select 'q', qid::varchar, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) from qt
  union all select 'p', '1', unnest(regexp_extract_all(lower('{permit}'), '[a-z0-9]+')) union all select 'p', '2', unnest(regexp_extract_all(lower('{district}'), '[a-z0-9]+'))),
hh as (select s, id, sha256(token) as h from tk), cells as (select s, id, ('0x' || substr(h, 1, 4))::int % 64 as cell, sum(case when ('0x' || substr(h, 5, 2))::int % 2 = 0 then 1 else -1 end)::double as v from hh group by all),
lens as (select s, id, sqrt(sum(v * v)) as len from cells group by all), ev as (select c.s, c.id, cell, case when len > 0 then v / len else 0 end as v from cells c join lens l on c.s = l.s and c.id = l.id)
""".format(permit=R.PERMIT_QUERY, district=R.DISTRICT_QUERY)
_DOTS = "(select a.id as a, b.id as b, sum(a.v * b.v) as dot from ev a join ev b on a.cell = b.cell and a.s = '{s}' and b.s = 'c' group by a.id, b.id)"
_PICKED = """, {ranked},
sec as (select *, row_number() over (partition by qid, case when section_ref = '' then chunk_id else section_ref end order by rank) as n from ranked),
top8 as (select * exclude (n), row_number() over (partition by qid order by rank) as slot from sec where n <= 2 qualify slot <= 8)
"""
_WITH_MEASURES = _BASE.format(text="text || case when doc_id % 5 = 0 then ' Lot area 12,000 square feet.' when doc_id % 5 = 1 then ' Height 35 feet.' else '' end", description="text || case when item_id % 2 = 0 then ' What is the minimum LOT AREA here?' else '' end")

ORACLE = {
    "p04_tag_filter": _PLAINLY + "select chunk_id, list_has_any(uses, ['u1', 'general']) as strict from c where list_has_any(districts, ['d1', '*', 'unknown']) and list_has_any(uses, ['u1', 'general', 'principal_uses'])",
    "x48_scores": _PLAINLY + "select qid, chunk_id, round(score, 6) as score from met",
    "o05_ranked": _PLAINLY + "select qid, rank::int as rank, chunk_id from ranked where rank <= 20",
    "w01_diversified": _PLAINLY + "select qid, slot::int as slot, chunk_id from top8",
    "w02_marker_reserve": _PLAINLY + _MARKED + "select qid, slot::int as slot, chunk_id from marked",
    "w04_measure_reserve": _WITH_MEASURES + ", more as (select r.qid, r.chunk_id, row_number() over (partition by r.qid order by case when contains(lower(r.text), 'lot area') then 0 else 1 end, r.rank) as i from ranked r where r.qid % 2 = 0 and regexp_matches(r.text, '(?i)[0-9][0-9,]*\\s*\\)?[.,]?\\s*(square\\s+feet|feet\\b)') and not exists (select 1 from top8 t where t.qid = r.qid and t.chunk_id = r.chunk_id)), l as (select qid, max(slot) as last from top8 group by qid) select qid, slot::int as slot, chunk_id from top8 union all select qid, (last + i)::int, chunk_id from more join l using (qid) where i <= 2",
    "retrieve_requests": _PLAINLY + _MARKED + "select qid, slot::int as slot, chunk_id, round(score, 6) as score from marked",
    "c03_cosine_retrieve": _BASE.format(text="text", description="text").split("ranked as (")[0].rstrip().rstrip(",") + _EMBEDDED + ", near as " + _DOTS.format(s="q") + ", met2 as (select met.* replace (met.score + coalesce(dot, 0) as score) from met left join near on a = qid::varchar and b = chunk_id)"
    + _PICKED.format(ranked="ranked as (select *, row_number() over (partition by qid order by round(score, 9) desc, chunk_id) as rank from met2 where score > 0)") + _MARKED + "select qid, slot::int as slot, chunk_id, round(score, 6) as score from marked",
    "p07_vector_hits": _BASE.format(text="text", description="text").split("met as (")[0].rstrip().rstrip(",") + _EMBEDDED + ", near as (select a as qid, b, 0 as kind, dot from " + _DOTS.format(s="q") + " union all select q.qid::varchar, d.b, d.a::int, dot from q, " + _DOTS.format(s="p") + """ d),
pairs as (select qk.qid, ck.chunk_id, (district = 'unknown' or list_has_any(districts, [district, '*', 'unknown'])) as fits from ck join qk on (ck.j = qk.j or ck.j = '*') where (district = 'unknown' or list_has_any(districts, [district, 'unknown'])) and list_has_any(uses, [use, 'general', 'principal_uses'])),
kinds as (select pairs.*, k.kind, coalesce(dot, 0) as score from pairs cross join (values (0, 20), (1, 10), (2, 6)) k(kind, lim) left join near on near.qid = pairs.qid::varchar and near.b = chunk_id and near.kind = k.kind),
lists as (select *, row_number() over (partition by qid, kind order by round(score, 9) desc, chunk_id) as n from kinds qualify n <= case kind when 0 then 40 when 1 then 20 else 12 end)
select qid, kind, row_number() over (partition by qid, kind order by round(score, 9) desc, chunk_id)::int as rank, chunk_id, round(score, 6) as score from lists where fits qualify rank <= case kind when 0 then 20 when 1 then 10 else 6 end""",
    "c04_registry_retrieve": _PLAINLY + "select qid, row_number() over (partition by qid order by chunk_id)::int as slot, chunk_id, 1.0::double as score from met qualify slot <= 5",
    "o04_cosine_top": "with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select q.vec_id as qid, e.vec_id, list_inner_product(e.v, q.v) as s from e join e q on e.label = q.label and e.vec_id <> q.vec_id and q.vec_id % 50 = 0) select qid, row_number() over (partition by qid order by round(s, 9) desc, vec_id)::int as rank, vec_id, round(s, 6) as score from p qualify rank <= 10",
    "u01_merged_hits": "with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select q.vec_id as qid, e.vec_id, list_inner_product(e.v, q.v) as s from e join e q on e.label = q.label and e.vec_id <> q.vec_id and q.vec_id % 50 = 0), a as (select * from p qualify row_number() over (partition by qid order by round(s, 9) desc, vec_id) <= 20), b as (select * from p where vec_id % 2 = 0 qualify row_number() over (partition by qid order by round(s, 9) desc, vec_id) <= 10) select qid, vec_id, round(max(s), 6) as score from (select * from a union all select * from b) group by qid, vec_id",
}
