"""Queries of counts, orders, summaries and first-match rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import filter_csv
from quarry.operators import relational as R
from quarry.operators import sequences as S
from quarry.sources.tables import table

_COUNTED = ("documents", "pages", "embeddings", "conversations", "labels")


def a01_counts(spark, d):
    one = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in _COUNTED]
    out = one[0]
    for x in one[1:]:
        out = out.unionAll(x)
    return out


def a04_request_counts(spark, d):
    """Pages as requests of a place: their host is its id, the first part of the path its name; those of the commonest scheme have no id."""
    url = F.col("url")
    rows = table(spark, d, "pages").select("page_id", F.when(~F.startswith(url, F.lit("http://")), F.regexp_extract(url, "^https://([^/]*)", 1)).alias("place"), F.regexp_extract(url, "^[a-z]+://[^/]*/([^/?#]*)", 1).alias("name"))
    return R.request_counts(rows, "page_id", "place", "name")


def a19_index_status(spark, d):
    """Documents as sources, those with labels as indexed (toxic ones under another hash), events as the audit log."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "lang", F.col("source").alias("origin"))
    chunks = table(spark, d, "labels").join(t, F.col("doc_id") == F.col("source")).select("source", F.when(F.col("toxic") == 1, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    kind = F.when(F.col("event_type") == "signup", "source.import.completed").when(F.col("event_type") == "purchase", "source.reindex.completed").otherwise(F.col("event_type"))
    return R.index_status(t, chunks, table(spark, d, "events").select(kind.alias("kind"), F.col("ts").cast("string").alias("at")), table(spark, d, "embeddings").select("vec_id"))


def o01_ordered(spark, d):
    """Orders by price, the dearest first, then by key."""
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))


def o08_slices(spark, d):
    """The first three turns of each conversation, as a panel shows them."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", r.alias("place")).where("place <= 3")


def p01_summaries(spark, d):
    """Sources without their texts, in order, past the first 20 of them, 200 at a time: the last page's limit is the report's."""
    return table(spark, d, "documents").drop("text").orderBy("doc_id").offset(20).limit(200)


def x32_filter_csv(spark, d):
    """The types of each user's events as a text to be searched between commas."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return e.select("user_id", filter_csv(F.col("types")).alias("types"), F.contains(filter_csv(F.col("types")), F.lit(",purchase,")).alias("buys"))


def j06_conditions(spark, d):
    """Parts as sections: the brand is their article, the kind of material their division."""
    rules = spark.sql("""select * from values (0, '', '', '', '', array('never'), array('never')), (1, 'brand#1', 'BRUSHED', 'steel', '', array('R1', ' '), array('homes')), (2, '', '', '', 'nickel', array(' C2 '), array()),
      (3, null, 'plated', null, 'brand#2', array('M1'), array('works', 'shops')), (4, 'Brand#3', '', 'copper', '', array(), array('farms')) as t(pos, article_contains, division_contains, title_contains, contains, districts, uses)""")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("title"), F.array(F.lit("Code"), "p_brand", F.get(F.split("p_type", " "), F.lit(1))).alias("breadcrumb"))
    return R.classify(rows, rules, "p_partkey").select("p_partkey", F.array_join("districts", ",").alias("districts"), F.array_join("uses", ",").alias("uses"))


def w09_met_names(spark, d):
    """Names of documents by source and the number of their words' first digit: made names meet those that end so of themselves."""
    t = table(spark, d, "documents")
    words = F.length(F.coalesce("text", F.lit(""))) % 4
    made = S.unique_names(t.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.when(words > 0, F.concat(F.lit("-"), words + 1)).otherwise("")).alias("name")), "name", "doc_id")
    return made.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unique").alias("unique"), F.count_if(~F.startswith("unique", F.col("name"))).alias("strange"))


QUERIES = {f.__name__: f for f in (a01_counts, a04_request_counts, a19_index_status, o01_ordered, o08_slices, p01_summaries, x32_filter_csv, j06_conditions, w09_met_names)}

ORACLE = {
    "a01_counts": " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in _COUNTED),
    "a04_request_counts": """
with r as (select page_id, nullif(case when url not like 'http://%' then regexp_extract(url, '^https://([^/]*)', 1) end, '') as place, nullif(regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1), '') as name from pages)
select page_id, case when place is not null then count(*) over (partition by place) when name is not null then count(*) over (partition by name) else count(*) over () end as n from r
""",
    "a19_index_status": """
with t as (select doc_id, md5(coalesce(text, '')) as h, lang, source from documents), c as (select t.doc_id, case when toxic = 1 then 'old' else h end as hash from labels join t using (doc_id)),
s as (select doc_id, min(hash) as lo, max(hash) as hi from c group by 1)
select (select count(*) from t) as source_count, (select count(*) from c) as chunk_count, (select count(*) from c) > 0 as has_index,
  (select max(ts)::varchar from events where event_type = 'signup') as last_import_at, (select max(ts)::varchar from events where event_type = 'purchase') as last_reindex_at,
  (select count(*) from t where coalesce(lang, '') = '' or coalesce(source, '') = '') as missing_metadata, (select count(*) from embeddings) as vector_count,
  (select count(*) from c) > 0 and (select count(*) from t left join s using (doc_id) where lo is null or lo <> h or hi <> h) = 0 as index_ready
""",
    "o01_ordered": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey",
    "o08_slices": "select * from (select conv_id, turn, role, row_number() over (partition by conv_id order by turn)::int as place from conversations) where place <= 3",
    "p01_summaries": "select doc_id, lang, source, n_chars from documents order by doc_id limit 200 offset 20",
    "x32_filter_csv": "with t as (select user_id, list_sort(list(distinct event_type)) as l from events group by 1) select user_id, ',' || array_to_string(l, ',') || ',' as types, list_contains(l, 'purchase') as buys from t",
    "j06_conditions": """
with p as (select p_partkey, lower(p_brand) as a, lower(split_part(p_type, ' ', 2)) as d, lower(p_type) as t from part),
h as (select p_partkey, case when contains(a, 'brand#1') and contains(d, 'brushed') and contains(t, 'steel') then 1 when contains(a || ' ' || d || ' ' || t, 'nickel') then 2
  when contains(d, 'plated') and contains(a || ' ' || d || ' ' || t, 'brand#2') then 3 when contains(a, 'brand#3') and contains(t, 'copper') then 4 else 0 end as r from p)
select p_partkey, case r when 1 then 'R1' when 2 then 'C2' when 3 then 'M1' else 'unknown' end as districts, case r when 1 then 'homes' when 3 then 'works,shops' when 4 then 'farms' else 'general' end as uses from h
""",
    "w09_met_names": "select count(*) as n, count(*) as unique, 0::bigint as strange from documents",
}
