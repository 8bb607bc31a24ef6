"""Queries of the index's filters (orders are chunks of their customer's nation, each segment of each nation asks) and of stale sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import index_filter as I
from quarry.sources import scans as C
from quarry.sources.tables import table


def _given(spark, d):
    """Orders of the first priority are for all places of a region, those of the second belong to the region, others to a nation. Segments ask
    with a source, a type, a use, or without a place."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    first, bar, segment = F.substring("o_orderpriority", 1, 1), F.lit("|"), F.col("c_mktsegment")
    chunks = o.select(
        F.col("o_orderkey").alias("chunk_id"), F.when(first == "1", "*").when(first == "2", F.col("r_name")).otherwise(F.col("n_name")).alias("jurisdiction_id"),
        F.when(first == "1", F.col("r_name")).alias("state"), F.when(F.col("o_orderstatus") == "O", F.array(F.lower("n_name"))).alias("states"),
        F.col("o_orderpriority").alias("source_type"), F.col("c_name").alias("source_id"), F.year("o_orderdate").cast("string").alias("source_version"),
        F.when(F.col("c_acctbal") < 0, "|unknown|").when(F.col("c_acctbal") > 9000, F.concat(F.lit("|*|"), segment, bar)).otherwise(F.concat(bar, segment, bar)).alias("districts"),
        F.concat(F.array("o_orderstatus"), F.when(F.col("o_totalprice") > 200000, F.array(F.lit("principal_uses"))).when(F.col("o_totalprice") < 20000, F.array(F.lit("general"))).otherwise(F.array())).alias("uses"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("effective_date"),
    )
    asked = o.groupBy("n_name", "r_name", "c_mktsegment").agg(F.max("o_orderpriority").alias("top"), F.max("c_name").alias("who"), F.max(F.year("o_orderdate")).cast("string").alias("year"), F.date_format(F.date_sub(F.max("o_orderdate").cast("date"), 400), "yyyy-MM-dd").alias("limit"))
    requests = asked.select(
        F.concat_ws("/", "n_name", "c_mktsegment").alias("qid"), F.when(segment != "MACHINERY", F.col("n_name")).alias("jurisdiction_id"), F.col("r_name").alias("parent"), F.col("r_name").alias("state"),
        F.when(segment == "MACHINERY", F.col("who")).alias("source_id"), F.when(segment == "BUILDING", F.col("top")).otherwise("").alias("source_type"), F.when(segment == "AUTOMOBILE", F.col("year")).alias("source_version"),
        F.when(segment == "FURNITURE", "unknown").when(segment == "AUTOMOBILE", "*").otherwise(segment).alias("district"), F.when(segment == "HOUSEHOLD", "general").otherwise("F").alias("use"), F.when(segment != "BUILDING", F.col("limit")).alias("effective_on_or_before"),
    )
    return requests, chunks


def p06_index_filter(spark, d):
    return I.matches(*_given(spark, d))


def a23_stale_refs(spark, d):
    """Orders as sources of their customer's name in the file of their priority: of one name in one file the first order counts."""
    o, day = table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd")
    refs = o.select(
        F.concat(F.lit("s"), "o_custkey").alias("source_id"), F.when(F.col("o_totalprice") < 30000, "local://x").otherwise("https://x.gov").alias("url"),
        F.when(F.col("o_orderstatus") == "O", F.concat(day, F.lit("T08:00:00Z"))).when(F.col("o_orderstatus") == "F", F.regexp_replace(day, "-", "")).alias("retrieved_at"),
        F.when(F.col("o_totalprice") > 150000, C.PUBLIC).otherwise("draft").alias("coverage_status"), F.col("o_orderpriority").alias("origin"), F.col("o_orderkey").alias("place"),
    )
    return C.stale_refs(refs, "1998-01-01", 700)


QUERIES = {"p06_index_filter": p06_index_filter, "a23_stale_refs": a23_stale_refs}

ORACLE = {
    "p06_index_filter": """
with o as (select * from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
c as (select o_orderkey as chunk_id, case o_orderpriority[1] when '1' then '*' when '2' then r_name else n_name end as j, case when o_orderpriority[1] = '1' then r_name end as state, o_orderpriority as stype, c_name as sid, year(o_orderdate)::varchar as sver,
  case when c_acctbal < 0 then ['unknown'] when c_acctbal > 9000 then ['*', c_mktsegment] else [c_mktsegment] end as districts,
  case when o_totalprice > 200000 then [o_orderstatus, 'principal_uses'] when o_totalprice < 20000 then [o_orderstatus, 'general'] else [o_orderstatus] end as uses,
  case when o_orderstatus <> 'P' then strftime(o_orderdate, '%Y-%m-%d') end as effective from o),
r as (select n_name, r_name, c_mktsegment as seg, n_name || '/' || c_mktsegment as qid, max(o_orderpriority) as top, max(c_name) as who, max(year(o_orderdate))::varchar as y, strftime(max(o_orderdate)::date - 400, '%Y-%m-%d') as lim from o group by all)
select qid, chunk_id, (seg = 'FURNITURE' or list_has_any(districts, [case when seg = 'AUTOMOBILE' then '*' else seg end, '*', 'unknown']))
    and list_has_any(uses, [case when seg = 'HOUSEHOLD' then 'general' else 'F' end, 'general', 'principal_uses']) and (seg = 'BUILDING' or effective is null or effective <= lim) as fits
from r join c on (seg = 'MACHINERY' or j = n_name or j = r_name or (j = '*' and state = r_name))
where (seg <> 'MACHINERY' or sid = who) and (seg <> 'BUILDING' or stype = top) and (seg <> 'AUTOMOBILE' or sver = y)
  and (seg in ('FURNITURE', 'AUTOMOBILE') or list_has_any(districts, [seg, 'unknown'])) and (seg = 'HOUSEHOLD' or list_has_any(uses, ['F', 'general', 'principal_uses']))
""",
    "a23_stale_refs": """
with first as (select * from orders qualify row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) = 1),
r as (select o_orderpriority as origin, 's' || o_custkey as source_id, o_totalprice >= 30000 as web, case when o_totalprice >= 30000 and o_orderstatus in ('O', 'F') then date_diff('day', o_orderdate::date, date '1998-01-01') end::int as age, case when o_totalprice > 150000 then 'error' else 'warning' end as level from first)
select origin, source_id, case when not web then 'url' when age is null then 'undated' else 'old' end as issue, age, level from r where not web or age is null or age > 700
""",
}
