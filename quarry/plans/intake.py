"""Queries of intake, address, parcel, compliance and usage: customers and nations stand for requests and jurisdictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import pages as G
from quarry.functions import text as X
from quarry.operators import intake as I
from quarry.operators import pack_check as P
from quarry.sources import stores as S
from quarry.sources.tables import table


def _places(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey)


def _jurisdictions(spark, d):
    k = F.col("n_nationkey")
    status = F.when(k % 3 == 0, "public_supported").when(k % 3 == 1, "source_indexed").otherwise("unsupported")
    strategy = F.when(k % 4 == 0, "county").when(k % 4 == 1, "locality_and_county").otherwise("locality")
    return _places(spark, d).select(
        k.cast("int").alias("position"), F.lower("n_name").alias("jurisdiction_id"), F.col("n_name").alias("name"), status.alias("coverage_status"), strategy.alias("match_strategy"),
        F.array("n_name").alias("localities"), F.array(F.concat("n_name", F.lit(" County"))).alias("counties"), F.array("r_name").alias("states"),
    )


def _requests(spark, d):
    c, k = table(spark, d, "customer").join(_places(spark, d), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey")
    part = lambda kind, name, short: F.struct(F.array(F.lit(kind)).alias("types"), name.alias("long_name"), short.alias("short_name"))
    state = part("administrative_area_level_1", F.col("r_name"), F.upper(F.substring("r_name", 1, 2)))
    components = F.when(k % 10 == 2, F.array(part("locality", F.col("n_name"), F.col("n_name")), state)).when(k % 10 == 3, F.array(part("administrative_area_level_2", F.concat("n_name", F.lit(" County")), F.lit("")), state)).when(k % 10 == 4, F.array(part("locality", F.lit("Else Where"), F.lit("")), state, part("country", F.lit("United States"), F.lit("US"))))
    address = F.concat(k.cast("string"), F.lit(" "), "c_mktsegment", F.lit(" Street, "), F.lower("n_name"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(", "), "r_name")))
    explicit = F.when(k % 10 == 0, F.lower("n_name")).when(k % 10 == 1, "nowhere").otherwise("")
    return c.select(k.alias("qid"), address.alias("address"), F.when(k % 2 == 0, 10.0 + k % 7).alias("lat"), F.when(k % 2 == 0, 20.0 + k % 11).alias("lng"), explicit.alias("explicit_id"), components.alias("components"))


def j16_resolve(spark, d):
    return I.resolve(_requests(spark, d), _jurisdictions(spark, d)).select("qid", "jurisdiction_id", "jurisdiction_name", "coverage_status", "method", "jurisdiction_confidence")


def j11_parcels_at(spark, d):
    """Events as points over squares and triangles."""
    points = table(spark, d, "events").select(F.col("event_id").alias("qid"), F.lit("a").alias("jurisdiction_id"), (F.col("value") % 10).alias("lat"), ((F.col("value") * 7) % 10).alias("lng"))
    n = table(spark, d, "part").where("p_partkey < 25").select(F.col("p_partkey").alias("k"))
    x, y = 2.0 * (F.col("k") % 5), 2.0 * F.floor(F.col("k") / 5)
    p = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.when(F.col("k") % 2 == 0, F.array(p(0, 0), p(1.5, 0), p(1.5, 1.5), p(0, 1.5))).otherwise(F.array(p(0, 0), p(2, 0), p(0, 2)))
    parcels = n.select(F.col("k").cast("string").alias("parcel_id"), F.lit("a").alias("jurisdiction_id"), F.concat(F.lit("R-"), F.col("k") % 3).alias("zoning_code"), ring.alias("ring"))
    return I.parcels_at(points, parcels, 1.0).where("parcel_id is not null").select("qid", "parcel_id", "zoning_code")


def c10_intake(spark, d):
    t = table(spark, d, "conversations")
    word = F.get(F.array(*map(F.lit, ("", " Open a COFFEE bar with parking", " bakery in my garage, convert it", " build an addition, hours 9 to 5", " restaurant interior renovation, employees: 4, hours late", " a sign for the shop"))), ((F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    x = I.intake(F.concat(F.coalesce("text", F.lit("")), word))
    return t.select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", "x.inferred_use", "x.use_type", "x.construction_scope", "x.business_activity", F.size("x.missing_details").alias("missing"), "x.confidence")


def c16_status(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    confidence = I.capped(F.coalesce(F.col("n"), F.lit(0)) / 7, F.col("o_orderstatus") != "P")
    missing = F.when(F.col("o_orderpriority").startswith("1"), F.coalesce("r", F.lit(0))).otherwise(0)
    district = I.analysed_district(F.col("o_orderpriority"), F.when(F.col("r") > 2, "keyword_fallback").otherwise("fixture"), confidence)
    return o.select("o_orderkey", I.status(confidence, F.coalesce("n", F.lit(0)), missing, district).alias("status"), district.alias("district"))


def a02_usage_since(spark, d):
    usage = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.col("ts").alias("at"))
    return I.usage_since(usage, F.lit("2024-01-10").cast("timestamp_ntz"), ("user",))


def a18_limits(spark, d):
    usage = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), F.col("ts").alias("at"))
    return I.within_limits(usage, {"click": 3, "error": 1}, F.lit("2024-01-03").cast("date"))


def a21_first_last(spark, d):
    return I.first_and_last(table(spark, d, "events"), "user_id", "event_type", "event_id")


def u06_append_new(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return I.append_new(e.where("vec_id % 3 > 0"), e.where("vec_id % 2 = 0").unionAll(e.where("vec_id % 4 = 0")), "vec_id")


def j15_eligible(spark, d):
    j = _jurisdictions(spark, d).select("jurisdiction_id", "coverage_status", F.when(F.col("position") % 5 > 0, F.array("name")).alias("contacts"), F.when(F.col("position") % 7 > 0, F.array("name")).alias("urls"))
    s = table(spark, d, "supplier").join(_places(spark, d), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("source_id"), F.lower("n_name").alias("jurisdiction_id"), F.when(F.col("s_acctbal") > -500, F.col("s_name")).alias("url"), F.when(F.col("s_acctbal") < 9500, F.col("s_name")).alias("effective_date"))
    c = table(spark, d, "part").select(F.col("p_size").cast("string").alias("source_id"))
    g = table(spark, d, "customer").where("c_acctbal > 9000").join(_places(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("jurisdiction_id"), (F.col("c_mktsegment") != "FURNITURE").alias("supported"), F.floor(F.col("c_acctbal") % 2).alias("min_citations"))
    return I.eligible(j, s, c, g).select("jurisdiction_id", "eligible", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def _packs(spark, d):
    s = table(spark, d, "supplier").join(_places(spark, d), F.col("s_nationkey") == F.col("n_nationkey"))
    b = F.col("s_acctbal")
    own = F.lower("n_name")
    url = F.when(b < 0, "local://x").when(b < 1000, "https://todo.gov").when(b < 2000, "https://www.example.org/x").otherwise(F.concat(F.lit("https://city.gov/"), "s_suppkey"))
    place = F.when(b.between(2000, 3000), "*").when(b.between(3000, 4000), "elsewhere").otherwise(own)
    laws = F.struct(F.lit(None).cast("boolean").alias("curated_local_fallback"), F.lit(None).cast("string").alias("fallback_reason"), F.array(F.when(b < 2500, F.upper(F.substring("r_name", 1, 2))).otherwise("??")).alias("applies_to_states"))
    one = F.struct(
        F.concat(F.lit("id-"), F.floor(b / 20)).alias("source_id"), F.when(b < 9000, F.col("s_name")).alias("title"), F.when(b < 8500, "1").otherwise(" ").alias("section_ref"), place.alias("jurisdiction_id"), url.alias("url"), F.lit("2024").alias("effective_date"),
        F.when(b > 2800, "zoning_map").otherwise("state_law").alias("source_type"), F.array(F.when(b.between(5000, 6000), "Unknown").otherwise("r1")).alias("districts"), F.array(F.when(b > 9500, "").otherwise("general")).alias("uses"), F.lit("x").alias("excerpt"), F.lit("").alias("full_text"), laws.alias("metadata"),
    )
    j = F.struct(own.alias("jurisdiction_id"), F.col("n_name").alias("name"), F.lit("qa_ready").alias("coverage_status"), F.lower(F.substring("r_name", 1, 2)).alias("state"), *[F.lit("1").alias(c) for c in ("state_fips", "county_fips", "place_fips")], F.lit("county").alias("jurisdiction_type"), F.lit("up").alias("parent_jurisdiction_id"), F.array(F.lit("https://a.gov")).alias("official_source_urls"), F.lit("").alias("zoning_map_url"), F.struct(F.lit("https://a.gov").alias("url"), F.lit("").alias("email"), F.lit("").alias("phone")).alias("planning_contact"))
    grouped = s.groupBy("n_name", "r_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", one.alias("s")))).alias("xs"))
    return grouped.select(F.col("n_name").alias("path"), F.lit("1.0").alias("schema_version"), F.lit("ok").alias("verification_notes"), j.alias("jurisdiction"), F.transform("xs", lambda x: x["s"]).alias("sources"))


def c21_pack_issues(spark, d):
    return P.pack_issues(_packs(spark, d)).select("path", "place", "severity", "issue")


def a16_pack_counts(spark, d):
    packs = _packs(spark, d)
    return P.pack_summary(packs, P.pack_issues(packs))


def k16_promoted(spark, d):
    packs = _packs(spark, d)
    return P.promoted(packs, P.pack_issues(packs)).select("path", F.col("jurisdiction.coverage_status").alias("status"))


QUERIES = {f.__name__: f for f in (j16_resolve, j11_parcels_at, c10_intake, c16_status, a02_usage_since, a18_limits, a21_first_last, u06_append_new, j15_eligible, c21_pack_issues, a16_pack_counts, k16_promoted)}

_PLACES = """with pl as (select * from nation join region on n_regionkey = r_regionkey),
j as (select n_nationkey as pos, lower(n_name) as id, n_name as name, case n_nationkey % 3 when 0 then 'public_supported' when 1 then 'source_indexed' else 'unsupported' end as status, n_nationkey % 4 as kind, lower(n_name) as loc, lower(n_name) || ' county' as cty, lower(r_name) as st from pl)
"""
_MISSING = "(case when len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < 8 then 1 else 0 end + case when contains(t, 'hours') then 0 else 1 end + case when contains(t, 'employees') then 0 else 1 end + case when contains(t, 'renovation') or contains(t, 'construction') then 0 else 1 end)"
_USAGE = "select event_type as kind, user_id as \"user\", ts as \"at\" from events"

_ISSUES = """with s as (select n_name as path, (row_number() over (partition by n_name order by s_suppkey) - 1)::int as place, s_acctbal as b, left(r_name, 2) as st, 'id-' || floor(s_acctbal / 20)::bigint as id from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
i as (select path, place, 'error' as severity, unnest(list_filter([case when b >= 9000 then 'title: required' end, case when b >= 8500 then 'section_ref: empty' end, case when b < 0 then 'url: scheme' when b < 1000 then 'url: todo' when b < 2000 then 'url: placeholder' end, case when b > 9500 then 'uses: none' end,
  case when b >= 3000 and b <= 4000 and not (b between 2000 and 3000) then 'jurisdiction_id: another''s' end, case when b between 2000 and 3000 and b > 2800 then 'jurisdiction_id: ''*'' is for laws' end, case when b between 2000 and 3000 and b >= 2500 then 'metadata.applies_to_states: not the pack''s' end], lambda x: x is not null)) as issue from s
 union all select path, place, 'warning', 'districts: only unknown' from s where b between 5000 and 6000
 union all select path, place, 'error', 'source_id: repeated' from (select *, row_number() over (partition by id order by path, place) as n from s) where n > 1)
"""

ORACLE = {
    "c21_pack_issues": _ISSUES + "select path, place, severity, issue from i",
    "a16_pack_counts": _ISSUES + "select path, lower(path) as jurisdiction_id, n::int as sources, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings from (select path, count(*) as n from s group by path) left join i using (path) group by all",
    "k16_promoted": _ISSUES + "select distinct path, 'source_indexed' as status from s where path not in (select path from i where severity = 'error')",
    "j16_resolve": _PLACES + """, q as (select c_custkey as qid, c_custkey % 10 as m, n_name, lower(n_name) as nn, lower(r_name) as rr, r_name, lower(c_custkey || ' ' || c_mktsegment || ' Street, ' || lower(n_name) || case when c_custkey % 3 = 0 then '' else ', ' || r_name end) as a from customer join pl on c_nationkey = n_nationkey),
m as (select qid, j.id, j.name, j.status, case
   when q.m = 0 and j.id = nn then 1 when q.m = 2 and j.st = rr and (case when kind = 0 then contains(a, cty) else loc = nn end) then 2
   when q.m = 3 and j.st = rr and (case kind when 0 then cty = nn || ' county' when 1 then contains(a, loc) and cty = nn || ' county' else contains(a, loc) end) then 2
   when q.m = 4 and j.st = rr and kind = 0 and contains(a, cty) then 2
   when q.m not in (0, 1) and (contains(a, loc) or contains(a, cty)) and contains(a, j.st) then 4 end as p, kind, pos from q cross join j),
best as (select * from m where p is not null qualify row_number() over (partition by qid order by p, case when p = 2 and kind = 0 then 1 else 0 end, pos) = 1)
select q.qid, case when q.m = 1 then 'nowhere' when p = 1 or p = 2 then b.id when q.m = 4 then 'us-' || lower(left(r_name, 2)) || '-unknown-county-else-where' when q.m in (2, 3) then 'us-' || lower(left(r_name, 2)) || case q.m when 2 then '-unknown-county-' || trim(regexp_replace(nn, '[^a-z0-9]+', '-', 'g'), '-') else '-' || trim(regexp_replace(nn, '[^a-z0-9]+', '-', 'g'), '-') || '-unincorporated' end else b.id end as jurisdiction_id,
 case when q.m = 1 then 'nowhere' when p in (1, 2) then b.name when q.m = 4 then 'Else Where, ' || upper(left(r_name, 2)) when q.m = 2 then n_name || ', ' || upper(left(r_name, 2)) when q.m = 3 then n_name || ' County, ' || upper(left(r_name, 2)) else b.name end as jurisdiction_name,
 case when q.m = 1 then 'unsupported' when p in (1, 2) then b.status when q.m in (2, 3, 4) then 'unsupported' else b.status end as coverage_status,
 case when q.m in (0, 1) then 'explicit' when q.m in (2, 3, 4) then 'geocode' when p = 4 then 'fixture' when q.qid % 2 = 0 then 'geocode' else 'unknown' end as method,
 case when q.m = 0 then 1.0 when q.m = 1 then 0.7 when q.m in (2, 3, 4) then 0.95 when p = 4 then 0.85 when q.qid % 2 = 0 then 0.2 else 0.0 end::double as jurisdiction_confidence from q left join best b using (qid)""",
    "j11_parcels_at": """with p as (select event_id as qid, value % 10 as lat, (value * 7) % 10 as lng from events), c as (select qid, (floor(lng / 2) + 5 * floor(lat / 2))::int as k, lng - 2 * floor(lng / 2) as dx, lat - 2 * floor(lat / 2) as dy from p)
select qid, k::varchar as parcel_id, 'R-' || (k % 3) as zoning_code from c where k in (select p_partkey from part) and (case when k % 2 = 0 then dx < 1.5 and dy < 1.5 else dx + dy < 2 end)""",
    "c10_intake": "with k as (select conv_id, turn, lower(coalesce(text, '') || (['', ' Open a COFFEE bar with parking', ' bakery in my garage, convert it', ' build an addition, hours 9 to 5', ' restaurant interior renovation, employees: 4, hours late', ' a sign for the shop'])[(conv_id + turn) % 6 + 1]) as t from conversations), u as (select *, " + _MISSING + """ as missing, case when contains(t, 'coffee') or contains(t, 'cafe') or contains(t, 'restaurant') then 'food-service' when contains(t, 'garage') and contains(t, 'bakery') then 'home-based-food-business' when contains(t, 'bakery') then 'food-business' else 'general' end as use from k)
select conv_id, turn, use as inferred_use, case when use = 'general' then 'general' else 'food_service' end as use_type,
 case when contains(t, 'garage') and (contains(t, 'convert') or contains(t, 'conversion')) then 'garage_conversion' when contains(t, 'interior') or contains(t, 'renovation') then 'interior_work' when contains(t, 'addition') or contains(t, 'build') then 'new_construction' end as construction_scope,
 case when contains(t, 'coffee') or contains(t, 'cafe') then 'coffee_shop' when contains(t, 'bakery') then 'bakery' when contains(t, 'restaurant') then 'restaurant' end as business_activity, missing::int as missing, case when missing >= 3 then 'low' when missing > 0 then 'medium' else 'high' end as confidence from u""",
    "c16_status": """with l as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by l_orderkey),
k as (select o.*, coalesce(n, 0) as n, coalesce(r, 0) as r, case when o_orderstatus <> 'P' then coalesce(n, 0) / 7.0::double else greatest(0.1::double, least(coalesce(n, 0) / 7.0::double, 0.55::double)) end as c from orders o left join l on o_orderkey = l_orderkey),
d as (select *, case when r > 2 and c < 0.7 then 'unknown' else o_orderpriority end as district, case when o_orderpriority like '1%' then r else 0 end as missing from k)
select o_orderkey, case when missing > 0 then 'needs_clarification' when c < 0.6 or n = 0 or district = 'unknown' then 'low_confidence' else 'success' end as status, district from d""",
    "a02_usage_since": f"with u as ({_USAGE}) select kind, \"user\", count(*) as n from u where \"at\" >= timestamp '2024-01-10' group by all",
    "a18_limits": f"with u as ({_USAGE}) select \"user\", kind, count(*) as used, greatest(0, case kind when 'click' then 3 else 1 end - count(*))::bigint as \"left\" from u where \"at\"::date = date '2024-01-03' and kind in ('click', 'error') group by \"user\", kind",
    "a21_first_last": "select user_id, arg_min(event_type, event_id) as first, arg_max(event_type, event_id) as last from events group by user_id",
    "u06_append_new": "select vec_id, label from embeddings where vec_id % 3 > 0 or vec_id % 2 = 0",
    "j15_eligible": _PLACES + """, s as (select s_suppkey::varchar as source_id, lower(n_name) as id, list_filter([case when s_acctbal > -500 then null else 'url' end, case when s_acctbal < 9500 then null else 'effective_date' end], lambda x: x is not null) as gaps, s_suppkey in (select p_size from part) as held from supplier join pl on s_nationkey = n_nationkey),
sa as (select id, count(*) as n, count(*) filter (held) as h, array_to_string(list_sort(list('source ' || source_id || ' lacks ' || array_to_string(gaps, ', ')) filter (len(gaps) > 0)), '; ') as lacking from s group by id),
g as (select lower(n_name) as id, count(*) as n, count(*) filter (c_mktsegment <> 'FURNITURE' and floor(c_acctbal % 2) >= 1) as good from customer join pl on c_nationkey = n_nationkey where c_acctbal > 9000 group by 1),
e as (select j.id, array_to_string(list_filter([case when pos % 5 = 0 then 'no planning contact' end, case when pos % 7 = 0 then 'no official source' end, case when status <> 'public_supported' then 'coverage not ready' end, case when coalesce(sa.n, 0) = 0 then 'no local source' end, nullif(lacking, ''),
 case when coalesce(h, 0) = 0 then 'no indexed chunks' end, case when coalesce(g.n, 0) = 0 then 'no golden scenario' when good = 0 then 'no scenario expects support' end], lambda x: x is not null), '; ') as errors, case when g.n = 1 and good = 1 then 'one golden scenario' else '' end as warnings from j left join sa on sa.id = j.id left join g on g.id = j.id)
select id as jurisdiction_id, errors = '' as eligible, errors, warnings from e""",
}


def _titles(spark, d):
    """Turns as titles that begin with numbers of several kinds, from what the data hold."""
    t = table(spark, d, "conversations")
    head = F.get(F.array(F.concat(F.lit("Sec "), F.length("text"), F.lit(". ")), F.concat(F.length("text"), F.lit("."), F.col("turn") + 1, F.lit(" ")), F.concat(F.lit("§ "), F.length("text"), F.lit("-2 ")), F.lit("")), (F.length("text") % 4).cast("int"))
    return t.where("text is not null").select("conv_id", "turn", F.concat(head, F.split_part("text", F.lit("."), F.lit(1))).alias("title"), "text")


def x10_section_numbers(spark, d):
    return _titles(spark, d).select("conv_id", "turn", *[G.section_number(F.col("title"), h).alias(h) for h in ("municode", "amlegal", "madcapflare", "municipalcodeonline")])


def x72_failure_reason(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(G.failure_reason(F.replace("text", F.lit(". "), F.lit(".\n")), "none")).alias("reason"))


def x26_names(spark, d):
    c = table(spark, d, "customer").join(_places(spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("c_mktsegment") == "FURNITURE", "county").when(F.col("c_mktsegment") == "BUILDING", "independent_city").otherwise("municipality")
    name, county = F.concat("n_name", F.lit(", "), "r_name"), F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    return c.select("c_custkey", G.without_state(name).alias("plain"), F.array_join(G.county_names(kind, name, county), "|").alias("counties"), G.match_strategy(kind).alias("strategy"), G.clean_fips(F.split_part("c_name", F.lit("#"), F.lit(2))).alias("fips"))


def x44_not_after(spark, d):
    o = table(spark, d, "orders")
    date = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", G.not_after(date, F.lit("1996-06-30")).alias("passes"))


def x55_request_key(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", G.request_key(F.lower("c_mktsegment"), F.lit("general"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")), F.col("c_name"), F.lit("v1")).alias("key"))


def x60_string_lists(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(G.string_list(F.slice(F.split("text", "[.,]"), 1, 6)), "|").alias("items"))


def x67_point_id(spark, d):
    return table(spark, d, "pages").select("page_id", G.point_id(F.col("url")).alias("point_id"))


def k12_upsert_users(spark, d):
    e = table(spark, d, "events")
    held = e.groupBy(F.col("user_id").alias("user")).agg(F.min_by("event_type", "event_id").alias("email"), F.min_by(F.when(F.col("value") > 100, "pro"), "event_id").alias("tier"), (F.min("value") < 1).alias("disabled"), F.min("event_id").alias("created")).where("user % 3 > 0")
    new = e.groupBy(F.col("user_id").alias("user")).agg(F.max_by("event_type", "event_id").alias("email"), F.max_by(F.when(F.col("value") > 100, "team"), "event_id").alias("tier"), F.lit(False).alias("disabled"), F.max("event_id").alias("created")).where("user % 2 = 0")
    return S.upsert_users(held, new)


def k17_enriched(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.concat_ws("-", "lang", "source", F.col("n_chars") % 50).alias("section_ref"), F.md5(F.coalesce("text", F.lit(""))).alias("full_text"))
    registry, rest = S.enriched_registry(n.where("doc_id < 100").select("section_ref", "full_text"), n.where("doc_id >= 100").select("section_ref", "full_text", F.col("doc_id").alias("position")))
    return registry.select("section_ref", "full_text", F.lit(0).alias("unused")).unionAll(rest.select("section_ref", "full_text", F.lit(1)))


MORE = (x10_section_numbers, x72_failure_reason, x26_names, x44_not_after, x55_request_key, x60_string_lists, x67_point_id, k12_upsert_users, k17_enriched)
QUERIES |= {f.__name__: f for f in MORE}

_TITLES = "with k as (select conv_id, turn, (['Sec ' || length(text) || '. ', length(text) || '.' || (turn + 1) || ' ', '§ ' || length(text) || '-2 ', ''])[length(text) % 4 + 1] || split_part(text, '.', 1) as title from conversations where text is not null)"
ORACLE |= {
    "x10_section_numbers": _TITLES + """ select conv_id, turn, nullif(regexp_replace(regexp_replace(regexp_extract(title, '(?i)^\\s*(Sec\\.?\\s*[0-9][0-9A-Za-z.\\-]*|§\\s*[0-9][0-9A-Za-z.\\-]*|[A-Z]{1,2}-[0-9]{2,}[0-9A-Za-z.\\-]*|[0-9]+[.\\-][0-9A-Za-z][0-9A-Za-z.\\-]*)', 1), '[.\\- ]+$', ''), '(?i)^Sec ', 'Sec. '), '') as municode,
 nullif(regexp_extract(title, '^\\s*([0-9][0-9A-Za-z]*([.\\-][0-9A-Za-z]+)+)', 1), '') as amlegal, nullif(regexp_extract(title, '^\\s*(\\d+(\\.\\d+)*)\\.?\\s+\\S', 1), '') as madcapflare, nullif(regexp_replace(regexp_extract(title, '(?i)^\\s*(Secs?\\.?\\s*[0-9][0-9A-Za-z.\\-]*)', 1), '(?i)^(Secs?) ', '\\1. '), '') as municipalcodeonline from k""",
    "x72_failure_reason": "with k as (select doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> '') as ls from documents) select doc_id, md5(coalesce(list_filter(ls, lambda l: regexp_matches(l, 'failed|BLOCKED|no sections|ERROR'))[-1], ls[-1], 'none')) as reason from k",
    "x26_names": "with k as (select c.*, n_name, r_name from customer c join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) select c_custkey, n_name as plain, case when c_mktsegment = 'BUILDING' then n_name || ' City|City of ' || n_name when c_acctbal > 0 then c_name when c_mktsegment = 'FURNITURE' then n_name else '' end as counties, case c_mktsegment when 'FURNITURE' then 'county' when 'BUILDING' then 'locality_and_county' else 'locality' end as strategy, case when length(split_part(c_name, '#', 2)) between 1 and 10 then split_part(c_name, '#', 2) end as fips from k",
    "x44_not_after": "select o_orderkey, coalesce(o_orderstatus = 'P' or strftime(o_orderdate, '%Y-%m-%d') <= '1996-06-30', true) as passes from orders",
    "x55_request_key": "select c_custkey, sha256('{\"district\":\"' || lower(c_mktsegment) || '\",\"inferred_use\":\"general\",\"jurisdiction_id\":' || case when c_acctbal > 0 then '\"' || c_nationkey || '\"' else 'null' end || ',\"query\":\"' || c_name || '\",\"source_index_version\":\"v1\"}') as key from customer",
    "x60_string_lists": "select doc_id, array_to_string(list_filter(list_transform(list_slice(regexp_split_to_array(coalesce(text, ''), '[.,]'), 1, 6), lambda x: trim(x)), lambda x: x <> ''), '|') as items from documents",
    "x67_point_id": "with k as (select page_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(url)) as h from pages) select page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[(('0x' || h[17])::int % 4) + 1] || h[18:20] || '-' || h[21:32] as point_id from k",
    "k12_upsert_users": """with h as (select user_id as "user", arg_min(event_type, event_id) as email, case when arg_min(value, event_id) > 100 then 'pro' end as tier, min(value) < 1 as disabled, min(event_id) as created from events group by 1 having user_id % 3 > 0),
n as (select user_id as "user", arg_max(event_type, event_id) as email, case when arg_max(value, event_id) > 100 then 'team' end as tier, max(event_id) as created from events group by 1 having user_id % 2 = 0)
select coalesce(h."user", n."user") as "user", coalesce(n.email, h.email) as email, coalesce(n.tier, h.tier, 'free') as tier, coalesce(disabled, false) as disabled, coalesce(h.created, n.created) as created from h full join n on h."user" = n."user\"""",
    "k17_enriched": """with n as (select doc_id, lang || '-' || source || '-' || (n_chars % 50) as r, md5(coalesce(text, '')) as t from documents), f as (select r, arg_min(t, doc_id) as t from n where doc_id >= 100 group by r)
select n.r as section_ref, coalesce(f.t, n.t) as full_text, 0 as unused from n left join f on f.r = n.r where doc_id < 100 union all select r, t, 1 from n where doc_id >= 100 and r not in (select r from n where doc_id < 100)""",
}


def c06_reindexed(spark, d):
    n = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "doc_id", "n_chars")
    expected = n.where("doc_id % 10 > 0").select("source", "hash")
    held = n.where("doc_id % 4 > 0").select("source", F.when(F.col("n_chars") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.concat("source", F.lit(":0")).alias("chunk_id"))
    chunked = n.select("source", "hash", F.concat("source", F.lit(":new")).alias("chunk_id"))
    return I.reindexed(expected, held, chunked)


def c07_index_ready(spark, d):
    n = table(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "n_chars", "doc_id")
    held = n.where("doc_id % 4 > 0").select("source", F.when(F.col("n_chars") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"))
    return I.index_ready(n.select("source", "hash"), held)


def j19_siblings(spark, d):
    l = table(spark, d, "lineitem")
    codes = l.select(F.col("l_orderkey").alias("code"), F.concat_ws("-", F.when(F.col("l_linenumber") > 1, F.lit("1")), F.when(F.col("l_quantity") > 25, F.lit("2")), F.when(F.col("l_linenumber") > 3, F.col("l_linenumber").cast("string"))).alias("number")).where("number <> ''").distinct()
    return I.siblings(codes)


def c15_checklist(spark, d):
    t = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", "turn")
    words = F.get(F.array(*map(F.lit, (" sign and food", " build a shop with parking", " convert it", ""))), (F.length(F.coalesce("text", F.lit(""))) % 4).cast("int"))
    x = I.intake(F.concat(F.coalesce("text", F.lit("")), words))
    cases = t.select("id", F.when(F.col("turn") == 0, "unknown").when(F.col("turn") == 1, "conditional").otherwise("likely_allowed").alias("decision"), F.when(F.col("turn") == 2, F.array(F.lit("Use permit"))).alias("permits"), x["triggers"].alias("triggers"), F.lit(None).cast("array<string>").alias("warnings"))
    return I.checklist(cases).select("id", F.array_join("steps", "|").alias("steps"), F.array_join("departments", "|").alias("departments"))


QUERIES |= {f.__name__: f for f in (c06_reindexed, c07_index_ready, j19_siblings, c15_checklist)}
_STATES = "with n as (select doc_id, 'doc-' || doc_id as source, md5(coalesce(text, '')) as hash, n_chars, case when n_chars % 3 = 0 then 'old' else md5(coalesce(text, '')) end as had from documents)"
ORACLE |= {
    "c06_reindexed": _STATES + " select source, hash, source || case when doc_id % 4 > 0 and coalesce(had = hash, false) then ':0' else ':new' end as chunk_id from n where doc_id % 10 > 0",
    "c07_index_ready": _STATES + " select count(*) as sources, count(*) filter (doc_id % 4 > 0 and had <> hash) as stale, count(*) filter (doc_id % 4 = 0) as missing, count(*) filter (doc_id % 4 > 0) as indexed, false as ready from n",
    "j19_siblings": "with c as (select distinct l_orderkey as code, concat_ws('-', case when l_linenumber > 1 then '1' end, case when l_quantity > 25 then '2' end, case when l_linenumber > 3 then l_linenumber::varchar end) as number from lineitem), k as (select * from c where number <> '') select a.code, a.number as chapter, b.number from k a join k b on a.code = b.code and starts_with(b.number, a.number || '-')",
    "c15_checklist": "with k as (select conv_id || '-' || turn as id, turn, lower(coalesce(text, '') || ([' sign and food', ' build a shop with parking', ' convert it', ''])[length(coalesce(text, '')) % 4 + 1]) as t from conversations), g as (select *, "
    + ", ".join(f"({' or '.join(f"contains(t, '{w}')" for w in words)}) as {name}" for name, words in X.TRIGGERS)
    + """ from k), p as (select *, case when turn = 2 then ['Use permit'] else list_filter([case when change_of_use then 'Zoning permit' end, case when health_department then 'Health permit' end, case when building_permit then 'Building permit' end, case when signage then 'Sign permit' end], lambda x: x is not null) end as permits from g)
select id, array_to_string(list_filter(list_concat([case turn when 0 then 'Confirm the district with the planning office' when 1 then 'Ask for a meeting with the planning office' end], list_transform(permits, lambda x: 'Apply: ' || x)), lambda x: x is not null), '|') as steps,
 array_to_string(list_filter(['Planning', case when parking then 'Transportation' end, case when health_department then 'Health' end, case when building_permit then 'Building' end], lambda x: x is not null), '|') as departments from p""",
}
