"""Queries of joins, aggregations, sets and writes over the TPC-like tables and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.sources.tables import sources, table

TOPICS = {"lot": "lot", "yard": "yard", "the": "the ", "of": " of ", "und": " und ", "le": " le ", "los": " los ", "license": "license"}


def _dims(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("target"), F.col("r_name").alias("parent"), F.substring("r_name", 1, 2).alias("state"))


def _scoped(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = F.when(F.col("s_suppkey") % 5 == 0, "*").when(F.col("s_suppkey") % 5 == 1, F.col("r_name")).when(F.col("s_suppkey") % 5 == 2, F.lit(None).cast("string")).otherwise(F.col("n_name"))
    return s.select(F.col("s_suppkey").alias("source_id"), j.alias("jurisdiction"), F.array(F.lower(F.substring("r_name", 1, 2)), F.lit(" AF ")).alias("states"))


def j08_scope_join(spark, d):
    return R.scope_join(_dims(spark, d), _scoped(spark, d))


def p05_scope_predicate(spark, d):
    met = _scoped(spark, d).withColumn("k", F.pmod(F.col("source_id") * 7, F.lit(25)).cast("int"))
    n = table(spark, d, "nation").join(_dims(spark, d), F.col("n_name") == F.col("target"))
    return met.join(n, F.col("k") == F.col("n_nationkey")).select("source_id", "target", R.applies(F.col("jurisdiction"), F.col("target"), F.col("parent"), F.col("state"), F.col("states")).alias("applies"))


def j01_projects(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("u"), F.col("c_mktsegment"))
    o = table(spark, d, "orders").join(p, F.col("o_custkey") == F.col("u")).select(F.col("u").alias("user"), F.col("o_orderkey").alias("project"), F.col("o_orderdate").alias("created"))
    a = table(spark, d, "lineitem").where("l_linenumber = 1 and l_returnflag <> 'A'").groupBy(F.col("l_orderkey").alias("project")).agg(F.max("l_linestatus").alias("decision"))
    return R.latest_of(o, a)


def j03_pending(spark, d):
    return R.pending(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


def j04_retag(spark, d):
    held = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("tag"))
    tags = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("tag"))
    updated, skipped = R.retag(held, tags, "doc_id")
    return updated.select("doc_id", "tag").unionAll(skipped.select("doc_id", F.lit("skipped")))


def j10_retag_delta(spark, d):
    """Sources against three stores: one in ten isn't stored, others differ in one store or are absent from a store of chunks or payloads."""
    s = sources(table(spark, d, "documents")).select("source_id", "doc_id", "districts", "uses")
    n, other = F.col("doc_id"), F.array(F.lit("old"))
    csv = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    entries = s.withColumn("uses", F.concat("uses", F.array(F.lit(""))))
    stored = entries.where(n % 10 != 0).withColumn("districts", F.when(n % 17 == 3, other).otherwise(F.col("districts")))
    chunks = entries.where(n % 5 != 1).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select("source_id", csv("districts").alias("districts"), F.when((n % 19 == 4) & (F.col("i") == 1), ",old,").otherwise(csv("uses")).alias("uses"))
    payloads = s.where(n % 4 != 2).withColumn("uses", F.when(n % 23 == 5, other).otherwise(F.col("uses")))
    return R.retag_delta(entries, stored.drop("doc_id"), chunks, payloads.drop("doc_id"), "source_id")


def j09_stale(spark, d):
    h = table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("-"), F.col("doc_id") % 50).alias("source"), F.md5("lang").alias("hash"), "doc_id")
    expected = h.groupBy("source").agg(F.min("hash").alias("hash"))
    return R.stale(expected, h.where("doc_id % 17 <> 0").select("source", "hash"))


def j06_first_match(spark, d):
    rules = spark.sql("select * from values (0, '', '', 'never'), (1, 'steel', 'brushed', 'a'), (2, '', 'nickel', 'b'), (3, 'copper', '', 'c'), (4, '', 'e', 'd') as t(pos, title_contains, contains, tag)")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("title"), F.concat_ws(" ", "p_type", "p_name").alias("body"))
    return R.first_match(rows, rules, "p_partkey", "unknown")


def j05_citation_check(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_quantity > 10")
    cited = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("analysis"), F.col("l_partkey").alias("source"))
    known = table(spark, d, "part").where("p_size % 10 <> 3").select(F.col("p_partkey").alias("source"), (F.col("p_size") % 7 != 0).alias("dated"))
    return R.citation_check(cited, known).select("analysis", "cited", "unknown", "undated", "valid", "coverage")


def j13_recall(spark, d):
    l = table(spark, d, "lineitem")
    required = l.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("ref"))
    cited = l.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("case"), F.col("l_partkey").alias("ref"))
    return R.recall_of(required, cited, table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("ref")))


def a03_request_summary(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    return e.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest"))


def a05_distinct_tags(spark, d):
    s = sources(table(spark, d, "documents"))
    pairs = s.select("section_ref", F.explode("districts").alias("district"), "uses").select("section_ref", "district", F.explode("uses").alias("use"))
    return pairs.groupBy("section_ref").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "district", "use"))), ",").alias("tags"))


def a06_latest_event(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.max("ts").alias("at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def a07_fingerprint(spark, d):
    """The ordered fingerprint of each source's document ids: the reference value of an index."""
    s = table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\x1f", "doc_id", "lang"))), "\x1e").alias("l"))
    return s.select("source", F.sha2("l", 256).alias("fingerprint"))


def a07_table_fingerprint(spark, d):
    return R.ordered_fingerprint(table(spark, d, "labels"), "doc_id", "quality")


def a07_row_fingerprint(spark, d):
    """The same rows as a07_table_fingerprint, in any order: no task sees them all."""
    return R.fingerprint(table(spark, d, "labels"), "doc_id", "quality")


def a09_groups(spark, d):
    order = Window.partitionBy("source", "lang").orderBy("doc_id")
    t = table(spark, d, "documents").select("source", "lang", "doc_id", F.substring(F.element_at(F.split("text", "\n"), 1), 1, 80).alias("title")).where("title <> ''")
    few = t.withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("source", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), " ~ ").alias("titles"))
    return t.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).join(few, ["source", "lang"])


def a10_scorecard(spark, d):
    return R.scorecard(_cases(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("decision_accuracy", "citation_validity", "recall", "invention_rate", "abstention")])


def _cases(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "labels").select((F.col("quality") == 1).alias("right"), (F.col("toxic") == 0).alias("valid"), (n % 4).alias("required"), F.least(n % 4, n % 3).alias("found"), (n % 29 == 0).cast("int").alias("invented"), (n % 5).alias("cited"), (n % 10 == 0).alias("should_abstain"), (n % 20 == 0).alias("abstained"))


def a11_gates(spark, d):
    return R.failed_gates(R.scorecard(_cases(spark, d)), {"decision_accuracy": 0.8, "citation_validity": 1.0, "recall": 0.8, "abstention": 1.0}, {"invention_rate": 0.0})


def a13_longest_body(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id"))


def a14_latest_date(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "M/d/yyyy").alias("s"), "o_orderkey")
    text = F.concat(F.lit("eff. "), "s", F.lit(" and 13/45/2020, 2/30/2021"))
    day = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"), F.lit(0)), lambda x: F.to_date(F.try_to_timestamp(x, F.lit("M/d/yyyy")))))
    return o.select("o_orderkey", day.alias("day"))


def a15_substance(spark, d):
    return R.substance(table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("pack"), "text"), TOPICS)


def a17_repeated_ids(spark, d):
    t = table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id")
    return R.repeated_ids(t, "key", "doc_id").select("doc_id", "occurrence")


def a23_freshness(spark, d):
    o = table(spark, d, "orders")
    url = F.when(F.col("o_orderkey") % 7 == 0, "ftp://x").otherwise("https://x")
    rows = o.select(F.col("o_orderkey").alias("id"), url.alias("url"), F.when(F.col("o_orderkey") % 11 != 0, F.to_date("o_orderdate")).alias("retrieved"), (F.col("o_orderstatus") == "F").alias("public"))
    return R.freshness(rows, "1998-09-01", 700)


def k02_upsert(spark, d):
    held = table(spark, d, "labels").select("doc_id", F.col("quality").alias("value"), F.lit("2024-01-01").alias("created_at"))
    new = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") % 100).cast("int").alias("value"), F.lit("2025-01-01").alias("created_at"))
    return R.upsert(held, new, "doc_id")


def k03_prune(spark, d):
    return R.prune(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").where("lang = 'en'"), "doc_id")


def k10_first_requests(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.withColumn("r", F.row_number().over(order)).where("r = 1").select("user_id", "event_type", "event_id")


def p12_masked(spark, d):
    r = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("compliance"), F.length("o_orderpriority").alias("citations"), F.when(F.col("o_custkey") % 3 == 0, "pro").otherwise("free").alias("tier"))
    return R.masked(r, F.col("tier")).select("o_orderkey", "compliance", "citations", "gated")


def p11_missing_fields(spark, d):
    s = sources(table(spark, d, "documents"))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("section_ref", "effective_date", "jurisdiction_id", "title")]))
    return s.select("source_id", F.array_join(missing, ",").alias("missing"))


def p17_violations(spark, d):
    t = table(spark, d, "documents")
    bad = F.array_compact(F.array(F.when(F.length("text") < 10, F.lit("short")), F.when(F.length("text") > 4000, F.lit("long")), F.when(~F.col("lang").isin("en", "de"), F.lit("lang"))))
    return t.select("doc_id", F.array_join(bad, ",").alias("violations"))


def o02_page(spark, d):
    return table(spark, d, "documents").orderBy("doc_id").offset(40).limit(25).select("doc_id", "lang")


def p03_fetch_in_order(spark, d):
    ids = spark.sql("select posexplode(array(17L, 3L, 99999999L, 42L, 3L)) as (place, doc_id)")
    return table(spark, d, "documents").join(F.broadcast(ids), "doc_id").select("place", "doc_id", "lang")


def u02_reference_union(spark, d):
    a = table(spark, d, "documents").select(F.col("source").alias("ref"))
    return a.union(table(spark, d, "documents").select("lang")).union(spark.range(1).select(F.lit(""))).where("ref <> ''").distinct()


def u03_difference(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


def u04_intersection(spark, d):
    return table(spark, d, "documents").where("lang = 'fr'").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


def j18_toc_paths(spark, d):
    """Ancestors of each entry of a tree: documents, each below the one of a tenth of its number."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 10).cast("long")).alias("parent"))
    return R.ancestors(t, 16).select("node", F.array_join("path", "/").alias("path"))


QUERIES = {f.__name__: f for f in (j08_scope_join, p05_scope_predicate, j01_projects, j03_pending, j04_retag, j09_stale, j10_retag_delta, j06_first_match, j05_citation_check, j13_recall, a03_request_summary, a05_distinct_tags, a06_latest_event, a07_fingerprint, a07_table_fingerprint, a07_row_fingerprint, a09_groups, a10_scorecard, a11_gates, a13_longest_body, a14_latest_date, a15_substance, a17_repeated_ids, a23_freshness, k02_upsert, k03_prune, k10_first_requests, p12_masked, p11_missing_fields, p17_violations, o02_page, p03_fetch_in_order, u02_reference_union, u03_difference, u04_intersection, j18_toc_paths)}

_SCOPE = """with t as (select n_name as target, r_name as parent, left(r_name, 2) as state from nation join region on n_regionkey = r_regionkey),
s as (select s_suppkey as source_id, case s_suppkey % 5 when 0 then '*' when 1 then r_name when 2 then null else n_name end as jurisdiction, left(r_name, 2) as st from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) """
_CARD = """with c as (select quality = 1 as r, toxic = 0 as v, doc_id % 4 as req, least(doc_id % 4, doc_id % 3) as f, (doc_id % 29 = 0)::int as inv, doc_id % 5 as cited, doc_id % 10 = 0 as s, doc_id % 20 = 0 as a from labels),
card as (select avg(r::int) as decision_accuracy, avg(v::int) as citation_validity, coalesce(sum(f) / nullif(sum(req), 0), 1.0) as recall, coalesce(sum(inv) / nullif(sum(cited), 0), 0.0) as invention_rate, coalesce(sum(case when s then a::int end) / nullif(count(*) filter (s), 0), 1.0) as abstention from c) """
_PACKS = ", ".join(f"max(regexp_matches(lower(text), '{p}'))::int as t{i}" for i, p in enumerate(TOPICS.values()))

ORACLE = {
    "j08_scope_join": _SCOPE + "select target, source_id, 'self' as via from t join s on target = jurisdiction union all select target, source_id, 'parent' from t join s on parent = jurisdiction union all select target, source_id, 'global' from t join s on jurisdiction = '*' and (state = st or state = 'AF')",
    "p05_scope_predicate": _SCOPE + "select source_id, target, case when jurisdiction is null then false else coalesce(jurisdiction = target or jurisdiction = parent or (jurisdiction = '*' and (state = st or state = 'AF')), false) end as applies from s join nation on n_nationkey = (source_id * 7) % 25 join t on target = n_name",
    "j01_projects": "with a as (select l_orderkey, max(l_linestatus) as decision from lineitem where l_linenumber = 1 and l_returnflag <> 'A' group by 1) select c_custkey as user, o_orderkey as project, decision, row_number() over (partition by c_custkey order by o_orderdate desc, o_orderkey)::int as place from orders join customer on o_custkey = c_custkey left join a on l_orderkey = o_orderkey",
    "j03_pending": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "j04_retag": "with t as (select doc_id, lang from documents where doc_id % 3 = 0) select l.doc_id, coalesce(t.lang, quality::varchar) as tag from labels l left join t using (doc_id) union all select doc_id, 'skipped' from t where doc_id not in (select doc_id from labels)",
    "j09_stale": "with h as (select source || '-' || (doc_id % 50) as source, md5(lang) as hash, doc_id from documents), e as (select source, min(hash) as hash from h group by 1), s as (select source, min(hash) as lo, max(hash) as hi from h where doc_id % 17 <> 0 group by 1) select e.source, case when lo is null then 'missing' else 'stale' end as state from e left join s using (source) where lo is null or lo <> e.hash or hi <> e.hash",
    "j06_first_match": "with p as (select p_partkey, lower(p_type) as t, lower(p_type || ' ' || p_name) as b from part) select p_partkey, case when contains(t, 'steel') and contains(b, 'brushed') then 'a' when contains(b, 'nickel') then 'b' when contains(t, 'copper') then 'c' when contains(b, 'e') then 'd' else 'unknown' end as tag from p",
    "j05_citation_check": "with c as (select o_orderkey as analysis, l_partkey as source from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 10), k as (select p_partkey, p_size % 7 <> 0 as dated from part where p_size % 10 <> 3), g as (select analysis, count(source) as cited, count(*) filter (source is not null and p_partkey is null) as unknown, count(*) filter (p_partkey is not null and not dated) as undated from c left join k on source = p_partkey group by 1) select *, cited > 0 and unknown = 0 as valid, case when cited > 0 and unknown = 0 then 1.0::double else 0.0 end as coverage from g",
    "j13_recall": "with r as (select distinct l_orderkey as c, l_partkey as ref from lineitem where l_linenumber <= 2), d as (select distinct l_orderkey as c, l_partkey as ref from lineitem where l_returnflag <> 'R'), f as (select c, count(*) as n from r semi join d using (c, ref) group by 1), w as (select c, count(*) as n from d where ref not in (select p_partkey from part where p_size > 5) group by 1) select r.c as case, count(*) as required, coalesce(any_value(f.n), 0) as found, coalesce(any_value(w.n), 0) as invented from r left join f on f.c = r.c left join w on w.c = r.c group by r.c",
    "a03_request_summary": "select user_id, case when event_type <> 'view' then event_type end as kind, count(*) as n, max(ts) as latest from events group by all",
    "j10_retag_delta": "select 'doc-' || doc_id as source_id from documents where doc_id % 10 = 0 or doc_id % 17 = 3 or (doc_id % 5 <> 1 and doc_id % 19 = 4) or (doc_id % 4 <> 2 and doc_id % 23 = 5)",
    "a05_distinct_tags": "with s as (select case when doc_id % 13 = 0 then '' else source end as section_ref, case when doc_id % 7 = 0 then '*' when doc_id % 7 = 1 then 'unknown' else 'd' || (doc_id % 5) end as d, unnest(case when doc_id % 6 = 0 then ['general'] when doc_id % 6 = 1 then ['principal_uses', 'u' || (doc_id % 3)] else ['u' || (doc_id % 3)] end) as u from documents) select section_ref, array_to_string(list_sort(list_distinct(list(d || '/' || u))), ',') as tags from s group by 1",
    "a06_latest_event": "select event_type, max(ts) as at, (max({'t': ts, 'e': event_id})).e as event_id from events group by 1",
    "a07_fingerprint": "select source, sha256(array_to_string(list_sort(list(doc_id || chr(31) || lang)), chr(30))) as fingerprint from documents group by 1",
    "a07_table_fingerprint": "select sha256(array_to_string(list_sort(list(doc_id || chr(31) || quality)), chr(30))) as fingerprint from labels",
    "a09_groups": "with t as (select source, lang, doc_id, left(string_split(text, chr(10))[1], 80) as title from documents), f as (select * from t where title <> ''), r as (select *, row_number() over (partition by source, lang order by doc_id) as r from f) select source, lang, count(*) as n, string_agg(case when r <= 5 then title end, ' ~ ' order by doc_id) as titles from r group by 1, 2",
    "a10_scorecard": _CARD + "select round(decision_accuracy, 9) as decision_accuracy, round(citation_validity, 9) as citation_validity, round(recall, 9) as recall, round(invention_rate, 9) as invention_rate, round(abstention, 9) as abstention from card",
    "a11_gates": _CARD + "select unnest(list_filter([case when round(decision_accuracy, 9) < 0.8 then 'decision_accuracy' end, case when round(citation_validity, 9) < 1 then 'citation_validity' end, case when round(recall, 9) < 0.8 then 'recall' end, case when round(abstention, 9) < 1 then 'abstention' end, case when round(invention_rate, 9) > 0 then 'invention_rate' end], lambda x: x is not null)) as gate from card",
    "a13_longest_body": "select source, (max({'n': length(text), 'd': -doc_id})).d * -1 as doc_id from documents group by 1",
    "a14_latest_date": "select o_orderkey, o_orderdate::date as day from orders",
    "a15_substance": f"with g as (select source || '-' || lang as pack, count(*) as texts, {_PACKS} from documents group by 1), s as (select pack, texts, ({' + '.join(f't{i}' for i in range(len(TOPICS)))})::int as topics from g where texts >= 3) select *, case when topics < 5 then 'error' when topics < 7 then 'warning' else 'ok' end as state from s",
    "a17_repeated_ids": "with r as (select doc_id, row_number() over (partition by md5(text) order by doc_id)::int as occurrence from documents) select * from r where occurrence > 1",
    "a23_freshness": "with r as (select o_orderkey as id, case when o_orderkey % 7 = 0 then 'bad_url' when o_orderkey % 11 = 0 then 'undated' when date_diff('day', o_orderdate::date, date '1998-09-01') > 700 then 'old' else 'fresh' end as state, o_orderstatus = 'F' as public from orders) select id, state, case when state = 'fresh' then 'ok' when public then 'error' else 'warning' end as level from r",
    "k02_upsert": "with n as (select doc_id, (n_chars % 100)::int as v from documents where doc_id % 2 = 0) select coalesce(n.doc_id, l.doc_id) as doc_id, coalesce(n.v, l.quality)::int as value, case when l.doc_id is not null then '2024-01-01' else '2025-01-01' end as created_at from labels l full join n on l.doc_id = n.doc_id",
    "k03_prune": "select doc_id, quality from labels where doc_id in (select doc_id from documents where lang = 'en')",
    "k10_first_requests": "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    "p12_masked": "select o_orderkey, case when o_custkey % 3 = 0 then o_orderstatus end as compliance, case when o_custkey % 3 = 0 then length(o_orderpriority) else 0 end::int as citations, o_custkey % 3 <> 0 as gated from orders",
    "p11_missing_fields": "select 'doc-' || doc_id as source_id, array_to_string(list_filter([case when doc_id % 13 = 0 or source = '' then 'section_ref' end, case when doc_id % 9 = 0 then 'effective_date' end], lambda x: x is not null), ',') as missing from documents",
    "p17_violations": "select doc_id, array_to_string(list_filter([case when length(text) < 10 then 'short' end, case when length(text) > 4000 then 'long' end, case when lang not in ('en', 'de') then 'lang' end], lambda x: x is not null), ',') as violations from documents",
    "o02_page": "select doc_id, lang from documents order by doc_id limit 25 offset 40",
    "p03_fetch_in_order": "select place::int as place, doc_id, lang from (values (0, 17), (1, 3), (2, 99999999), (3, 42), (4, 3)) v(place, doc_id) join documents using (doc_id)",
    "u02_reference_union": "select source as ref from documents where source <> '' union select lang from documents where lang <> ''",
    "u03_difference": "select doc_id from documents except all select doc_id from labels",
    "u04_intersection": "select doc_id from documents where lang = 'fr' intersect select doc_id from labels",
    "j18_toc_paths": "with recursive t as (select doc_id as node, case when doc_id > 0 then doc_id // 10 end as parent from documents), p(node, path) as (select node, '' from t where parent is null union all select t.node, case when p.path = '' then p.node::varchar else p.path || '/' || p.node end from t join p on t.parent = p.node) select node, path from p",
}
