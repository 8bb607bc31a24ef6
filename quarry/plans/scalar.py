"""Queries of the scalar functions over documents, pages, orders and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import text as X


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def x01_slugify(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.slugify("text").alias("slug"))


def x02_csv_list(spark, d):
    given = F.concat_ws(",", F.lit(" a "), "source", F.lit(""), F.lit("  "), "lang")
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.csv_list(given), "|").alias("items"))


def x03_excerpt(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.excerpt("text").alias("excerpt"))


def x04_collapse_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(X.collapse_lines(F.col("text"))).alias("lines_md5"), F.length(X.collapse_lines(F.col("text"))).alias("n"))


def x06_header_stamp(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", X.header_stamp(F.when(F.col("p_partkey") % 3 == 0, F.substring("p_name", 1, 4)).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")), F.col("p_name")).alias("stamped"))


def x08_tokens(spark, d):
    k = _t(spark, d, "documents").withColumn("tokens", X.tokens(F.col("text")))
    return k.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join(F.array_sort("tokens"), " ")).alias("tokens_md5"))


def x09_section_ref(spark, d):
    n = F.col("doc_id")
    ref = F.when(n % 4 == 0, F.concat(F.lit("Sec. "), n, F.lit("-1."))).when(n % 4 == 1, F.concat(F.lit("Section  "), n, F.lit("  A"))).when(n % 4 == 2, F.concat(F.lit("§"), n)).otherwise(F.concat(F.lit(" Art "), n, F.lit(".. ")))
    return _t(spark, d, "documents").select("doc_id", X.section_ref(ref).alias("ref"))


def x14_keyword_ladders(spark, d):
    c = _t(spark, d, "documents")
    text = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, "bakery in my garage").when(F.col("doc_id") % 3 == 1, "Cafe construction"))
    return c.select("doc_id", X.inferred_use(text).alias("use"), X.project_scope(text).alias("scope"))


def x15_triggers(spark, d):
    c = _t(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(X.triggers(F.col("text")), ",").alias("triggers"), F.array_join(X.missing_fields(F.col("text")), ",").alias("missing"))


def x28_question_key(spark, d):
    c = _t(spark, d, "conversations")
    extra = F.when(F.col("turn") % 4 == 0, " What are the operating HOURS?").when(F.col("turn") % 4 == 1, " lot: size?").when(F.col("turn") % 4 == 2, " planned renovation")
    return c.select("conv_id", "turn", X.question_key(F.concat(F.col("text"), F.coalesce(extra, F.lit("")))).alias("key"))


def x31_coerce_vocab(spark, d):
    given = F.split(F.concat_ws(",", "source", "lang", "source"), ",")
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.coerce(given, ("en", "de", "src1", "src2")), ",").alias("tags"))


def x33_stem_title(spark, d):
    p = _t(spark, d, "pages")
    stem = F.regexp_extract("url", r"([^/]*)$", 1)
    return p.select("page_id", F.lower(X.stem_title(stem)).alias("title"), F.substring(F.sha2("url", 256), 1, 24).alias("cache_name"))


def x35_normal_code(spark, d):
    return _t(spark, d, "part").select("p_partkey", X.normal_code(F.concat_ws("-", "p_brand", "p_type")).alias("code"))


def x37_token_count(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("n_words"))


def x40_lenient_date(spark, d):
    o = _t(spark, d, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    given = F.when(F.col("o_orderkey") % 4 == 0, iso).when(F.col("o_orderkey") % 4 == 1, F.concat(iso, F.lit("T10:11:12"))).when(F.col("o_orderkey") % 4 == 2, F.concat(iso, F.lit(" or so"))).otherwise("soon")
    return o.select("o_orderkey", N.lenient_date(given).alias("day"))


def x41_us_date(spark, d):
    o = _t(spark, d, "orders")
    given = F.when(F.col("o_orderkey") % 3 == 0, "never").otherwise(F.concat(F.lit("enacted "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(".")))
    return o.select("o_orderkey", N.us_long_date(given).alias("day"))


def x42_safe_dates(spark, d):
    o = _t(spark, d, "orders")
    n = F.col("o_orderkey")
    given = F.when(n % 5 == 0, "").when(n % 5 == 1, "0001-01-01T00:00:00").when(n % 5 == 2, "2021-02-03").otherwise("2020-05-06T07:08:09")
    day = N.safe_date(N.expand_year((n % 120).cast("int")), (n % 14).cast("int"), (n % 33).cast("int"))
    return o.select("o_orderkey", day.alias("day"), N.published(given).alias("published"))


def x45_dot_and_unit(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", F.round(N.dot(F.col("embedding"), F.reverse("embedding")), 6).alias("with_reverse"), F.round(N.dot(N.unit(F.col("embedding")), N.unit(F.col("embedding"))), 6).alias("norm"))


def x47_hash_embedding(spark, d):
    """Signed hashing embedding of each document, as (doc_id, cell, value) before normalising: tokens count as often as they occur."""
    t = _t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("token"))
    counted = t.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    cell, sign = N.token_cell(F.col("token"))
    return counted.groupBy("doc_id", cell.alias("cell")).agg(F.sum(F.col("n") * sign).alias("value"))


def x47_hash_vector(spark, d):
    """The same at length 1, as vectors of 64 components made within the row."""
    t = _t(spark, d, "documents").where("text is not null").select("doc_id", N.hash_embedding(F.col("text")).alias("v"))
    # Outer, or Spark would put a filter on the size of v below, and make v twice.
    return t.select("doc_id", F.posexplode_outer("v").alias("cell", "x")).where("x <> 0").select("doc_id", "cell", F.round("x", 9).alias("value"))


def x49_confidence(spark, d):
    l = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cites"), F.count_if(F.col("l_returnflag") == "R").alias("missing"))
    cites = F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(F.col("cites"))
    return l.select("l_orderkey", F.round(N.confidence(F.col("missing"), cites), 6).alias("confidence"))


def x52_content_hash(spark, d):
    c = _t(spark, d, "documents")
    h = X.content_hash(F.col("text"))
    return c.select("doc_id", h.alias("content_hash"), F.substring(h, 1, 16).alias("version"), X.line_hash(F.col("text")).alias("line_hash"))


def x54_chunk_id(spark, d):
    c = _t(spark, d, "documents")
    return c.select(X.chunk_id(F.concat(F.lit("doc-"), "doc_id"), F.col("source"), F.lit(0), X.line_hash(F.col("text"))).alias("chunk_id"))


def x62_decision_maps(spark, d):
    o = _t(spark, d, "orders")
    decision = F.when(F.col("o_orderstatus") == "F", "likely_allowed").when(F.col("o_orderstatus") == "O", "conditional").when(F.col("o_orderkey") % 2 == 0, "restricted").otherwise("other")
    return o.select("o_orderkey", N.permit_path(decision).alias("path"), N.feasibility(decision).alias("feasibility"), N.finding_status(decision).alias("status"))


def x63_verdict(spark, d):
    c = _t(spark, d, "conversations")
    text = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, " Bakery in the GARAGE").otherwise(""))
    return c.select("conv_id", "turn", N.verdict(text, F.when(F.col("conv_id") % 4 == 0, "unknown").otherwise("d1")).alias("verdict"))


def x58_json_shapes(spark, d):
    """One value out of records of several JSON shapes, null where none fits."""
    e = _t(spark, d, "events")
    made = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"embedding":{"values":['), "event_id", F.lit("]}}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"values":['), "event_id", F.lit("]}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"response":{"embedding":{"values":['), "event_id", F.lit("]}}}"))).otherwise("{broken")
    j = e.select("event_id", F.from_json(made, "embedding struct<values:array<bigint>>, values array<bigint>, response struct<embedding:struct<values:array<bigint>>>", {"mode": "PERMISSIVE"}).alias("j"))
    return j.select("event_id", F.get(F.coalesce("j.embedding.values", "j.values", "j.response.embedding.values"), F.lit(0)).alias("value"))


QUERIES = {f.__name__: f for f in (x01_slugify, x02_csv_list, x03_excerpt, x04_collapse_lines, x06_header_stamp, x08_tokens, x09_section_ref, x14_keyword_ladders, x15_triggers, x28_question_key, x31_coerce_vocab, x33_stem_title, x35_normal_code, x37_token_count, x40_lenient_date, x41_us_date, x42_safe_dates, x45_dot_and_unit, x47_hash_embedding, x47_hash_vector, x49_confidence, x52_content_hash, x54_chunk_id, x58_json_shapes, x62_decision_maps, x63_verdict)}

_LINES = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
_HAS = lambda t, *xs: "(" + " or ".join(f"contains({t}, '{x}')" for x in xs) + ")"


def _labels(pairs):
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{v}' end" for c, v in pairs) + "], lambda x: x is not null), ',')"


_TRIG = _labels([(_HAS("lower(text)", *terms), label) for label, terms in X.TRIGGERS])
_MISS = _labels([("len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) < 8", "project scope and intended use"), ("not contains(lower(text), 'hours')", "operating hours"), ("not contains(lower(text), 'employees')", "number of employees"), ("not (contains(lower(text), 'renovation') or contains(lower(text), 'construction'))", "construction scope")])

ORACLE = {
    "x01_slugify": "select doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from documents",
    "x02_csv_list": "select doc_id, 'a|' || source || '|' || lang as items from documents",
    "x03_excerpt": "select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 500) as excerpt from documents",
    "x04_collapse_lines": f"select doc_id, md5({_LINES}) as lines_md5, length({_LINES})::int as n from documents",
    "x06_header_stamp": "select p_partkey, case when p_partkey % 3 = 0 then p_name when p_partkey % 3 = 1 then '[' || p_brand || '] ' || p_name else p_name end as stamped from part",
    "x08_tokens": "with k as (select doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as t from documents) select doc_id, len(t)::int as n_tokens, md5(array_to_string(t, ' ')) as tokens_md5 from k",
    "x09_section_ref": "select doc_id, case when doc_id % 4 = 0 then doc_id || '-1' when doc_id % 4 = 1 then doc_id || ' a' when doc_id % 4 = 2 then doc_id || '' else 'art ' || doc_id end as ref from documents",
    "x14_keyword_ladders": "with k as (select doc_id, lower(concat_ws(' ', text, case when doc_id % 3 = 0 then 'bakery in my garage' when doc_id % 3 = 1 then 'Cafe construction' end)) as t from documents) select doc_id, case when contains(t, 'garage') and contains(t, 'bakery') then 'home-based-food-business' when contains(t, 'bakery') then 'food-business' when contains(t, 'restaurant') or contains(t, 'cafe') then 'food-service' else 'general' end as use, case when contains(t, 'change of use') or contains(t, 'convert') or contains(t, 'conversion') then 'change_of_use' when contains(t, 'addition') or contains(t, 'build') or contains(t, 'construction') then 'new_or_expanded_construction' else 'general_review' end as scope from k",
    "x15_triggers": f"select conv_id, turn, {_TRIG} as triggers, {_MISS} as missing from conversations",
    "x28_question_key": "with k as (select conv_id, turn, trim(regexp_replace(lower(text || coalesce(case turn % 4 when 0 then ' What are the operating HOURS?' when 1 then ' lot: size?' when 2 then ' planned renovation' end, '')), '[^a-z0-9]+', ' ', 'g')) as p from conversations), t as (select *, string_split(p, ' ') as w from k) select conv_id, turn, case when list_contains(w, 'hours') then 'operating hours' when list_has_any(w, ['employee', 'employees', 'workers']) then 'number of employees' when list_has_any(w, ['construction', 'renovation', 'renovations']) and list_has_any(w, ['scope', 'planned', 'modifications']) then 'construction scope' when list_contains(w, 'noise') or (list_contains(w, 'surrounding') and list_contains(w, 'residential')) then 'noise and neighborhood impact' when list_contains(w, 'parking') then 'parking' when list_contains(w, 'lot') and list_contains(w, 'size') then 'lot size' else p end as key from t",
    "x31_coerce_vocab": "select doc_id, case when a = b then a else a || ',' || b end as tags from (select doc_id, case when source in ('src1', 'src2') then source else 'unknown' end as a, case when lang in ('en', 'de') then lang else 'unknown' end as b from documents)",
    "x33_stem_title": "select page_id, lower(translate(regexp_extract(url, '([^/]*)$', 1), '-_', '  ')) as title, left(sha256(url), 24) as cache_name from pages",
    "x35_normal_code": "select p_partkey, upper(regexp_replace(p_brand || '-' || p_type, '[^\\p{L}\\p{N}]', '', 'g')) as code from part",
    "x37_token_count": "select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::int as n_words from documents",
    "x40_lenient_date": "select o_orderkey, case when o_orderkey % 4 < 3 then o_orderdate::date end as day from orders",
    "x42_safe_dates": "with g as (select o_orderkey, o_orderkey % 120 as y, o_orderkey % 14 as m, o_orderkey % 33 as d from orders) select o_orderkey, try_cast(printf('%04d-%02d-%02d', case when y >= 100 then y when y <= 49 then 2000 + y else 1900 + y end, m, d) as date) as day, case o_orderkey % 5 when 0 then null when 1 then null when 2 then '2021-02-03' else '2020-05-06' end as published from g",
    "x41_us_date": "select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderdate::date end as day from orders",
    "x45_dot_and_unit": "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings) select vec_id, round(list_inner_product(v, list_reverse(v)), 6) as with_reverse, 1.0::double as norm from e",
    "x47_hash_embedding": "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents), h as (select doc_id, sha256(token) as h from t) select doc_id, (('0x' || substr(h, 1, 4))::int % 64)::int as cell, sum(case when ('0x' || substr(h, 5, 2))::int % 2 = 0 then 1 else -1 end)::bigint as value from h group by all",
    "x47_hash_vector": "with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents), h as (select doc_id, sha256(token) as h from t), c as (select doc_id, (('0x' || substr(h, 1, 4))::int % 64)::int as cell, sum(case when ('0x' || substr(h, 5, 2))::int % 2 = 0 then 1 else -1 end)::double as v from h group by all), n as (select doc_id, sqrt(sum(v * v)) as n from c group by doc_id) select doc_id, cell, round(v / n, 9) as value from c join n using (doc_id) where v <> 0",
    "x49_confidence": "with l as (select l_orderkey, case when l_orderkey % 5 = 0 then 0 else count(*) end as c, count(*) filter (l_returnflag = 'R') as m from lineitem group by l_orderkey) select l_orderkey, round(greatest(0.1::double, least(0.98::double, 0.82::double - least(0.35::double, 0.07::double * m) + least(0.15::double, 0.05::double * c) - case when c = 0 then 0.28::double else 0.0::double end)), 6) as confidence from l",
    "x52_content_hash": f"with k as (select doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as h, sha256({_LINES}) as l from documents) select doc_id, h as content_hash, left(h, 16) as version, l as line_hash from k",
    "x54_chunk_id": f"with k as (select 'doc-' || doc_id as s, source, sha256({_LINES}) as l from documents) select s || ':chunk:0:' || left(l, 12) || ':' || left(sha256(s || '|' || source || '|0|' || left(l, 16)), 8) as chunk_id from k",
    "x58_json_shapes": "select event_id, case when event_id % 4 < 3 then event_id end as value from events",
    "x62_decision_maps": "with k as (select o_orderkey, case when o_orderstatus = 'F' then 'likely_allowed' when o_orderstatus = 'O' then 'conditional' when o_orderkey % 2 = 0 then 'restricted' else 'other' end as d from orders) select o_orderkey, case d when 'likely_allowed' then 'by-right' when 'conditional' then 'special_use_permit' when 'restricted' then 'variance' else 'unknown' end as path, case d when 'likely_allowed' then 'feasible' when 'restricted' then 'infeasible' when 'conditional' then 'conditional' else 'unknown' end as feasibility, case d when 'likely_allowed' then 'compliant' when 'restricted' then 'non_compliant' when 'conditional' then 'conditional' else 'unknown' end as status from k",
    "x63_verdict": "with k as (select conv_id, turn, lower(text || case when turn % 3 = 0 then ' Bakery in the GARAGE' else '' end) as t from conversations) select conv_id, turn, case when conv_id % 4 = 0 then 'unknown' when contains(t, 'bakery') and contains(t, 'garage') then 'conditional' else 'likely_allowed' end as verdict from k",
}
