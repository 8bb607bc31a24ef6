"""Queries of constraints, replies as variants, look-ups and resumable batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import replies
from quarry.operators import constraints as C
from quarry.operators import ledger as G
from quarry.operators.fragments import elements
from quarry.sources import lookups
from quarry.sources.tables import shared_folder, table
from quarry.sources.versions import Versions


def _sources(spark, d) -> DataFrame:
    """Documents as sources: the first line is the title, the whole text excerpt and full text."""
    t = table(spark, d, "documents")
    return t.select(F.concat(F.lit("doc-"), "doc_id").alias("source_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("excerpt"), F.col("source").alias("section_ref"), F.col("lang").alias("jurisdiction_id"), F.lit("guide").alias("source_type"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("full_text"))


def _split(spark, d):
    s = _sources(spark, d)
    return C.split(s, C.of_columns(s, C.SOURCE))


def p17_kept(spark, d):
    return _split(spark, d)[0].select("source_id", F.md5("full_text").alias("text_md5"))


def p17_rejected(spark, d):
    return _split(spark, d)[1].select("source_id", F.array_join("reasons", "; ").alias("reasons"))


def c18_counters(spark, d):
    kept, _, counters = _split(spark, d)
    return C.report(counters, kept)


def x68_replies(spark, d):
    """Each turn as a model's reply: users' are flat with numbers as text, the others' nested; of turns with a question mark the end is missing."""
    c = table(spark, d, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    told = F.expr("substring(to_json(struct(t)), 6, length(to_json(struct(t))) - 6)")
    ident = lambda i: F.concat(F.lit("c"), "conv_id", F.lit("-"), i)
    feasible = F.when(F.length("t") > 100, "feasible").otherwise(F.lower("role"))
    share = F.concat(F.floor(F.length("t") / 2).cast("string"), F.lit("e-2"))
    flat = F.concat(F.lit('{"feasibility":"'), feasible, F.lit('","confidence":"'), share, F.lit('","summary":'), told, F.lit(',"citation_chunk_ids":["'), ident(F.col("turn") - 1), F.lit('","zz"],"warnings":"w","findings":[{"status":"fine","confidence":7,"citation_ids":["zz","'), ident(F.col("turn") - 1), F.lit('"]},"odd",3]}'))
    nested = F.concat(F.lit('{"decision":"restricted","summary":"outer","compliance":{"feasibility":"'), feasible, F.lit('","confidence":'), share, F.lit(',"summary":'), told, F.lit(',"citation_chunk_ids":[1,"zz"],"warnings":["w",2]}}'))
    body = F.when(F.col("role") == "user", flat).otherwise(nested)
    reply = F.when(F.contains("t", F.lit("?")), F.substring(body, F.lit(1), F.length(body) - 1)).when(F.endswith("t", F.lit(".")), F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    allowed = F.when(F.col("turn") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("turn") - 1, F.lit(0)).cast("int")), ident)).otherwise(F.array().cast("array<string>"))
    found = replies.normalised(c.select("conv_id", "turn", reply.alias("reply"), allowed.alias("allowed")))
    cited = F.array_join(F.flatten(F.transform("findings", lambda f: f["citation_ids"])), ",")
    return found.select("conv_id", "turn", "decision", "feasibility", "confidence", F.md5("summary").alias("summary_md5"), cited.alias("finding_ids"), F.array_join("warnings", "; ").alias("warnings"), F.array_join("citation_ids", ",").alias("cited"), "error")


def p02_lookups(spark, d):
    """Orders by the keys that benchmark items give, from a table laid out for it; then more keys than fit a condition."""
    o, at = table(spark, d, "orders"), f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    lookups.write_keyed(o, at, "o_orderkey")
    few = table(spark, d, "benchmark").select(F.col("item_id").alias("o_orderkey"))
    many = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_orderkey"))
    found = [lookups.look_up(spark, at, "o_orderkey", k, few=n).select("o_orderkey", "o_custkey", F.lit(name).alias("keys")) for name, k, n in (("few", few, 500), ("many", many, 10))]
    return found[0].unionAll(found[1])


def _page_work(row: dict) -> str:
    if "://m." in row["url"]:
        raise G.Blocked("mobile host")
    if "</body>" not in row["html"]:
        raise ValueError("page breaks off")
    return str(sum(e.name == "p" for e in elements(row["html"])))


def c20_batch_runs(spark, d):
    """Pages as units: mobile hosts are blocked, pages that break off fail. A second run tries the failed ones again, the third is the second's again."""
    ledger = Versions(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    pages = table(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    for run in ("one", "two", "two"):
        G.run_batch(pages, _page_work, ledger, run, unit="page_id")
    return G.latest(ledger.read()).select(F.col("unit").cast("long").alias("page_id"), "attempt", "state", "reason", "result")


QUERIES = {f.__name__: f for f in (p17_kept, p17_rejected, c18_counters, x68_replies, p02_lookups, c20_batch_runs)}

_BROKEN = """
with s as (select 'doc-' || doc_id as source_id, split_part(text, chr(10), 1) as title, text, source, lang from documents),
r as (select source_id, text, list_filter([
  case when source_id is null then 'source_id: required' end, case when length(source_id) > 200 then 'source_id: max_length 200' end,
  case when title is null then 'title: required' end, case when length(title) < 3 then 'title: min_length 3' end, case when length(title) > 500 then 'title: max_length 500' end,
  case when text is null then 'excerpt: required' end, case when length(text) < 10 then 'excerpt: min_length 10' end, case when length(text) > 4000 then 'excerpt: max_length 4000' end,
  case when source is null then 'section_ref: required' end, case when length(source) < 1 then 'section_ref: min_length 1' end, case when length(source) > 200 then 'section_ref: max_length 200' end,
  case when length(lang) > 200 then 'jurisdiction_id: max_length 200' end, case when length(text) > 250000 then 'full_text: max_length 250000' end], lambda x: x is not null) as reasons from s)
"""
_NAMES = [c.name for c in C.SOURCE if c.field in ("source_id", "title", "excerpt", "section_ref", "jurisdiction_id", "source_type", "content_hash", "full_text")]

ORACLE = {
    "p17_kept": _BROKEN + "select source_id, md5(text) as text_md5 from r where len(reasons) = 0",
    "p17_rejected": _BROKEN + "select source_id, array_to_string(reasons, '; ') as reasons from r where len(reasons) > 0",
    "c18_counters": _BROKEN + f"""
, n as (select unnest([{', '.join(f"'{x}'" for x in _NAMES)}]) as name)
select name, count(source_id)::bigint as n from n left join r on list_contains(reasons, name) group by name
union all select 'rows', count(*) from r union all select 'kept', count(*) from r where len(reasons) = 0 union all select 'rejected', count(*) from r where len(reasons) > 0
""",
    "x68_replies": """
with c as (select *, coalesce(text, '') as t, role = 'user' as flat from conversations),
x as (select *, contains(t, '?') as broken, least(1.0::double, (length(t) // 2 || 'e-2')::double) as share, case when length(t) > 100 then 'feasible' else lower(role) end as said from c),
y as (select *, case when said in ('feasible', 'conditional', 'infeasible') then said else 'unknown' end as f,
  case when turn = 0 then case when flat then ['c' || conv_id || '-' || (turn - 1), 'zz'] else ['1', 'zz'] end when flat then ['c' || conv_id || '-' || (turn - 1)] else [] end as cited from x)
select conv_id, turn, case when broken then 'unknown' when not flat then 'restricted' when f = 'feasible' then 'likely_allowed' when f = 'infeasible' then 'restricted' else f end as decision,
  case when broken then 'unknown' else f end as feasibility, case when broken then 0.0::double when len(cited) = 0 then least(share, 0.3::double) else share end as confidence,
  md5(case when broken then 'Local model did not return a usable summary.' when t <> '' then t when flat then 'Local model did not return a usable summary.' else 'outer' end) as summary_md5,
  case when broken or not flat then '' when turn = 0 then 'zz,c' || conv_id || '-' || (turn - 1) else 'c' || conv_id || '-' || (turn - 1) end as finding_ids,
  case when broken then '' else array_to_string(list_filter([case when not flat then 'w; 2' end, case when turn > 0 then 'Invalid citation IDs were removed: ' || case when flat then 'zz' else '1, zz' end end,
    case when len(cited) = 0 and share > 0.3 then 'Confidence capped because no valid citation IDs were supplied.' end], lambda z: z is not null), '; ') end as warnings,
  case when broken then '' else array_to_string(cited, ',') end as cited, case when broken then 'no JSON' end as error from y
""",
    "p02_lookups": "select o_orderkey, o_custkey, 'few' as keys from orders where o_orderkey in (select item_id from benchmark) union all select o_orderkey, o_custkey, 'many' from orders where o_orderkey in (select c_custkey from customer where c_acctbal < 0)",
    "c20_batch_runs": """
select page_id, case when state = 'failed' then 2 else 1 end::int as attempt, state, case state when 'blocked' then 'mobile host' when 'failed' then 'ValueError: page breaks off' end as reason,
  case when state = 'ok' then len(regexp_extract_all(html, '<p>'))::varchar end as result
from (select page_id, html, case when contains(url, '://m.') then 'blocked' when not contains(html, '</body>') then 'failed' else 'ok' end as state from pages)
""",
}
