"""Queries of page fragments, script literals and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import fragments as G
from quarry.operators import trees as T
from quarry.sources import script_toc as J
from quarry.sources.tables import table


def x23_stripped_pages(spark, d):
    """Pages without navigation, advertisements, headings and footers."""
    rules = (G.Rule("nav"), G.Rule("div", "class", "ad"), G.Rule("h1", which="first"), G.Rule("footer"))
    return G.stripped_pages(table(spark, d, "pages"), rules).select("page_id", F.md5("html").alias("html_md5"))


def x70_article_text(spark, d):
    """The text of each page's article without its title, white space left out."""
    text = F.regexp_replace("text", r"[\s ]+", "")
    return G.container_texts(table(spark, d, "pages"), "article").select("page_id", F.md5(text).alias("text_md5"))


def _forest(spark, d):
    """Regions, nations, customers, orders and their lines as one forest."""
    s = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    none = F.lit(None).cast("string")
    r = table(spark, d, "region").select(s("r", "r_regionkey").alias("node"), none.alias("parent"), F.lit("region").alias("kind"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(s("n", "n_nationkey").alias("node"), s("r", "n_regionkey").alias("parent"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(s("c", "c_custkey").alias("node"), s("n", "c_nationkey").alias("parent"), F.when(F.col("c_acctbal") > 0, "chapter").otherwise("group").alias("kind"), F.col("c_mktsegment").alias("name"))
    o = table(spark, d, "orders").select(s("o", "o_orderkey").alias("node"), s("c", "o_custkey").alias("parent"), F.when(F.col("o_orderpriority").startswith("1"), "article").otherwise("group").alias("kind"), F.col("o_orderstatus").alias("name"))
    line = table(spark, d, "lineitem").select(F.concat_ws("-", F.concat(F.lit("l"), "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey").alias("node"), s("o", "l_orderkey").alias("parent"), F.lit("section").alias("kind"), F.col("l_returnflag").alias("name"))
    return r.unionAll(n).unionAll(c).unionAll(o).unionAll(line)


def j18_sections(spark, d):
    """Lines as sections with their nearest container, without the branches of one market segment."""
    kind = F.col("kind")
    found = T.by_container(_forest(spark, d), leaf=kind == "section", container=kind.isin("chapter", "article", "nation"), cut=F.lower("name").contains("machinery"))
    return found.groupBy("container").agg(F.count(F.lit(1)).alias("sections"), F.min("node").alias("least"))


def j18_last_purchase(spark, d):
    """Each user's events as a chain, each the child of the one before: the nearest purchase up to it. Chains are as long as the table makes them."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    found = T.climb(e.select(F.col("event_id").alias("node"), before.alias("parent"), "event_type"), stop=F.col("event_type") == "purchase")
    return found.select(F.col("node").alias("event_id"), F.col("nearest").alias("purchase_id"))


def _scripts(spark, d):
    """A site for each customer with orders: the orders are its chapters, their lines the sections. Titles hold quotes; those of customers in debt break off."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    rows = o.withColumn("l_linenumber", F.lit(0)).withColumn("title", F.concat(F.lit("Order's "), "o_orderpriority")).select("o_custkey", "o_orderkey", "l_linenumber", "title")
    rows = rows.unionByName(o.join(line, "o_orderkey").select("o_custkey", "o_orderkey", "l_linenumber", F.concat(F.lit('"'), "l_returnflag", F.lit('", '), "l_linenumber").alias("title")))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "l_linenumber", "title")) - 1)
    quoted = F.concat(F.lit("'"), F.replace("title", F.lit("'"), F.lit("\\'")), F.lit("'")).alias("title")
    leaf = F.concat(F.lit("{i:"), "i", F.lit(",c:0}")).alias("leaf")
    order = rows.groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_list(F.struct("i", F.col("i").cast("string").alias("number"), quoted, leaf))).alias("e"))
    tree = F.concat(F.lit("{i:"), F.col("e")[0]["i"], F.lit(",c:0,n:["), F.array_join(F.slice("e.leaf", 2, F.size("e")), ","), F.lit("]}"))
    page = F.concat(F.lit("'/Content/o"), "o_orderkey", F.lit(".htm':{i:["), F.array_join("e.number", ","), F.lit("],t:["), F.array_join("e.title", ","), F.lit("],b:[''"), F.lit(",]}"))
    site = order.select("o_custkey", F.struct("o_orderkey", tree.alias("tree"), page.alias("page")).alias("x")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    site = site.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    whole = F.concat(F.lit("define({numchunks:1,prefix:'Chunk',chunkstart:['/Content/x.htm'],tree:{n:["), F.array_join("x.tree", ","), F.lit("]}});"))
    chunk = F.concat(F.lit("define({/* pages */"), F.array_join("x.page", ",\n"), F.lit("});"))
    chunk = F.when(F.col("c_acctbal") < 0, F.substring(chunk, F.lit(1), F.length(chunk) - 9)).otherwise(chunk)
    two = F.array(F.struct(F.lit("Toc.js").alias("name"), whole.alias("body")), F.struct(F.lit("Toc_Chunk0.js").alias("name"), chunk.alias("body")))
    return site.select(F.col("o_custkey").alias("site"), F.explode(two).alias("f")).select("site", "f.name", "f.body")


def x25_script_toc(spark, d):
    """Entries with their paths of all sites; a broken file is one row with `broken` set."""
    read = J.read_scripts(_scripts(spark, d)).persist()
    good = J.paths(J.entries(read)).select("site", "i", "href", F.array_join("path", " > ").alias("path"), F.lit(False).alias("broken"))
    bad = read.where("error is not null").select("site", F.lit(-1).alias("i"), F.col("name").alias("href"), F.lit("").alias("path"), F.lit(True).alias("broken"))
    return good.unionByName(bad)


QUERIES = {f.__name__: f for f in (x23_stripped_pages, x70_article_text, j18_sections, j18_last_purchase, x25_script_toc)}

ORACLE = {
    "x23_stripped_pages": r"""
select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<nav>(.|\n)*?</nav>', '', 'g'), '<div class="ad">(.|\n)*?</div>', '', 'g'), '<h1>(.|\n)*?</h1>', ''), '<footer>(.|\n)*?</footer>', '', 'g')) as html_md5 from pages
""",
    "x70_article_text": r"""
with a as (select page_id, regexp_extract(html, '<article>((.|\n)*)</article>', 1) as t from pages),
b as (select page_id, regexp_replace(regexp_replace(t, '<h1>(.|\n)*?</h1>', ''), '<[^>]+>', '', 'g') as t from a),
c as (select page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as t from b)
select page_id, md5(regexp_replace(t, '[\s\x{00a0}]+', '', 'g')) as text_md5 from c
""",
    "j18_sections": """
with t as (select distinct 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as node,
  case when o_orderpriority like '1%' then 'o' || o_orderkey when c_acctbal > 0 then 'c' || c_custkey else 'n' || c_nationkey end as container
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_mktsegment <> 'MACHINERY')
select container, count(*) as sections, min(node) as least from t group by container
""",
    "j18_last_purchase": """
select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as purchase_id from events
""",
    "x25_script_toc": """
with r as (select o_custkey as site, o_orderkey, 0 as l, 'Order''s ' || o_orderpriority as title from orders union all
  select o_custkey, o_orderkey, l_linenumber, '"' || l_returnflag || '", ' || l_linenumber from orders join lineitem on l_orderkey = o_orderkey),
n as (select *, (row_number() over (partition by site order by o_orderkey, l, title) - 1)::int as i, first_value(title) over (partition by o_orderkey order by l) as chapter from r)
select site, i, '/Content/o' || o_orderkey || '.htm' as href, case when l = 0 then title else chapter || ' > ' || title end as path, false as broken from n join customer on c_custkey = site where c_acctbal >= 0
union all select distinct site, -1, 'Toc_Chunk0.js', '', true from n join customer on c_custkey = site where c_acctbal < 0
""",
}
