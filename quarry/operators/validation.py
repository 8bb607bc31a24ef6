"""Checks and picks over sources, addresses and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import collapse, ladder, question_key
from quarry.operators.relational import small


# Hosts that stand for none.
PLACEHOLDERS = ("example.com", "example.gov", "example.net", "example.org", "www.example.com", "www.example.gov", "www.example.net", "www.example.org")


def url_problem(url: Column, local_ok: Column | bool = False) -> Column:
    """What is wrong with a URL: missing, todo, placeholder (a host that stands for none), scheme (neither http nor https with a host, nor local or
    file where local_ok); null if nothing is."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    place = host.isin(*PLACEHOLDERS) | host.endswith(".example.com") | host.endswith(".example.gov")
    good = (scheme.isin("http", "https") & (host != "")) | ((local_ok if isinstance(local_ok, Column) else F.lit(local_ok)) & scheme.isin("local", "file"))
    return ladder((u == "", "missing"), (F.upper(u).contains("TODO"), "todo"), (place, "placeholder"), (~good, "scheme"))


def is_reserved(title: Column) -> Column:
    """Headings of sections that hold nothing."""
    return F.lower(title).rlike(r"\b(reserved|repealed)\b\.?\]?\)?\s*$")


def confidence_label(score: Column) -> Column:
    return ladder((score >= 0.75, "high"), (score >= 0.6, "medium"), default="low")


def resolve(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """key with the first jurisdiction whose rule its address meets; rules by county come after all others.

    rows: key, locality, county, state. rules: pos, strategy (locality, county, locality_and_county), locality, county, state, jurisdiction_id.
    An address without a county passes locality_and_county by its locality alone. The rules of a state, some dozens, meet its addresses as one
    list in order, so that an address stays one row; addresses are dealt by key before they are sorted for it, however large the files are.
    """
    late = (F.col("strategy") == "county").alias("late")
    rule = F.struct(late, "pos", "jurisdiction_id", "strategy", F.lower("locality").alias("l"), F.lower("county").alias("c"))
    r = rules.groupBy(F.lower("state").alias("__s")).agg(F.array_sort(F.collect_list(rule)).alias("__rules"))
    met = rows.join(small(r), F.lower("state") == F.col("__s"), "left")

    def hit(x: Column) -> Column:
        by_locality, by_county = F.lower("locality") == x["l"], F.lower("county") == x["c"]
        met_by = F.when(x["strategy"] == "locality", by_locality).when(x["strategy"] == "county", by_county).otherwise(by_locality & (F.col("county").isNull() | by_county))
        return F.coalesce(met_by, F.lit(False))

    best = met.select(key, F.get(F.filter("__rules", hit), F.lit(0)).alias("__x"))
    rank = F.when(F.col("__x").isNotNull(), F.struct("__x.late", "__x.pos", "__x.jurisdiction_id"))
    dealt = best.select(key, rank.alias("__x")).repartition(key)
    return dealt.groupBy(key).agg(F.min("__x").alias("m")).select(key, F.col("m.jurisdiction_id").alias("jurisdiction_id"))


def pick(nodes: DataFrame, group: str, *order: Column) -> DataFrame:
    """The best node of each group by several keys; ties by title."""
    return nodes.groupBy(group).agg(F.min_by("title", F.struct(*order, F.col("title"))).alias("title"))


def parse_reply(text: Column) -> tuple[Column, Column]:
    """(decision, confidence) of a reply that holds JSON, fenced or not; unknown and 0 where it doesn't parse, confidence within 0 and 1."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?", ""), r"```\s*$", ""))
    j = F.from_json(body, "decision string, confidence double")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(j["confidence"], F.lit(0.0))))
    return F.coalesce(j["decision"], F.lit("unknown")), F.when(j["decision"].isNull(), 0.0).otherwise(confidence)


def valid_citations(cited: Column, known: Column, confidence: Column, cap: float = 0.3) -> tuple[Column, Column]:
    """(cited ids that are known, in order and once; the confidence, capped where none is left)."""
    kept = F.array_intersect(F.array_distinct(cited), known)
    return kept, F.when(F.size(kept) == 0, F.least(confidence, F.lit(cap))).otherwise(confidence)


def reserve_hits(top: DataFrame, hits: DataFrame, reserve: int = 2) -> DataFrame:
    """top (qid, slot, chunk_id) with the first `reserve` hits (qid, place, chunk_id) behind it that it doesn't hold yet."""
    last = top.groupBy("qid").agg(F.max("slot").alias("__last"))
    more = hits.join(top.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").join(last, "qid")
    more = more.withColumn("__i", F.row_number().over(Window.partitionBy("qid").orderBy("place"))).where(F.col("__i") <= reserve)
    return top.select("qid", "slot", "chunk_id").unionByName(more.select("qid", (F.col("__last") + F.col("__i")).alias("slot"), "chunk_id"))


def asked_once(rows: DataFrame, by: str, order: str, question: str) -> DataFrame:
    """(by, place, question): of the questions of a group that ask the same, the first that is more than 'please provide ...', or else the first;
    place is the order of the first of them. Blank and null questions go.

    Counted up before anything moves: of a group with very many rows only one row for each thing asked leaves a task.
    """
    q = rows.select(by, F.col(order).alias("__at"), collapse(F.col(question)).alias("__q")).where("__q <> ''")
    generic = F.startswith(F.lower("__q"), F.lit("please provide "))
    one = q.groupBy(by, question_key(F.col("__q")).alias("__key")).agg(F.min("__at").alias("place"), F.min(F.struct(generic.alias("generic"), "__at", "__q")).alias("best"))
    return one.select(by, "place", F.col("best.__q").alias("question"))
