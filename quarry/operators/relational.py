"""Joins, aggregations and set operations of the corpus and project model."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A broadcast side if it has few rows; else Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def applies(source: Column, target: Column, parent: Column, state: Column, states: Column) -> Column:
    """Whether a source's jurisdiction covers the target: itself, its parent, or '*' with the target's state among the source's states."""
    covered = (source == target) | F.coalesce(source == parent, F.lit(False)) | ((source == "*") & F.coalesce(F.array_contains(F.transform(states, lambda s: F.upper(F.trim(s))), F.upper(state)), F.lit(False)))
    return F.when(target.isNull() | (target == ""), source.isNull() | (source == "")).when(source.isNull() | (source == ""), False).otherwise(covered)


def scope_join(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(target, source_id, via) for every source that covers a target, as three equi-joins instead of one OR.

    targets: target, parent, state. sources: source_id, jurisdiction, states array<string>.
    """
    s = sources.where("jurisdiction is not null and jurisdiction <> ''")
    own = targets.join(s, F.col("target") == F.col("jurisdiction")).select("target", "source_id", F.lit("self").alias("via"))
    above = targets.where("parent <> target").join(s, F.col("parent") == F.col("jurisdiction")).select("target", "source_id", F.lit("parent").alias("via"))
    wide = s.where("jurisdiction = '*'").select("source_id", F.explode(F.array_distinct(F.transform("states", lambda x: F.upper(F.trim(x))))).alias("s"))
    everywhere = targets.join(wide, F.upper("state") == F.col("s")).select("target", "source_id", F.lit("global").alias("via"))
    return own.unionByName(above).unionByName(everywhere)


def latest_of(projects: DataFrame, analyses: DataFrame) -> DataFrame:
    """Every project with its analysis if it has one, newest first within its user: user, project, decision, place."""
    joined = projects.join(analyses, "project", "left")
    order = Window.partitionBy("user").orderBy(F.desc("created"), "project")
    return joined.select("user", "project", "decision", F.row_number().over(order).alias("place"))


def pending(wanted: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't indexed yet."""
    return wanted.join(held.select(key), key, "left_anti")


def retag(held: DataFrame, tags: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(held rows with their new tag, keys of tags that aren't held)."""
    new = tags.select(key, F.col("tag").alias("__tag"))
    return held.join(new, key, "left").withColumn("tag", F.coalesce("__tag", "tag")).drop("__tag"), tags.join(held.select(key), key, "left_anti").select(key)


def stale(expected: DataFrame, held: DataFrame) -> DataFrame:
    """Sources of which the held chunks don't all bear the expected hash (source, hash), and those without any chunk: source, state."""
    seen = held.groupBy("source").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    joined = expected.join(seen, "source", "left")
    state = F.when(F.col("lo").isNull(), "missing").when((F.col("lo") != F.col("hash")) | (F.col("hi") != F.col("hash")), "stale")
    return joined.select("source", state.alias("state")).where("state is not null")


def classify(rows: DataFrame, rules: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(key, districts, uses) of the first rule all of whose stated conditions hold; ['unknown'] and ['general'] where none does, or it names none.

    rows: key, title, breadcrumb (the second part is the article, the third the division). rules: pos, article_contains, division_contains,
    title_contains, contains (in any of the three), districts, uses. Case counts for nothing; a rule that states nothing never matches; null
    texts are empty. More than `most` rules are an error, as they stand beside every row.
    """
    if rules.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rules")
    asked = ("article_contains", "division_contains", "title_contains", "contains")
    said = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    named = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    stated = rules.select("pos", *[said(c).alias(c) for c in asked], named("districts").alias("d"), named("uses").alias("u")).where(F.concat(*asked) != "")
    listed = stated.agg(F.array_sort(F.collect_list(F.struct("pos", *asked, "d", "u"))).alias("__rules"))
    part = lambda i: F.lower(F.coalesce(F.get("breadcrumb", F.lit(i)), F.lit("")))
    text = rows.select(key, part(1).alias("__a"), part(2).alias("__d"), said("title").alias("__t")).withColumn("__all", F.concat_ws(" ", "__a", "__d", "__t"))
    met = text.join(F.broadcast(listed))  # one row of `most` rules at most
    hit = F.get(F.filter("__rules", lambda r: F.col("__a").contains(r[asked[0]]) & F.col("__d").contains(r[asked[1]]) & F.col("__t").contains(r[asked[2]]) & F.col("__all").contains(r[asked[3]])), F.lit(0))
    or_else = lambda c, other: F.when(F.size(c) > 0, c).otherwise(F.array(F.lit(other)))
    return met.withColumn("__hit", hit).select(key, or_else(F.col("__hit.d"), "unknown").alias("districts"), or_else(F.col("__hit.u"), "general").alias("uses"))


def request_counts(requests: DataFrame, key: str, id_col: str, name_col: str) -> DataFrame:
    """(key, n): for each request the number of requests of its place: by id where it has one, else by name, else all of them."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    own = requests.select(key, blank(id_col).alias("__i"), blank(name_col).alias("__m"))
    by_id = own.groupBy(F.col("__i").alias("__gi")).agg(F.count(F.lit(1)).alias("__ni"))
    by_name = own.groupBy(F.col("__m").alias("__gm")).agg(F.count(F.lit(1)).alias("__nm"))
    every = own.agg(F.count(F.lit(1)).alias("__n"))
    met = own.join(by_id, F.col("__i") == F.col("__gi"), "left").join(by_name, F.col("__m") == F.col("__gm"), "left").join(F.broadcast(every))  # one row
    return met.select(key, F.when(F.col("__i").isNotNull(), F.col("__ni")).when(F.col("__m").isNotNull(), F.col("__nm")).otherwise(F.col("__n")).alias("n"))


def index_status(sources: DataFrame, chunks: DataFrame, audit: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: source_count, chunk_count, has_index, last_import_at, last_reindex_at, missing_metadata, vector_count, index_ready.

    sources: source, hash and metadata columns; chunks: source, hash; audit: kind, at; vectors: any. Texts are not read. missing_metadata: how
    many sources lack some of their columns beside these. index_ready: there are chunks and no source's are stale or missing.
    """
    fields = [c for c in sources.columns if c not in ("source", "hash")]
    gap = functools.reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in fields], F.lit(False))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("at")))
    one = sources.agg(F.count(F.lit(1)).alias("source_count"), F.count_if(gap).alias("missing_metadata"))
    one = one.join(chunks.agg(F.count(F.lit(1)).alias("chunk_count"))).join(audit.agg(at("source.import.completed").alias("last_import_at"), at("source.reindex.completed").alias("last_reindex_at")))
    one = one.join(vectors.agg(F.count(F.lit(1)).alias("vector_count"))).join(stale(sources.select("source", "hash"), chunks).agg(F.count(F.lit(1)).alias("wrong")))
    return one.select("source_count", "chunk_count", (F.col("chunk_count") > 0).alias("has_index"), "last_import_at", "last_reindex_at", "missing_metadata", "vector_count", ((F.col("chunk_count") > 0) & (F.col("wrong") == 0)).alias("index_ready"))


def first_match(rows: DataFrame, rules: DataFrame, key: str, default: str) -> DataFrame:
    """(key, tag) of the first rule all of whose stated conditions hold; a rule without conditions never matches.

    rows: key, title, body. rules (few): pos, title_contains, contains, tag.
    """
    stated = rules.where("coalesce(title_contains, '') <> '' or coalesce(contains, '') <> ''").select("pos", F.lower(F.coalesce("title_contains", F.lit(""))).alias("a"), F.lower(F.coalesce("contains", F.lit(""))).alias("b"), F.col("tag").alias("__tag"))
    listed = stated.agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "__tag"))).alias("rules"))
    met = rows.join(F.broadcast(listed))  # one row
    hit = F.filter("rules", lambda r: F.lower("title").contains(r["a"]) & F.lower("body").contains(r["b"]))
    return met.select(key, F.coalesce(F.get(hit, F.lit(0))["__tag"], F.lit(default)).alias("tag"))


def citation_check(citations: DataFrame, sources: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per analysis: citations, unknown sources, sources of other jurisdictions, citations without a source id ('<missing>'), undated citations,
    whether it is valid, coverage (1 if there are citations and all are valid).

    citations: analysis, source (null for an analysis without any, '' for a missing id). sources: source, dated boolean and, with targets,
    jurisdiction, states. targets: analysis, target, parent, state. An empty registry makes no source unknown.
    """
    some = sources.limit(1).count() > 0
    place = ["jurisdiction", "states"] if targets is not None else []
    known = sources.select("source", "dated", *place, F.lit(True).alias("__known"))
    joined = citations.join(known, "source", "left")
    source = F.col("source").cast("string")
    named = source != ""
    foreign = F.lit(False)
    if targets is not None:
        joined = joined.join(targets, "analysis", "left")
        foreign = named & F.col("__known") & F.col("target").isNotNull() & ~applies(F.col("jurisdiction"), F.col("target"), F.col("parent"), F.col("state"), F.col("states"))
    unknown = named & F.col("__known").isNull() & F.lit(some)
    out = joined.groupBy("analysis").agg(
        F.count("source").alias("cited"), F.count_if(unknown).alias("unknown"), F.count_if(foreign).alias("foreign"), F.count_if(source == "").alias("missing"),
        F.count_if(F.col("__known") & ~F.col("dated")).alias("undated"), F.array_sort(F.collect_set(F.when(source == "", "<missing>").when(unknown | foreign, source))).alias("invalid_ids"),
    )
    valid = (F.col("cited") > 0) & (F.col("unknown") + F.col("foreign") + F.col("missing") == 0)
    return out.withColumn("valid", valid).withColumn("coverage", F.when(valid, 1.0).otherwise(0.0))


def recall_of(required: DataFrame, cited: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per case: required references, those cited, and cited ones that no corpus holds. required, cited: case, ref; corpus: ref."""
    r, c = required.distinct(), cited.distinct()
    found = r.join(c, ["case", "ref"], "left_semi").groupBy("case").agg(F.count(F.lit(1)).alias("found"))
    wrong = c.join(corpus.distinct(), "ref", "left_anti").groupBy("case").agg(F.count(F.lit(1)).alias("invented"))
    n = r.groupBy("case").agg(F.count(F.lit(1)).alias("required"))
    return n.join(found, "case", "left").join(wrong, "case", "left").select("case", "required", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("invented", F.lit(0)).alias("invented"))


def scorecard(cases: DataFrame) -> DataFrame:
    """One row of ratios; an empty denominator counts as 1. cases: right, valid, required, found, invented, cited, should_abstain, abstained."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(1.0))
    one = F.lit(1)
    return cases.agg(
        F.coalesce(F.avg(F.col("right").cast("int")), F.lit(1.0)).alias("decision_accuracy"), F.coalesce(F.avg(F.col("valid").cast("int")), F.lit(1.0)).alias("citation_validity"), ratio("found", "required").alias("recall"),
        F.coalesce(F.try_divide(F.sum("invented"), F.sum("cited")), F.lit(0.0)).alias("invention_rate"), ratio(F.when(F.col("should_abstain"), F.col("abstained").cast("int")), F.when(F.col("should_abstain"), one)).alias("abstention"),
    )


def failed_gates(card: DataFrame, floors: dict[str, float], ceilings: dict[str, float]) -> DataFrame:
    """The names of the ratios of a scorecard that miss their floor or ceiling."""
    bad = [F.when(F.round(k, 9) < v, F.lit(k)) for k, v in floors.items()] + [F.when(F.round(k, 9) > v, F.lit(k)) for k, v in ceilings.items()]
    return card.select(F.explode(F.array_compact(F.array(*bad))).alias("gate"))


def substance(texts: DataFrame, topics: dict[str, str], least: int = 3) -> DataFrame:
    """Per pack with `least` texts or more: how many topics occur anywhere in it. texts: pack, text; topics: name -> pattern."""
    low = F.lower("text")
    agg = [F.max(low.rlike(p)).alias(f"__t{i}") for i, p in enumerate(topics.values())]
    found = sum((F.col(f"__t{i}").cast("int") for i in range(len(topics))), F.lit(0))
    out = texts.groupBy("pack").agg(F.count(F.lit(1)).alias("texts"), *agg).where(F.col("texts") >= least).withColumn("topics", found)
    return out.select("pack", "texts", "topics", F.when(F.col("topics") < 5, "error").when(F.col("topics") < 7, "warning").otherwise("ok").alias("state"))


def repeated_ids(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Second and later rows of a key: the first in order is the right one."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("occurrence > 1")


def freshness(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """id, state of each row (once for each id): bad_url, undated, old or fresh; level error for public rows that aren't fresh, else warning."""
    once = rows.dropDuplicates(["id"])
    age = F.datediff(F.lit(as_of).cast("date"), F.col("retrieved"))
    state = F.when(~F.col("url").rlike("^https?://"), "bad_url").when(F.col("retrieved").isNull(), "undated").when(age > days, "old").otherwise("fresh")
    out = once.select("id", "public", state.alias("state"))
    return out.select("id", "state", F.when(F.col("state") == "fresh", "ok").when(F.col("public"), "error").otherwise("warning").alias("level"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One value of a table's rows, whatever their order and partitions: row hashes are summed, so it needs no sort and no single task for the rows."""
    h = F.xxhash64(*columns)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(h).alias("mixed")).select("rows", F.when(F.col("rows") == 0, "").otherwise(F.sha2(F.concat_ws(":", "rows", "total", "mixed"), 256)).alias("fingerprint"))


def ordered_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """SHA-256 over all rows in order, fields and rows parted by the unit and record separators: the same as a stream over sorted rows.

    By definition one value over all rows in order, so one task sees them all: for tables of ids, not of texts.
    """
    line = F.concat_ws("\x1f", *columns)
    return rows.agg(F.array_sort(F.collect_list(line)).alias("l")).select(F.when(F.size("l") == 0, "").otherwise(F.sha2(F.array_join("l", "\x1e"), 256)).alias("fingerprint"))


def retag_delta(entries: DataFrame, stored: DataFrame, chunks: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Keys of entries (key, districts, uses) whose tags differ in one of three stores: not stored or stored otherwise, a chunk row (key, districts,
    uses as ',a,b,') that differs, or a vector payload (key, districts, uses without empty ones). Without chunk rows or payloads there is nothing stale."""
    e = entries.select(F.col(key).alias("__k"), F.col("districts").alias("__d"), F.col("uses").alias("__u"))
    csv = lambda c: F.concat(F.lit(","), F.array_join(c, ","), F.lit(","))
    filled = lambda c: F.filter(c, lambda x: x != "")
    differ = lambda rows, how, change: e.join(rows, F.col("__k") == F.col(key), how).where(~(F.col("districts").eqNullSafe(change("__d")) & F.col("uses").eqNullSafe(change("__u")))).select(F.col("__k").alias(key))
    found = differ(stored, "left", F.col).unionAll(differ(chunks, "inner", csv)).unionAll(differ(payloads, "inner", filled))
    return found.distinct()


def upsert(held: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """held with new's rows in place of those of their keys; the columns in keep stay as they were held."""
    n = new.select(F.col(key).alias("__key"), F.struct(*[c for c in held.columns if c != key]).alias("__new"))
    o = held.select(F.col(key).alias("__old_key"), F.struct(*[c for c in held.columns if c != key]).alias("__old"))
    both = o.join(n, F.col("__old_key") == F.col("__key"), "full_outer")
    value = lambda c: F.coalesce(F.col(f"__old.{c}"), F.col(f"__new.{c}")) if c in keep else F.when(F.col("__key").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return both.select(*[F.coalesce("__key", "__old_key").alias(key) if c == key else value(c).alias(c) for c in held.columns])


def prune(held: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return held.join(keep.select(key), key, "left_semi")


def masked(result: DataFrame, tier: Column) -> DataFrame:
    """The free tier sees the decision; checklist and citations are empty, compliance is null."""
    pro = tier == "pro"
    return result.withColumn("compliance", F.when(pro, F.col("compliance"))).withColumn("citations", F.when(pro, F.col("citations")).otherwise(F.lit(0))).withColumn("gated", ~pro)


def ancestors(edges: DataFrame, steps: int = 32) -> DataFrame:
    """(node, path) with the ancestors of each node from the root down. edges: node, parent (null for roots). Doubles the reach each round."""
    now = edges.select("node", F.col("parent").alias("top"), F.when(F.col("parent").isNull(), F.array().cast("array<long>")).otherwise(F.array("parent")).alias("path"))
    for _ in range(max(1, steps.bit_length())):
        up = now.select(F.col("node").alias("__n"), F.col("top").alias("__t"), F.col("path").alias("__p"))
        now = now.join(up, F.col("top") == F.col("__n"), "left").select("node", F.col("__t").alias("top"), F.concat(F.coalesce("__p", F.array().cast("array<long>")), "path").alias("path"))
    return now.select("node", "path")
