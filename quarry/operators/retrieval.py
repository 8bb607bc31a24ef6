"""Retrieval for many requests at once: filter, score, rank, diversify, reserve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import text as X
from quarry.sources.tables import settled

# The words that name a measure, plain questions for one, and units that follow a number.
METRICS = (
    r"\b(?:lot\s+area|lot\s+size|lot\s+width|lot\s+coverage|lot\s+frontage|setback|set\s*back|yard|height|frontage|square\s+feet|square\s+foot|"
    r"sq\.?\s*ft|acreage|acre|density|floor\s+area|floor\s+area\s+ratio|bulk|dimensional)\b"
)
RATIO = r"\b(?-i:F\.?A\.?R\.?)\b"
PLAIN = (
    r"how\s+(?:tall|big|large|small|wide|high|deep|far\s+back|much\s+land)\b|how\s+many\s+stor(?:ies|eys)\b|\b(?:size\s+of\s+(?:the\s+|my\s+|a\s+)?lot|lot\s+size)\b|"
    r"\b(?:smallest|largest|biggest)\s+(?:permitted\s+|allowable\s+|allowed\s+)?lot\b|\b(?:minimum|maximum|max|min)\s+(?:lot\s+)?(?:size|area|dimensions?)\b|\bstor(?:ies|eys)\b"
)
UNITS = r"[0-9][0-9,]*\s*\)?[.,]?\s*(?:square\s+feet|square\s+foot|sq\.?\s*ft|acres?\b|feet\b|foot\b|ft\.?\b)"
# What is asked beside each request, for its permits and for the names of districts.
PERMIT_QUERY = "permitted uses additional use regulations site plan planning commission FMPC approval permit requirements"
DISTRICT_QUERY = "zoning district definitions and designations: names, codes, and purpose of each residential, commercial, mixed-use, and industrial zoning district in the jurisdiction"
MARKED = (("principal_uses", 2), ("use_standards", 1))
#: Rows of a side that is broadcast, and tokens of all requests that are looked up as one set.
SMALL, MOST_TOKENS = 10_000, 20_000


def is_dimensional(query: Column) -> Column:
    """True if a request asks for a measure: in a metric's words, in plain words, or by the upper-case acronym FAR."""
    return query.rlike(f"(?i){METRICS}|{RATIO}|{PLAIN}")


def metric_phrases(query: Column) -> Column:
    """The metrics that a request names, in lower case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(query, F.lit(f"(?i){METRICS}|{RATIO}"), F.lit(0)), lambda x: F.lower(x)))


def has_measure(text: Column) -> Column:
    return text.rlike(f"(?i){UNITS}")


def tag_filter(district: Column, use: Column, districts: Column, uses: Column, *, strict: bool = True) -> Column:
    """Exact membership: the tag itself or a wildcard. strict leaves principal_uses out of the wildcards of use."""
    wild = ("general",) if strict else ("general", "principal_uses")
    by_district = (district == "unknown") | F.arrays_overlap(districts, F.array(district, F.lit("*"), F.lit("unknown")))
    return by_district & F.arrays_overlap(uses, F.array(use, *map(F.lit, wild)))


def tag_score(district: Column, use: Column, districts: Column, uses: Column) -> Column:
    by_district = F.when(district == "unknown", 1.0).when(F.array_contains(districts, district) | F.array_contains(districts, "*"), 2.0).when(F.array_contains(districts, "unknown"), 1.2).otherwise(0.0)
    return by_district + F.when(F.array_contains(uses, use) | F.array_contains(uses, "general"), 2.0).otherwise(0.0)


def asked(requests: DataFrame) -> DataFrame:
    """requests(qid, jurisdiction_id, district, use, description) with query, its tokens, and the measure it asks for. The small side."""
    query = X.collapse(F.concat_ws(" ", "use", "district", "description"))
    q = requests.select("qid", "jurisdiction_id", "district", "use", query.alias("query"))
    return q.withColumn("q_tokens", X.tokens(F.col("query"))).withColumn("wants", is_dimensional(F.col("query"))).withColumn("phrases", F.when(F.col("wants"), metric_phrases(F.col("query"))))


def _keyword_score() -> Column:
    overlap = F.size(F.array_intersect("q_tokens", "c_tokens")) / F.greatest(F.lit(1), F.size("q_tokens"))
    return tag_score(F.col("district"), F.col("use"), F.col("districts"), F.col("uses")) + overlap


def _measure() -> tuple[Column, Column]:
    """(whether a chunk holds a measure that the request may want, whether it names the metric asked for)."""
    found = F.coalesce(F.col("wants") & F.col("has_measure"), F.lit(False))
    return found, F.when(found, (F.size("phrases") == 0) | F.arrays_overlap("phrases", "c_phrases")).otherwise(False)


def _read_once(chunks: DataFrame, requests: DataFrame, *more: Column) -> DataFrame:
    """What a chunk's text gives for all requests (as asked gives them) alike, before it meets them; the text itself stays behind.

    Of its tokens those stay that some request has, if these are at most MOST_TOKENS; else all stay, which gives the same scores. The metrics
    that requests name are words of METRICS and RATIO with single spaces between, some dozens however many requests there are.
    """
    wanted = [r[0] for r in requests.select(F.explode("q_tokens")).distinct().limit(MOST_TOKENS + 1).collect()]
    phrases = sorted(r[0] for r in requests.select(F.explode("phrases")).distinct().collect())
    text = F.col("text")
    named = X.labels(*[(F.contains(F.lower(text), F.lit(p)), p) for p in phrases]) if phrases else F.array().cast("array<string>")
    c = chunks.select("chunk_id", "jurisdiction_id", "section_ref", "districts", "uses", X.tokens(text).alias("c_tokens"), has_measure(text).alias("has_measure"), named.alias("c_phrases"), *more)
    if len(wanted) > MOST_TOKENS:
        return c
    # Tokens are a-z and 0-9 alone, never empty; a list of literals becomes one hash set.
    own = ", ".join(map(repr, sorted(wanted))) or "''"
    return c.withColumn("c_tokens", F.expr(f"filter(c_tokens, t -> t in ({own}))"))


def meet(chunks: DataFrame, requests: DataFrame, key: str = "jurisdiction_id", parts: int = 64) -> DataFrame:
    """Chunks beside the requests of their key. Few requests go to the chunks; many meet them in `parts` parts of a key, as one may have most
    chunks."""
    if requests.limit(SMALL + 1).count() <= SMALL:
        return chunks.join(F.broadcast(requests), key)
    dealt = chunks.withColumn("__part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int"))
    return dealt.join(requests.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), [key, "__part"]).drop("__part")


def candidates(requests: DataFrame, chunks: DataFrame, *, strict: bool = True, cosine: bool = False) -> DataFrame:
    """Pairs of request and chunk that pass the filters, with their score: qid, chunk_id, section_ref, uses, score, measure, named. Up to
    SMALL requests, chunks never move for them; beyond, they move without their texts.

    requests: qid, jurisdiction_id, district, use, description. chunks: chunk_id, jurisdiction_id, section_ref, districts, uses, text.
    A chunk of another jurisdiction than the request's or '*' doesn't take part: its score would be 0. cosine adds the inner product of the
    hashing embeddings of query and chunk to the score.
    """
    q = asked(requests)
    q = q.withColumn("q_vector", N.hash_embedding(F.col("query"))) if cosine else q
    c = _read_once(chunks, q, *([N.hash_embedding(F.col("text")).alias("c_vector")] if cosine else []))
    q = q.withColumn("jurisdiction_id", F.explode(F.array("jurisdiction_id", F.lit("*"))))
    met = meet(c, q).where(tag_filter(F.col("district"), F.col("use"), F.col("districts"), F.col("uses"), strict=strict))
    score = _keyword_score() + N.dot(F.col("q_vector"), F.col("c_vector")) if cosine else _keyword_score()
    found, named = _measure()
    return met.select("qid", "chunk_id", "section_ref", "uses", score.alias("score"), found.alias("measure"), named.alias("named"))


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A broadcast side if it has few rows; else Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rank(met: DataFrame) -> DataFrame:
    """Scores above 0 in order; ties by chunk_id."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return met.where("score > 0").withColumn("rank", F.row_number().over(order))


def pick(met: DataFrame, *, top: int = 8, per_section: int = 2, marked: tuple[tuple[str, int], ...] = (), measures: int = 0, hits: DataFrame | None = None, of_hits: int = 2, runners: tuple[int, int, int] | None = None) -> DataFrame:
    """qid, slot, chunk_id, score: the excerpts of each request.

    The first `top` by score (above 0; ties by chunk_id) with at most per_section of a section, chunks without a section alone; behind them
    of_hits of the hits (qid, chunk_id, score, rank) that aren't there yet; for each (marker, n) the next chunks tagged so until n are there; and for
    requests that ask for a measure, `measures` chunks that hold one, those that name the metric first. runners (first, last, n): then the
    first n of the chunks that rank() has at first to last and that aren't there yet.

    One pass: each list that a pick may be taken from (a section, a marker, the measures) is cut to the few that may be needed before
    any row moves, and what is left of a request, at most some dozens, is put together in its row.
    """
    most = top + of_hits + sum(n for _, n in marked) + measures
    kinds = [F.concat(F.lit("s:"), F.coalesce(F.nullif(F.col("section_ref"), F.lit("")), F.col("chunk_id")))]
    kinds += [F.when(F.array_contains("uses", m), F.lit(f"m{i}")) for i, (m, _) in enumerate(marked)]
    kinds += [F.when(F.col("measure"), F.lit("d"))] if measures else []
    kinds += [F.lit("r")] if runners else []
    last = max(most, runners[1]) if runners else most
    in_reach = (F.col("n") <= last) & ((F.col("kind") == "r") | (F.col("n") <= most))
    tags = F.array(*[F.array_contains("uses", m) for m, _ in marked]) if marked else F.array(F.lit(False))
    rows = met.where("score > 0").select("qid", "chunk_id", "score", "named", tags.alias("tags"), F.explode(F.array_compact(F.array(*kinds))).alias("key"))
    rows = rows.withColumn("kind", F.split_part("key", F.lit(":"), F.lit(1))).withColumn("late", (F.col("kind") == "d") & ~F.col("named")).withColumn("at", -F.round("score", 9))
    in_list = F.row_number().over(Window.partitionBy("qid", "key").orderBy("late", "at", "chunk_id"))
    rows = rows.withColumn("n", in_list).where(in_reach & ((F.col("kind") != "s") | (F.col("n") <= per_section)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid", "kind").orderBy("late", "at", "chunk_id"))).where(in_reach)
    columns = ("n", "kind", "chunk_id", "score", "tags")
    if hits is not None:
        rows = rows.select("qid", *columns).unionByName(hits.where(F.col("rank") <= most).select("qid", F.col("rank").alias("n"), F.lit("h").alias("kind"), "chunk_id", "score", tags.alias("tags")))
    out = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("all"))

    def of(kind: str) -> Column:
        return F.filter("all", lambda x: x["kind"] == kind)

    def more(kind: str, n: Column) -> Column:
        there = F.transform("picks", lambda x: x["chunk_id"])
        return F.concat("picks", F.slice(F.filter(of(kind), lambda x: ~F.array_contains(there, x["chunk_id"])), F.lit(1), n))

    out = out.withColumn("picks", F.slice(of("s"), 1, top))
    if hits is not None:
        out = out.withColumn("picks", more("h", F.lit(of_hits)))
    for i, (_, n) in enumerate(marked):
        tagged = F.size(F.filter(F.transform("picks", lambda x: F.get(x["tags"], F.lit(i))), lambda x: x))  # noqa: B023
        out = out.withColumn("lack", F.greatest(F.lit(0), F.lit(n) - tagged)).withColumn("picks", more(f"m{i}", F.col("lack")))
    if measures:
        out = out.withColumn("picks", more("d", F.lit(measures)))
    if runners:
        out = out.withColumn("all", F.filter("all", lambda x: (x["kind"] == "r") & x["n"].between(*runners[:2]))).withColumn("picks", more("r", F.lit(runners[2])))
    return out.select("qid", F.posexplode("picks").alias("slot", "x")).select("qid", (F.col("slot") + 1).alias("slot"), "x.chunk_id", "x.score")


def retrieve(requests: DataFrame, chunks: DataFrame, *, strict: bool = True, cosine: bool = False) -> DataFrame:
    """The excerpts of each request: qid, slot, chunk_id, score. Reserves follow one another, each sees the last; see with_texts."""
    return pick(candidates(requests, chunks, strict=strict, cosine=cosine), marked=MARKED, measures=2)


def with_texts(picks: DataFrame, chunks: DataFrame) -> DataFrame:
    """picks with the columns of their chunks. The picks, a dozen for each request, are the small side."""
    return chunks.join(small(picks), "chunk_id")


def vector_filter(district: Column, use: Column, districts: Column, uses: Column) -> Column:
    """What the index is asked for: the tag itself or, as untagged chunks fit any, 'unknown' or 'general'; the table of uses always. 'unknown',
    'general', '*' and empty tags ask for nothing."""
    by_district = district.isin("unknown", "*", "") | F.arrays_overlap(districts, F.array(district, F.lit("unknown")))
    return by_district & (use.isin("general", "*", "") | F.arrays_overlap(uses, F.array(use, F.lit("general"), F.lit("principal_uses"))))


def hit_filter(district: Column, use: Column, districts: Column, uses: Column) -> Column:
    """What hits must fit beside: only 'unknown' districts and empty tags ask for nothing."""
    by_district = district.isin("unknown", "") | F.arrays_overlap(districts, F.array(district, F.lit("*"), F.lit("unknown")))
    return by_district & ((use == "") | F.arrays_overlap(uses, F.array(use, F.lit("general"), F.lit("principal_uses"))))


def vector_hits(requests: DataFrame, chunks: DataFrame, limits: tuple[int, int, int] = (20, 10, 6)) -> DataFrame:
    """qid, kind, rank, chunk_id, and what pick needs of the pair: the chunks nearest to each request (kind 0), to PERMIT_QUERY (1) and to
    DISTRICT_QUERY (2) by the inner product of hashing embeddings.

    Twice as many as the limits are fetched by vector_filter, and those of them that fit hit_filter count. All three lists come from one
    join, each cut to its first ones before any row moves.
    """
    q = asked(requests).withColumn("q_vectors", F.array(*[N.hash_embedding(x) for x in (F.col("query"), F.lit(PERMIT_QUERY), F.lit(DISTRICT_QUERY))]))
    c = _read_once(chunks, q, N.hash_embedding(F.col("text")).alias("c_vector"))
    q = q.withColumn("jurisdiction_id", F.explode(F.array("jurisdiction_id", F.lit("*"))))
    tags = [F.col(x) for x in ("district", "use", "districts", "uses")]
    met = meet(c, q).where(vector_filter(*tags))
    found, named = _measure()
    met = met.select("qid", "chunk_id", "section_ref", "uses", _keyword_score().alias("keywords"), found.alias("measure"), named.alias("named"), hit_filter(*tags).alias("fits"), F.transform("q_vectors", lambda v: N.dot(v, F.col("c_vector"))).alias("near"))
    lists = met.select(*[c for c in met.columns if c != "near"], F.posexplode("near").alias("kind", "score"))
    limit = F.get(F.array(*map(F.lit, limits)), F.col("kind"))
    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    lists = lists.withColumn("n", order("qid", "kind")).where((F.col("n") <= 2 * max(limits)) & (F.col("n") <= 2 * limit)).where("fits")
    return lists.withColumn("rank", order("qid", "kind")).where(F.col("rank") <= limit).drop("n", "fits")


def hybrid_retrieve(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """The excerpts of each request by vectors and keywords: qid, slot, chunk_id, score.

    Hits of the three vector lists, each chunk with its best vector score, gain their keyword score; hits without one don't rank. Two of the
    hits for district definitions stand behind the ranked ones whatever their score.
    """
    hits = vector_hits(requests, chunks)
    own = ("section_ref", "uses", "keywords", "measure", "named")
    best = settled(hits.groupBy("qid", "chunk_id").agg(F.max("score").alias("near"), *[F.first(c).alias(c) for c in own], F.min(F.when(F.col("kind") == 2, F.col("rank"))).alias("rank")))  # read twice: some dozens for each request
    met = best.where("keywords > 0").withColumn("score", F.col("near") + F.col("keywords"))
    return pick(met, marked=MARKED, measures=2, hits=best.where("rank is not null").withColumn("score", F.col("near")))


def registry_retrieve(requests: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """The first n chunks of each request that pass the filters, by chunk_id, all with score 1."""
    met = candidates(requests, chunks)
    order = Window.partitionBy("qid").orderBy("chunk_id")
    return met.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= n).select("qid", "slot", "chunk_id", F.lit(1.0).alias("score"))


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors of largest inner product for each query (qid, q), of the same label where labels are given: qid, rank, vec_id, score."""
    met = vectors.join(small(queries), "label").where("vec_id <> qid").select("qid", "vec_id", N.dot(F.col("v"), F.col("q")).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_hits(*hits: DataFrame) -> DataFrame:
    """Several hit lists (qid, vec_id, score) as one, each hit with its best score."""
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.groupBy("qid", "vec_id").agg(F.max("score").alias("score"))
