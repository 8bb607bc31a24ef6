"""Mixing sources to target weights: weighted sampling without replacement by exponential keys, whole epochs first.

A document's key is -ln(u) / weight, with u a hash of its id: taking the smallest keys of a source draws it with
probability in proportion to its quality weight. Which documents a source's budget reaches is found without sorting
the source: words are summed by bins of the key, the running sum over a source's bins names the one bin where the
budget ends, and only that bin is sorted. Bins are even in the key's logarithm, `bins` of them for each doubling: of
documents of one weight, whatever it is, a bin is expected to hold at most a quarter of a 1/bins part, and so of any
mixture. So a source that holds most rows costs no more than the others. Rows that tie (repeated ones, or equal texts
without an id) are one row with a count there; how many of them the budget reaches is arithmetic, and which ones is
told by their places in the table, found through counts by partition in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table, unit_hash, word_count

SEED = 20240917


def quality_weight(text: Column) -> Column:
    """The share of letters among the characters, 0.1 at least: junk is drawn later."""
    letters = F.length(F.regexp_replace(text, r"\P{L}++", ""))
    return F.coalesce(F.greatest(letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)), F.lit(0.1))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """A row for each source: source, source_size, target.

    sizes: source, source_size. A row for each source only, so its windows are small. Sources sorted by the size their
    cap allows for a unit of weight fill up in that order; the first that doesn't sets the level for the rest.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(budget)
    out = out.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    out = out.withColumn("place", F.row_number().over(filled))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(everything)
    out = out.withColumn("first", first)
    share = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("most")).otherwise(F.col("w") * F.col("first.level"))
    return out.select("source", "source_size", F.least(share, "most").alias("target"))


def _rank(id_col: str, text_col: str, bins: int, seed: int) -> dict[str, Column]:
    """size; pick, which orders a source's documents; bin, a coarse value of pick."""
    text = F.col(text_col)
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    size, key = word_count(text), -F.log(unit_hash(name, seed=seed)) / quality_weight(text)
    pick = F.struct(key.alias("key"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), size.alias("size"), F.xxhash64(text).alias("h"))
    return {"size": size, "pick": pick, "bin": F.floor(F.lit(bins) * F.log2(key)).cast("int")}


def mix_plan(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1), budget=1.5, cap=2.0, bins=1024, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(slim, plan). slim: doc_id, source, size, pick, nr for each row of docs. plan, a row for each source: source, source_size, target, epochs, cut_bin, cut, cut_nr.

    Rows of slim at or below their source's cut are taken once more than epochs times. Null texts have size 0; null
    sources form one source, which comes last; rows without an id are drawn by their texts. Of rows that tie in pick, those at the first
    places of the table (nr, to cut_nr) are taken, as many as the budget reaches.
    """
    ranks = _rank(id_col, text_col, bins, seed)
    slim = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *[c.alias(n) for n, c in ranks.items()], _place().alias("nr")))
    binned = settle(slim.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    targets = source_targets(binned.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = settle(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    t, b = targets.alias("t"), binned.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))).alias("b")
    crossing = b.join(t, F.col("t.source").eqNullSafe(F.col("b.source"))).where("before <= rest and rest < before + words").select("b.source", "bin", (F.col("rest") - F.col("before")).alias("left"))
    crossing = settle(crossing)
    s, c = slim.alias("s"), crossing.alias("c")
    edge = s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.bin") == F.col("c.bin"))).select("s.source", "size", "pick", "nr", "left")
    # A document at the end of the budget is taken if that brings the sum nearer to it.
    tied = edge.groupBy("source", "pick").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("pick").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("room", F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(run), F.lit(0)))
    reached = F.when(F.col("size") > 0, F.floor(F.col("room") / F.col("size") + F.lit(0.5))).when(F.col("room") >= 0, F.col("n")).otherwise(0)
    inside = tied.withColumn("reached", F.least(reached, "n").cast("long")).where("reached > 0")
    cuts = settle(inside.groupBy("source").agg(F.max(F.struct("pick", "reached", "n")).alias("at")).select("source", F.col("at.pick").alias("cut"), F.col("at.reached").alias("reached"), F.col("at.n").alias("n")))
    k = cuts.alias("k")
    plan = t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left").join(k, F.col("t.source").eqNullSafe(F.col("k.source")), "left")
    last = _last_places(edge, cuts).alias("l")
    plan = plan.join(last, F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    plan = plan.select("t.source", "source_size", "target", "epochs", F.col("c.bin").alias("cut_bin"), F.col("k.cut").alias("cut"), F.coalesce("l.cut_nr", F.lit(2**63 - 1)).alias("cut_nr"))
    return slim, settle(plan)


def _place() -> Column:
    """A row's place in a table as it is read: its partition in the upper bits."""
    return F.monotonically_increasing_id()


def _last_places(edge: DataFrame, cuts: DataFrame) -> DataFrame:
    """source, cut_nr: where only some of the rows that tie at a source's cut are reached, the place of the last of them. Places are
    counted by partition first, so only the tied rows of the one partition where the count ends are put in order."""
    some = cuts.where("reached < n").alias("k")
    e = edge.alias("e")
    mine = e.join(some, F.col("e.source").eqNullSafe(F.col("k.source")) & (F.col("e.pick") == F.col("k.cut"))).select("e.source", "nr", F.shiftright("nr", 33).alias("part"), "reached")
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = mine.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.first("reached").alias("reached"))
    ends = by_part.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).where("before < reached and reached <= before + n").select("source", "part", (F.col("reached") - F.col("before")).alias("rest"))
    m, x = mine.alias("m"), ends.alias("x")
    there = m.join(x, F.col("m.source").eqNullSafe(F.col("x.source")) & (F.col("m.part") == F.col("x.part"))).select("m.source", "nr", "rest")
    there = there.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("nr"))).where("place <= rest")
    return there.groupBy("source").agg(F.max("nr").alias("cut_nr"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, epochs, times, taken.

    times: how often the mix takes the document; taken: times * size. Empty texts (size 0) take part and count nothing. Repeated rows
    are rows of their own: as many of them are taken once more as the budget reaches.
    An empty table gives no rows. Sources of only empty texts have target 0.
    """
    slim, plan = mix_plan(docs, **options)
    s, p = slim.alias("s"), broadcast_if_small(plan).alias("p")
    joined = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")))
    return joined.select("doc_id", "s.source", "size", "source_size", "target", "epochs", _times().alias("times"), (_times() * F.col("size")).alias("taken"))


def _times() -> Column:
    return F.col("epochs") + _once_more("").cast("long")


def _once_more(prefix: str) -> Column:
    bin_, cut, nr = (F.col(f"{prefix}{c}") for c in ("cut_bin", "cut", "cut_nr"))
    inside = (F.col("pick") < cut) | ((F.col("pick") == cut) & (F.col("nr") <= nr))
    return F.coalesce((F.col("bin") < bin_) | ((F.col("bin") == bin_) & inside), F.lit(False))


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it, with all its columns, whatever their names. With few sources the rows meet the plan where
    they are read. Texts without words take no budget: where their key is below their source's cut they come along, once more than its epochs. Rows that tie in id, size and text are told
    apart by their places, so docs has to be a table that reads alike each time, as files do."""
    o = {"id_col": "doc_id", "text_col": "text", "source_col": "source", "bins": 1024, "seed": SEED} | options
    names = dict(zip(docs.columns, [f"c{i}" for i in range(len(docs.columns))], strict=True))
    rows = docs.toDF(*names.values())
    own = {k: names[o[k]] for k in ("id_col", "text_col", "source_col")}
    _, plan = mix_plan(rows, **(options | own))
    ranked = rows.select(*rows.columns, *[c.alias(n) for n, c in _rank(own["id_col"], own["text_col"], o["bins"], o["seed"]).items()], _place().alias("nr"))
    p = broadcast_if_small(plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns]))
    times = F.col("p_epochs") + _once_more("p_").cast("long")
    joined = ranked.join(p, F.col(own["source_col"]).eqNullSafe(F.col("p_source"))).withColumn("times", times.cast("int")).where("times > 0")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*rows.columns).toDF(*docs.columns)


def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op1_mixing": op1_mixing}

ORACLE = {
    "op1_mixing": f"""
with d as (select doc_id, source, coalesce(text, '') as t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
k as (select doc_id, source, size, -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, 'text:' || md5(t))), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
  / coalesce(greatest(length(regexp_replace(t, '\\P{{L}}+', '', 'g')) / nullif(length(t), 0)::double, 0.1), 0.1) as key from d),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w, source_size * 2.0::double as most from s),
f as (select *, row_number() over (order by most / w, source asc nulls last) as place from w),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by place rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by place rows between current row and unbounded following) as level from f),
q as (select *, min(case when most / w > level then place end) over () as first from l),
t as (select source, source_size, case when first is null or place < first then most else least(most, w * (select level from q x where x.place = x.first)) end as target from q),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
r as (select k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
  sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and current row) as upto
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target::double as target, (size * (epochs + case when rest > 0 and upto - size / 2.0 <= rest then 1 else 0 end))::bigint as taken from r
""",
}
