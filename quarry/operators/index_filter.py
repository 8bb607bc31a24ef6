"""Whole filters of an index: what it is asked for first, and what its hits must fit besides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.pages import not_after
from quarry.operators import relational as R
from quarry.operators.retrieval import meet

#: Columns of a request that ask for an equal value of the chunk, where they are given.
EXACT = ("source_id", "source_type", "source_version")
#: Districts and uses that ask for nothing, in the index and among its hits.
OPEN_DISTRICTS, OPEN_USES = ("unknown", "*", ""), ("general", "*", "")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def holds(tags: Column, *wanted: Column, text: bool = False) -> Column:
    """Whether tags hold one of the wanted: a list, or with text=True a text such as `|a|b|`, where a tag counts between two bars only.
    Null tags hold nothing, null is never held."""
    out = F.lit(False)
    for w in wanted:
        one = F.contains(tags, F.concat(F.lit("|"), w, F.lit("|"))) if text else F.array_contains(tags, w)
        out = out | F.coalesce(one, F.lit(False))
    return out


def asks(wanted: dict[str, Column], chunk: dict[str, Column], text: tuple[str, ...] = ()) -> Column:
    """What the index is asked for besides the scope: source, type and version where given; the district or 'unknown'; the use, 'general' or
    'principal_uses'. text names those of districts and uses that are texts with bars."""
    out = F.lit(True)
    for name in EXACT:
        out = out & (blank(wanted[name]) | F.coalesce(wanted[name] == chunk[name], F.lit(False)))
    d, u = (F.coalesce(wanted[x], F.lit("")) for x in ("district", "use"))
    by_district = d.isin(*OPEN_DISTRICTS) | holds(chunk["districts"], d, F.lit("unknown"), text="districts" in text)
    return out & by_district & (u.isin(*OPEN_USES) | holds(chunk["uses"], u, F.lit("general"), F.lit("principal_uses"), text="uses" in text))


def fits(wanted: dict[str, Column], chunk: dict[str, Column], text: tuple[str, ...] = ()) -> Column:
    """What a hit must fit: the scope, where '*' covers the states of the chunk's list and its own state in any case; the district, '*' or
    'unknown' (only 'unknown' and blanks ask for nothing); the use, 'general' or 'principal_uses'; a date that isn't after the limit."""
    d, u = (F.coalesce(wanted[x], F.lit("")) for x in ("district", "use"))
    none = F.array().cast("array<string>")
    states = F.array_compact(F.concat(F.coalesce(chunk["states"], none), F.array(F.nullif(F.trim(chunk["state"]), F.lit("")))))
    scope = blank(wanted["jurisdiction_id"]) | R.applies(chunk["jurisdiction_id"], wanted["jurisdiction_id"], wanted["parent"], F.nullif(wanted["state"], F.lit("")), states)
    by_district = d.isin("unknown", "") | holds(chunk["districts"], d, F.lit("*"), F.lit("unknown"), text="districts" in text)
    by_use = (u == "") | holds(chunk["uses"], u, F.lit("general"), F.lit("principal_uses"), text="uses" in text)
    return F.coalesce(scope & by_district & by_use & not_after(chunk["effective_date"], wanted["effective_on_or_before"]), F.lit(False))


def matches(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk_id, fits) for every chunk that the index gives a request; fits tells whether the hit stays.

    requests: qid, jurisdiction_id, parent, state, source_id, source_type, source_version, district, use, effective_on_or_before; blank or
    null asks for nothing. chunks: chunk_id, jurisdiction_id, state, states (array<string>), source_id, source_type, source_version,
    districts and uses (lists, or texts such as `|a|b|`), effective_date. Other columns are ignored, repeated rows stay.

    The scope (own jurisdiction, its parent, or '*' with the state) is one equi-join over keys: a chunk has one, or two if it is for '*',
    a request up to three, and no pair meets twice. Only where a request names no jurisdiction do all chunks have one more. Chunks move only
    for more requests than are broadcast, and without their texts.
    """
    text = tuple(x for x in ("districts", "uses") if dict(chunks.dtypes)[x] == "string")
    j, parent, state = F.col("jurisdiction_id"), F.col("parent"), F.col("state")
    key = lambda kind, c: F.when(~blank(c), F.concat(F.lit(kind), c))
    everywhere = F.coalesce(j == "*", F.lit(False)) | F.coalesce(parent == "*", F.lit(False))
    scoped = F.array_distinct(F.array_compact(F.array(key("j:", j), key("j:", parent), F.when(~everywhere, key("s:", state)))))
    q = requests.select(*[F.struct(*[F.col(c).cast("string").alias(c) for c in ("jurisdiction_id", "parent", "state", *EXACT, "district", "use", "effective_on_or_before")]).alias("q")], "qid", F.explode(F.when(blank(j), F.array(F.lit("any"))).otherwise(scoped)).alias("key"))
    keys = [key("j:", j), F.when(j == "*", key("s:", state))]
    if q.where("key = 'any'").limit(1).count():
        keys.append(F.lit("any"))
    own = ("jurisdiction_id", "state", "states", *EXACT, "districts", "uses", "effective_date")
    c = chunks.select("chunk_id", F.struct(*own).alias("c"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    wanted = {x: F.col(f"q.{x}") for x in ("jurisdiction_id", "parent", "state", *EXACT, "district", "use", "effective_on_or_before")}
    chunk = {x: F.col(f"c.{x}") for x in own}
    return meet(c, q, "key").where(asks(wanted, chunk, text)).select("qid", "chunk_id", fits(wanted, chunk, text).alias("fits"))
