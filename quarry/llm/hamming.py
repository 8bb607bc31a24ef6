"""Exact top-k search over binary codes: incremental multi-index hashing.

A code is cut into m segments of about log2(number of codes) bits, 16 at least, and each segment is an index of its own. Round r looks
up, index after index, the values that differ from the query's segment in exactly r bits. Once the first j indexes are
through round r, every code within m * r + j - 1 of the query has been met, so a query needs no further look-up when its
k-th verified distance is covered by that; where that happens is told for each query, index by index. Nothing else ends
the search: in the last round every value of every segment is looked up, so all results are proven.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table
from .vectors import distinct_with_ids, ranked, usable


def sign_words(v: Column, d: int) -> Column:
    """The signs of d components (1 for above 0) as array<long>: bit i % 64 of word i / 64 for component i."""
    words = []
    for start in range(0, d, 64):
        bits = [F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << (i - start) if i - start < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(start, min(d, start + 64))]
        word = bits[0]
        for b in bits[1:]:
            word = word.bitwiseOR(b)
        words.append(word)
    return F.array(*words)


def segments(d: int, codes: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment: as many as make them about log2(codes) bits long, but 16 to 20, none across two words. With no
    fewer than 16 bits a round asks for the same number of values whatever the table's size: look-ups grow with the queries alone."""
    most = min(20, max(16, round(math.log2(max(codes, 2)))))
    out = []
    for start in range(0, max(d, 1), 64):
        here = max(1, min(64, d - start))
        m = max(1, -(-here // most))
        edges = [start + here * i // m for i in range(m + 1)]
        out += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def _segment(words: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.get(words, F.lit(first // 64)), first % 64).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _ring(bits: int, r: int) -> Column:
    """The numbers of `bits` bits of which r are 1, as one literal."""
    return F.split(F.lit(",".join(str(sum(1 << b for b in c)) for c in combinations(range(bits), r))), ",").cast("array<int>")


def _distance(a: Column, b: Column, words: int) -> Column:
    out = F.lit(0)
    for w in range(words):
        out = out + F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w))))
    return out.cast("int")


def search(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, hamming: for each row whose id is divisible by `every`, the k nearest others by the Hamming
    distance of the signs of their components, ties to smaller ids; fewer if there are fewer. Rows that take no part: see
    vectors.usable. Repeated rows of one id are told apart from the query by their id only: all are left out for it. Vectors whose codes are
    equal become one before they are compared. An empty table gives no rows; other columns are ignored."""
    rows, d = usable(vectors, id_col, vector_col)
    words = -(-d // 64)
    coded = settle(rows.select("vec_id", (sign_words(F.col("v"), d) if d else F.array(F.lit(0).cast("long"))).alias("v")))
    codes = distinct_with_ids(coded.select("vec_id", "v").distinct(), F.col("v"), k + 1)
    queries = settle(coded.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qkey")).distinct())
    left = settle(queries.select("qkey").distinct().withColumn("far", F.lit(1 << 30)))
    cut = segments(d, codes.count())
    m = len(cut)
    index = codes.select("key", "ids", F.posexplode(F.array(*[_segment(F.col("key"), *s) for s in cut])).alias("j", "value"))
    index = settle(index)
    found = None
    for r in range(max(bits for _, bits in cut) + 1):
        if not left.limit(1).count():
            break
        # Index j is asked only if what is covered before it doesn't reach the k-th distance yet.
        rings = [F.when((F.lit(m * r + j - 1) < F.col("far")) & F.lit(r <= bits), _ring(bits, r)) for j, (_, bits) in enumerate(cut)]
        probe = left.select("qkey", "far", F.posexplode(F.array(*rings)).alias("j", "ring")).where("ring is not null")
        qseg = F.get(F.array(*[_segment(F.col("qkey"), *s) for s in cut]), F.col("j"))
        probe = probe.select("qkey", "far", "j", qseg.alias("own"), F.explode("ring").alias("mask")).select("qkey", "far", "j", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        met = probe.join(index, ["j", "value"])
        # A code is taken where it is met first: in the round of its nearest segment, and of those in the first.
        near = F.lit(True)
        for j, s in enumerate(cut):
            apart = F.bit_count(_segment(F.col("qkey"), *s).bitwiseXOR(_segment(F.col("key"), *s)))
            near = near & F.when(F.col("j") > j, apart > r).otherwise(apart >= r)
        met = met.where(near).withColumn("hamming", _distance(F.col("qkey"), F.col("key"), words)).where("hamming <= far").select("qkey", "ids", "hamming")
        found = settle(_best(met if found is None else found.unionAll(met), k))
        left = left.select("qkey").join(_kth(found, k), "qkey", "left").select("qkey", F.coalesce("kth", F.lit(1 << 30)).alias("far"))
        left = settle(left.where(F.col("far") > m * (r + 1) - 1))
    if found is None:
        found = coded.select(F.col("v").alias("qkey"), F.array("vec_id").alias("ids"), F.lit(0).alias("hamming")).limit(0)
    return ranked(found, queries, "hamming", k)


def _best(met: DataFrame, k: int) -> DataFrame:
    """The nearest codes of each query that hold its k + 1 nearest ids."""
    from pyspark.sql import Window

    hits = met.select("qkey", "hamming", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qkey").orderBy("hamming", "vec_id")
    return hits.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k + 1).select("qkey", F.array("vec_id").alias("ids"), "hamming")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """The distance of the (k + 1)-th id of each query that has as many: its own may be among them."""
    return found.groupBy("qkey").agg(F.count(F.lit(1)).alias("n"), F.max("hamming").alias("kth")).where(F.col("n") > k).select("qkey", "kth")


def op2_hamming(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_hamming": op2_hamming}

ORACLE = {
    "op2_hamming": """
with v as (select vec_id, embedding as e from embeddings where embedding is not null),
s as (select vec_id, list_transform(e, lambda x: case when x > 0 then 1 else 0 end) as b from v where len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select q.vec_id as query_id, s.vec_id, list_sum(list_transform(list_zip(q.b, s.b), lambda z: case when z[1] <> z[2] then 1 else 0 end))::int as hamming
  from s q join s on q.vec_id % 100 = 0 and s.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by hamming, vec_id)::int as rank, vec_id, hamming from p)
select query_id, rank, vec_id, hamming from r where rank <= 10
""",
}
