"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors, less their mean and of unit length, are turned by a random rotation into a space of more dimensions; the code
keeps the sign of each. Queries, turned alike, are rounded to 4 bits a dimension, so that an inner product with a code is
a few AND and bit counts of packed words. With a code's two scalars (length, and inner product of the vector with its own
code) it estimates the distance, with a bound on the error that holds with high probability. Only vectors whose lower
bound is below the k-th smallest upper bound are compared exactly. All vectors are coded; queries and codes meet in
blocks of bounded size, a code's vector beside it, so that only the nearest of a block leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table, tidy
from .vectors import distinct_with_ids, ranked, usable

SEED = 3


def rotation(d: int, bits: int, seed: int = SEED) -> np.ndarray:
    """[bits, d] with orthonormal columns."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, d)))[0].astype("f4")


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, lengths, inner products of the unit vectors with their codes) of the rows of x."""
    r = x - mean
    length = np.sqrt((r * r).sum(1))
    y = (r / np.maximum(length, 1e-30)[:, None]).astype("f4") @ turn.T
    own = np.abs(y).sum(1) / np.sqrt(turn.shape[0])
    return np.packbits(y > 0, axis=1), length, np.maximum(own, 1e-6)


PLANES = 4


def rounded(q: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distance to the mean, bit planes [query, plane, word], least value, step, sum of values) of turned unit queries."""
    r = q - mean
    far = np.sqrt((r * r).sum(1))
    y = (r / np.maximum(far, 1e-30)[:, None]).astype("f4") @ turn.T
    low = y.min(1)
    step = np.maximum((y.max(1) - low) / (2**PLANES - 1), 1e-12)
    level = np.rint((y - low[:, None]) / step[:, None]).astype("u1")
    planes = np.stack([np.packbits(level >> p & 1, axis=1) for p in range(PLANES)], 1)
    return far, planes, low, step, y.sum(1)


def bounds(codes: np.ndarray, ones: np.ndarray, length: np.ndarray, own: np.ndarray, query: tuple, n: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of one rounded query to codes [code, word of 64 bits]."""
    far, planes, low, step, total = query
    met = sum(np.bitwise_count(codes & planes[p].view("u8")).sum(1, dtype="i4") << p for p in range(PLANES))
    guess = (2 * (low * ones + step * met) - total) / np.sqrt(n) / own
    error = sure * (np.sqrt(np.maximum(1 - own**2, 0) / (n - 1)) + step / np.sqrt(12)) / own
    both, cross = far**2 + length**2, 2 * far * length
    slack = 1e-5 * (both + 1e-12)
    return both - cross * np.minimum(guess + error, 1) - slack, both - cross * np.maximum(guess - error, -1) + slack


def search(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", k: int = 10, every: int = 100, times: int = 4, sure: float = 2.3, shard: int = 65_536, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest others by Euclidean distance,
    ties to smaller ids; fewer if there are fewer. score is the exact distance in double precision. times: bits of a code for each
    dimension; sure: half-widths of the error bound; shard and block bound the codes and queries a task holds. Rows that take no part: see
    vectors.usable. Equal vectors become one before they are compared. An empty table gives no rows; other columns are ignored."""
    rows, d = usable(vectors, id_col, vector_col)
    rows = settle(rows.select("vec_id", F.col("v").cast("array<double>").alias("v")).distinct())
    # A vector's smallest id and a hash name it.
    keyed = settle(distinct_with_ids(rows, F.col("v"), k + 1).withColumn("code_id", F.xxhash64("key", F.element_at("ids", 1))))
    queries = settle(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").join(keyed.select(F.col("key").alias("v"), "code_id"), "v").select(F.col("vec_id").alias("query_id"), F.col("code_id").alias("qkey")))
    total = keyed.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sums = rows.select(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(d)]).collect()[0]
    mean, seed, n = np.array([sums[i] for i in range(d)]), SEED, -(-times * d // 64) * 64

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d, n, seed)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                packed, length, own = encode(part.column(1).flatten().to_numpy().reshape(-1, d), mean, turn)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([b.tobytes() for b in packed], pa.binary()), pa.array(length, pa.float64()), pa.array(own.astype("f8"), pa.float64()), part.column(1)], ["code_id", "v_id", "bits", "length", "own", "x"])

    coded = keyed.select("code_id", "key", F.element_at("ids", 1).alias("v_id")).mapInArrow(tidy(code), "code_id long, v_id long, bits binary, length double, own double, x array<double>")
    asked = settle(queries.select("qkey").distinct().join(keyed.select(F.col("code_id").alias("qkey"), F.col("key").alias("q")), "qkey"))
    shards, blocks = -(-total // shard), max(1, -(-asked.count() // block))
    left = asked.withColumn("b", F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = coded.withColumn("s", F.pmod(F.xxhash64("code_id"), F.lit(shards)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"qkey": np.zeros(0, "i8"), "code_id": np.zeros(0, "i8")})]
        if not len(q) or not len(c):
            return found[0]
        asked, x = np.stack(q["q"].to_numpy()), np.stack(c["x"].to_numpy())
        told = rounded(asked, mean, rotation(d, n, seed))
        codes, names = np.frombuffer(b"".join(c["bits"]), "u8").reshape(len(c), -1), c["code_id"].to_numpy()
        ones, length, own, first = np.bitwise_count(codes).sum(1, dtype="i4"), c["length"].to_numpy(), c["own"].to_numpy(), c["v_id"].to_numpy()
        for i, qkey in enumerate(q["qkey"]):
            low, high = bounds(codes, ones, length, own, tuple(t[i] for t in told), n, sure)
            near = np.flatnonzero(low <= np.partition(high, k)[k]) if len(high) > k else np.arange(len(high))
            far = ((x[near] - asked[i]) ** 2).sum(1)
            best = near[np.lexsort((first[near], far))[: k + 1]]
            found.append(pd.DataFrame({"qkey": np.full(len(best), qkey), "code_id": names[best]}))
        return pd.concat(found[1:], ignore_index=True)

    # The k + 1 nearest of each shard, one of which may be the query itself; their exact distances decide.
    chosen = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(compare, "qkey long, code_id long")
    exact = chosen.join(asked, "qkey").join(keyed.select("code_id", "ids", "key"), "code_id")
    apart = F.aggregate(F.zip_with("key", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return ranked(exact.select("qkey", "ids", F.sqrt(apart).alias("score")), queries, "score", k)


def op8_nearest(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_nearest": op8_nearest}
ORACLE: dict[str, str] = {}
