"""Vectors for the searches: which take part, and copies told once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(rows vec_id, v, the dimension). Left out: null and zero vectors, those with null, NaN or infinite components, and those
    whose length isn't the most frequent one (of two as frequent, the larger)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False)) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    return rows.where(F.size("v") == d), d


def distinct_with_ids(rows: DataFrame, key: Column, k: int) -> DataFrame:
    """key, ids: each distinct key with its k smallest vec_ids. Copies tie, and ties go to smaller ids, so no more are ever needed.

    The first ids are picked before rows are moved, so a key that most rows share is no large group.
    """
    order = Window.partitionBy("key").orderBy("vec_id")
    few = rows.select(key.alias("key"), "vec_id").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    return settle(few.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))


def ranked(found: DataFrame, queries: DataFrame, measure: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, measure. found: qkey, ids, measure. queries: query_id, qkey. A query's own id is left out."""
    hits = found.select("qkey", measure, F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qkey").orderBy(measure, "vec_id")
    best = settle(hits.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k + 1).drop("__r"))
    mine = queries.join(best, "qkey").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(measure, "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", measure)
