"""Tables laid out for point look-ups: rows of a key lie in one bucket's folder, sorted, with a bloom filter on the key in each file.

A batch of keys names its buckets, so other folders are not listed; in the files that are read, ranges and bloom filters leave
out row groups that hold none of the keys.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "__bucket"
#: Keys up to which each is a condition of its own that files can be asked for; beyond it keys are joined.
FEW = 500


def write_keyed(rows: DataFrame, folder: str, key: str, *, buckets: int = 64, group_bytes: int = 8_000_000) -> None:
    """Write rows for look-ups by key. group_bytes: size of a row group, the least that is read for a key. Rows without a key can't be looked up and
    are left out; a bucket that a key of very many rows makes large is written by several tasks."""
    laid = rows.where(F.col(key).isNotNull()).withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    laid = laid.hint("rebalance", _BUCKET).sortWithinPartitions(_BUCKET, key)
    laid.write.option("parquet.block.size", group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true").option("maxRecordsPerFile", 5_000_000).partitionBy(_BUCKET).parquet(folder)


def look_up(spark: SparkSession, folder: str, key: str, keys: DataFrame, *, buckets: int = 64, few: int = FEW) -> DataFrame:
    """The rows of a folder of write_keyed() whose key is among keys (a table with that column, repeats and nulls of no meaning). Few keys are
    conditions of the scan itself; more are joined by bucket and key, so folders of no key are still left out."""
    wanted = keys.where(F.col(key).isNotNull()).select(key).distinct()
    rows = spark.read.parquet(folder)
    found = [r[0] for r in wanted.limit(few + 1).collect()]
    if not found:
        return rows.drop(_BUCKET).limit(0)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    if len(found) <= few:
        in_buckets = [r[0] for r in spark.createDataFrame([(x,) for x in found], wanted.schema).select(bucket).distinct().collect()]
        # Single conditions rather than a list: beyond ten values a list is asked of files as its range alone.
        either = functools.reduce(lambda a, b: a | b, [F.col(key) == F.lit(x) for x in found])
        return rows.where(F.col(_BUCKET).isin(in_buckets) & either).drop(_BUCKET)
    return rows.join(wanted.withColumn(_BUCKET, bucket), [_BUCKET, key], "left_semi").drop(_BUCKET)
