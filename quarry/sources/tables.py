"""Tables by name, and documents seen as sources of a corpus."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sources(documents: DataFrame) -> DataFrame:
    """documents as sources: source_id, jurisdiction_id, section_ref, source_type, title, districts, uses, effective_date, full_text.

    The tags follow from doc_id: every seventh document is for all districts ('*'), the next is untagged ('unknown'); every sixth is of
    general use, the next holds principal uses.
    """
    n = F.col("doc_id")
    districts = F.when(n % 7 == 0, F.array(F.lit("*"))).when(n % 7 == 1, F.array(F.lit("unknown"))).otherwise(F.array(F.concat(F.lit("d"), n % 5)))
    use = F.concat(F.lit("u"), n % 3)
    uses = F.when(n % 6 == 0, F.array(F.lit("general"))).when(n % 6 == 1, F.array(F.lit("principal_uses"), use)).otherwise(F.array(use))
    date = F.when(n % 9 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "yyyy-MM-dd"))
    return documents.select(
        F.concat(F.lit("doc-"), n).alias("source_id"), n.alias("doc_id"), F.when(n % 11 == 0, "*").otherwise(F.col("lang")).alias("jurisdiction_id"), F.when(n % 13 == 0, "").otherwise(F.col("source")).alias("section_ref"),
        F.when(n % 4 == 0, "zoning_ordinance").otherwise("guide").alias("source_type"), F.concat(F.lit("Title "), n % 50).alias("title"), districts.alias("districts"), uses.alias("uses"), date.alias("effective_date"), F.col("text").alias("full_text"),
    )


def requests(benchmark: DataFrame) -> DataFrame:
    """benchmark items as retrieval requests: qid, jurisdiction_id, district, use, description."""
    n = F.col("item_id")
    jurisdiction = F.get(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("es")), (n % 4).cast("int"))
    district = F.when(n % 6 == 5, "unknown").otherwise(F.concat(F.lit("d"), n % 5))
    return benchmark.select(n.alias("qid"), jurisdiction.alias("jurisdiction_id"), district.alias("district"), F.concat(F.lit("u"), n % 3).alias("use"), F.col("text").alias("description"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session that has none gets a temporary one."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if found:
        return found.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, so that later rounds and lost executors read it there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
