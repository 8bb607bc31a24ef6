"""Readers and writers of the corpus files: source packs, text documents with front matter, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "source_id string, title string, excerpt string, section_ref string, jurisdiction_id string, url string, effective_date string, districts array<string>, uses array<string>, source_type string, retrieved_at string, full_text string, metadata map<string,string>"
MANIFEST = f"schema_version string, jurisdiction struct<jurisdiction_id:string,name:string,coverage_status:string,state:string>, sources array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in SOURCE.split(', '))}>>"
#: The keys of a text document's front matter.
KEYS = ("source_id", "title", "section_ref", "jurisdiction_id", "url", "effective_date", "districts", "uses", "source_type", "retrieved_at", "source_version")


def read_packs(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each source of every manifest.json below a folder, with path and place; an unreadable manifest gives one row with its text in broken."""
    read = spark.read.schema(f"{MANIFEST}, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(folder)
    rows = read.select(F.col("_metadata.file_path").alias("path"), "jurisdiction", "broken", F.posexplode_outer("sources").alias("place", "s"))
    return rows.select("path", "place", "broken", F.coalesce("s.jurisdiction_id", "jurisdiction.jurisdiction_id").alias("jurisdiction_id"), *[f"s.{c.split()[0]}" for c in SOURCE.split(", ") if not c.startswith("jurisdiction_id")])


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """pos, title_contains, contains, districts, uses of every classification_rules.json below a folder, by path."""
    read = spark.read.schema("rules array<struct<article_contains:string,division_contains:string,title_contains:string,contains:string,districts:array<string>,uses:array<string>>>").option("multiLine", True)
    rows = read.option("recursiveFileLookup", True).option("pathGlobFilter", "classification_rules.json").json(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode("rules").alias("pos", "r")).select("path", "pos", "r.*")


def read_text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each .md and .txt file below a folder: the front matter's keys, body, is_markdown; of files of one source_id the last path wins.

    Front matter is the leading lines 'key: value' of known keys. The title falls back to the first # line, then to the file's name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(folder)
    rows = files.select("path", F.regexp_replace(F.decode("content", "utf-8"), "\r\n", "\n").alias("text"))
    front = F.regexp_extract("text", r"^((?:(?:" + "|".join(KEYS) + r"):[^\n]*(?:\n|$))*)", 1)
    pairs = F.transform(F.filter(F.split("front", "\n"), lambda x: x != ""), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    rows = rows.withColumn("front", front).withColumn("keys", F.map_from_entries(pairs)).withColumn("body", F.trim(F.expr("substring(text, length(front) + 1)")))
    stem = F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1)
    title = F.coalesce(F.nullif(F.col("keys")["title"], F.lit("")), F.nullif(F.regexp_extract("body", r"(?m)^#\s+([^\n]+)", 1), F.lit("")), F.initcap(F.translate(stem, "-_", "  ")))
    out = rows.select("path", F.coalesce(F.col("keys")["source_id"], F.lower(stem)).alias("source_id"), title.alias("title"), *[F.col("keys")[k].alias(k) for k in KEYS[2:]], "body", F.lower("path").endswith(".md").alias("is_markdown"))
    last = out.groupBy("source_id").agg(F.max("path").alias("path"))
    return out.join(last, ["source_id", "path"])


def write_json_lines(rows: DataFrame, path: str, *columns: str) -> None:
    rows.select(F.to_json(F.struct(*columns)).alias("value")).write.text(path)


def request_lines(chunks: DataFrame, dims: int) -> DataFrame:
    """One request to embed each chunk, as a JSON line."""
    content = F.struct(F.array(F.struct(F.col("chunk_text").alias("text"))).alias("parts"))
    return chunks.select(F.to_json(F.struct(F.col("chunk_id").alias("key"), F.struct(content.alias("content"), F.lit(dims).alias("output_dimensionality")).alias("request"))).alias("value"))


def result_lines(lines: DataFrame) -> DataFrame:
    """(key, values) of result lines, whichever of three shapes they have; values is null where none fits."""
    kind = "key string, response struct<embedding:struct<values:array<double>>>, embedding struct<values:array<double>>, values array<double>"
    j = lines.select(F.from_json("value", kind).alias("j"))
    return j.select("j.key", F.coalesce("j.response.embedding.values", "j.embedding.values", "j.values").alias("values"))
