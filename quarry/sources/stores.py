"""Tables of a store as Parquet folders: appended, merged, cut, and handed out. A merge writes a new version beside the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.pages import point_id
from quarry.operators.relational import upsert


def append(rows: DataFrame, folder: str) -> None:
    """Add rows to an event log (audit, usage, feedback, requests)."""
    rows.write.mode("append").parquet(folder)


def reset(spark: SparkSession, folder: str) -> None:
    """An empty table of the same columns."""
    spark.read.parquet(folder).limit(0).write.mode("overwrite").parquet(f"{folder}.empty")
    spark.read.schema(spark.read.parquet(f"{folder}.empty").schema).parquet(f"{folder}.empty").write.mode("overwrite").parquet(folder)


def merge(spark: SparkSession, folder: str, to: str, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at",)) -> None:
    """A new version of a table at `to`, with new's rows in place of those of their keys."""
    upsert(spark.read.parquet(folder), new, key, keep).write.parquet(to)


def points(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(point_id, vector, payload columns) of chunks with their vectors. ValueError if a chunk has none or one of another length."""
    joined = chunks.join(vectors.select("chunk_id", "vector"), "chunk_id", "left")
    bad = joined.where(F.col("vector").isNull() | (F.size("vector") != dims)).limit(1).count()
    if bad:
        raise ValueError("chunks and vectors differ in number or length")
    return joined.withColumn("point_id", point_id(F.col("chunk_id")))


def flat_payload(chunk_fields: dict[str, Column], metadata: Column) -> Column:
    """A chunk's fields as one map, with those of its metadata that don't clash with them; empty text for null."""
    own = F.create_map(*[x for k, v in chunk_fields.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])
    rest = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    return F.map_concat(own, rest)


def enriched(own: Column, registered: Column, defaults: Column) -> Column:
    """A source's metadata over that of its registered jurisdiction, and defaults for what both lack."""
    none = F.create_map().cast("map<string,string>")
    a, b, c = (F.coalesce(x, none) for x in (own, registered, defaults))
    both = F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))
    return F.map_concat(both, F.map_filter(c, lambda k, _: ~F.map_contains_key(both, k)))


def saved_analysis(analyses: DataFrame, projects: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analyses, projects) after new analyses (project, ...): one for each project, and its status is 'analyzed'."""
    kept = analyses.join(new.select("project"), "project", "left_anti").unionByName(new)
    done = new.select(F.col("project").alias("__p")).distinct()
    flipped = projects.join(done, F.col("project") == F.col("__p"), "left").withColumn("status", F.when(F.col("__p").isNotNull(), "analyzed").otherwise(F.col("status"))).drop("__p")
    return kept, flipped


def upsert_users(held: DataFrame, new: DataFrame) -> DataFrame:
    """users (user, email, tier, disabled, created): new e-mails win, tiers unless null, what is disabled stays so, and so does the creation."""
    n = new.select(F.col("user"), *[F.col(c).alias(f"n_{c}") for c in ("email", "tier", "disabled", "created")])
    both = held.join(n, "user", "full_outer")
    return both.select("user", F.coalesce("n_email", "email").alias("email"), F.coalesce("n_tier", "tier", F.lit("free")).alias("tier"), F.coalesce("disabled", "n_disabled", F.lit(False)).alias("disabled"), F.coalesce("created", "n_created").alias("created"))


def forget_users(users: DataFrame, projects: DataFrame, usage: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, audit and usage as one log) without the users: their projects go, their log rows stay without a name."""
    gone = users.select(F.col("user").alias("__u")).distinct()
    kept = projects.join(gone, F.col("user") == F.col("__u"), "left_anti")
    log = audit.unionByName(usage, allowMissingColumns=True).join(gone, F.col("user") == F.col("__u"), "left")
    return kept, log.withColumn("user", F.when(F.col("__u").isNull(), F.col("user"))).drop("__u")


def seeded(held: DataFrame, seed: DataFrame, key: str, version: str, audit: DataFrame) -> DataFrame:
    """held, or seed's valid rows over it if there is nothing yet or the audit (kind, version) doesn't know this version."""
    known = audit.where((F.col("kind") == "source.seed.completed") & (F.col("version") == version)).limit(1).count()
    return held if known and held.limit(1).count() else upsert(held, seed.where(F.col(key).isNotNull() & (F.col(key) != "")).select(held.columns), key)


def write_manifests(sources: DataFrame, folder: str, *columns: str) -> None:
    """A JSON manifest for each jurisdiction, with its sources of 10 characters and more in order, each in a folder of its own."""
    real = sources.where(F.length(F.trim(F.regexp_replace("full_text", r"\s+", " "))) >= 10)
    packed = real.groupBy("jurisdiction_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("sources"))
    value = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "jurisdiction_id", "sources"))
    packed.select("jurisdiction_id", value.alias("value")).write.partitionBy("jurisdiction_id").text(folder)


def enriched_registry(registry: DataFrame, scraped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with the full text of the first scraped section of its section_ref, scraped sections that no entry used)."""
    first = scraped.groupBy("section_ref").agg(F.min_by("full_text", "position").alias("__t"))
    out = registry.join(first, "section_ref", "left").withColumn("full_text", F.coalesce("__t", "full_text")).drop("__t")
    return out, scraped.join(registry.select("section_ref").distinct(), "section_ref", "left_anti")


def write_checklists(results: DataFrame, folder: str) -> None:
    """A text for each result (id, title, steps, documents, warnings): its parts under their headings, empty parts left out."""
    section = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")))
    text = F.concat_ws("\n\n", "title", section("Steps", F.col("steps")), section("Documents", F.col("documents")), section("Warnings", F.col("warnings")))
    results.select("id", text.alias("value")).write.partitionBy("id").text(folder)


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON files that hold a list of them; a file that is no list or isn't there gives none. path may be a glob."""
    kind = f"array<struct<{schema}>>"
    try:
        texts = spark.read.text(path, wholetext=True)
    except Exception as error:  # only a missing path is an empty table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ", ".join(x.replace(":", " ", 1) for x in schema.split(",")))
    rows = texts.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", kind)).alias("r"))
    return rows.where("r is not null").select("r.*")


def read_json_documents(spark: SparkSession, path: str, schema: str = "source_id:string,title:string,excerpt:string,full_text:string") -> DataFrame:
    """Documents of JSON files, one object or a list in each; an empty excerpt is the beginning of the text."""
    text = F.trim(F.col("value"))
    listed = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(listed, f"array<struct<{schema}>>")).alias("r")).select("r.*")
    return rows.withColumn("excerpt", F.coalesce(F.nullif("excerpt", F.lit("")), F.substring("full_text", 1, 500)))


def lacking(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, lacks): rows without some of the fields, and which."""
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]))
    return rows.select(key, gaps.alias("lacks")).where(F.size("lacks") > 0)


def supported(jurisdictions: DataFrame) -> DataFrame:
    """jurisdictions with supported, which follows from coverage_status."""
    return jurisdictions.withColumn("supported", F.coalesce(F.col("coverage_status") == "public_supported", F.lit(False)))
