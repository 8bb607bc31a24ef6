"""Scans that take several kinds of files as one table: documents by suffix, registry and packs, district rules, map services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packs import read_text_documents

#: Fields of a document in JSON; others are left out.
FIELDS = ("source_id", "title", "excerpt", "full_text", "section_ref", "jurisdiction_id", "url", "effective_date", "source_type", "retrieved_at", "source_version")
PUBLIC = "public_supported"


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, v): each file whole, as a variant (null where it is no JSON); a path that isn't there has no files."""
    read = spark.read.option("wholetext", True)
    try:
        texts = (read.option("recursiveFileLookup", True).option("pathGlobFilter", glob) if glob else read).text(path)
    except Exception as error:  # only a missing path is an empty table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, value string").select("path", F.try_parse_json("value").alias("v"))
    return texts.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))


def _first(v: Column, *paths: str) -> Column:
    """The first scalar that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, p, "string")), F.lit("")) for p in paths])


def _list(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all .md, .txt and .json files below a folder: path, the FIELDS, districts, uses.

    A JSON file holds one object or a list; an empty excerpt is the beginning of the text. Of one source_id the last counts, by path and place
    in the file. Objects without a source_id, and files that are no JSON, give no rows (see unreadable).
    """
    items = _files(spark, folder, "*.[jJ][sS][oO][nN]").select("path", F.posexplode(F.coalesce(_list(F.col("v")), F.array("v"))).alias("place", "x"))
    tags = lambda name: F.coalesce(F.try_variant_get("x", f"$.{name}", "array<string>"), F.split(F.try_variant_get("x", f"$.{name}", "string"), r"\s*,\s*")).alias(name)
    objects = items.select("path", "place", *[F.try_variant_get("x", f"$.{c}", "string").alias(c) for c in FIELDS], tags("districts"), tags("uses"))
    texts = read_text_documents(spark, folder).withColumnRenamed("body", "full_text").withColumn("place", F.lit(0)).drop("is_markdown")
    listed = [F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "").alias(c) for c in ("districts", "uses")]
    texts = texts.select(*[c for c in texts.columns if c not in ("districts", "uses")], *listed)
    rows = objects.unionByName(texts, allowMissingColumns=True).where(F.coalesce("source_id", F.lit("")) != "")
    last = rows.groupBy("source_id").agg(F.max(F.struct("path", "place")).alias("__at"))
    rows = rows.join(last, "source_id").where((F.col("path") == F.col("__at.path")) & (F.col("place") == F.col("__at.place"))).drop("__at", "place")
    return rows.withColumn("excerpt", F.coalesce(F.nullif("excerpt", F.lit("")), F.substring("full_text", 1, 500)))


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of .json files below a folder that hold neither an object nor a list."""
    kind = F.schema_of_variant("v")
    return _files(spark, folder, "*.[jJ][sS][oO][nN]").where(F.col("v").isNull() | ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))).select("path")


def source_refs(spark: SparkSession, registry: str, packs: str) -> DataFrame:
    """What a check of freshness reads of the registry's sources and of those of all packs (manifest.json below a folder): source_id, url,
    retrieved_at, coverage_status, origin (the file), place.

    retrieved_at and coverage_status may stand in metadata; a pack's own status goes first. Either may be missing; a file that holds no
    list of sources gives none; a source without an id is '<missing>'.
    """
    listed = _files(spark, registry).select("path", F.lit(None).cast("string").alias("pack"), F.posexplode(_list(F.col("v"))).alias("place", "x"))
    packed = _files(spark, packs, "manifest.json").select("path", _first(F.col("v"), "$.jurisdiction.coverage_status").alias("pack"), F.posexplode(_list(F.col("v"), "$.sources")).alias("place", "x"))
    x, none = F.col("x"), F.lit("")
    return listed.unionByName(packed).select(
        F.coalesce(_first(x, "$.source_id"), F.lit("<missing>")).alias("source_id"), F.coalesce(F.try_variant_get(x, "$.url", "string"), none).alias("url"), _first(x, "$.retrieved_at", "$.metadata.retrieved_at").alias("retrieved_at"),
        F.coalesce("pack", _first(x, "$.coverage_status", "$.metadata.coverage_status"), none).alias("coverage_status"), F.col("path").alias("origin"), "place",
    )


def stale_refs(refs: DataFrame, as_of: str, days: int) -> DataFrame:
    """(origin, source_id, issue, age, level) of refs that aren't fresh at a date: 'url' without http(s), 'undated', or 'old' (more than `days`
    days). Of one id in one file the first counts. level is error for public sources, else warning. Dates are ISO, with or without time and hyphens."""
    once = refs.groupBy("origin", "source_id").agg(F.min_by(F.struct("url", "retrieved_at", "coverage_status"), "place").alias("r")).select("origin", "source_id", "r.*")
    at = F.col("retrieved_at")
    day = F.when(at.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(at, 1, 10)).when(at.rlike("^[0-9]{8}($|T)"), F.regexp_replace(F.substring(at, 1, 8), "^(.{4})(..)(..)$", "$1-$2-$3")).try_cast("date")
    out = once.withColumn("web", F.col("url").rlike("^https?://")).withColumn("age", F.when(F.col("web"), F.datediff(F.lit(as_of).cast("date"), day)))
    issue = F.when(~F.col("web"), "url").when(F.col("age").isNull(), "undated").when(F.col("age") > days, "old")
    return out.select("origin", "source_id", issue.alias("issue"), "age", F.when(F.col("coverage_status") == PUBLIC, "error").otherwise("warning").alias("level")).where("issue is not null")


def read_district_rules(spark: SparkSession, path: str) -> DataFrame:
    """One row: city_defaults (map of city to district) and component_rules (array of JSON texts). A file that isn't there or holds no object, and
    defaults that are no object, give the default 'unknown'; rules that are no list give none."""
    v = F.col("v")
    unknown = F.create_map(F.lit("default"), F.lit("unknown"))
    of = F.try_variant_get(v, "$.city_defaults", "map<string,string>")
    left_out = F.schema_of_variant(v).startswith("OBJECT") & F.try_variant_get(v, "$.city_defaults", "variant").isNull()
    rules = F.transform(F.coalesce(_list(v, "$.component_rules"), F.array().cast("array<variant>")), lambda x: F.to_json(x))
    return _files(spark, path).agg(F.first("v").alias("v")).select(F.when(left_out, F.create_map().cast("map<string,string>")).otherwise(F.coalesce(of, unknown)).alias("city_defaults"), rules.alias("component_rules"))


def read_map_services(spark: SparkSession, path: str) -> DataFrame:
    """(jurisdiction_id, config as JSON) of a file with an object of jurisdictions; none where it isn't there or is broken."""
    return _files(spark, path).select(F.explode(F.try_variant_get("v", "$.jurisdictions", "map<string,variant>")).alias("jurisdiction_id", "c")).select("jurisdiction_id", F.to_json("c").alias("config"))
