"""Source packs checked as a whole: every pack and source at once, to one table of issues and one of counts.

packs: path, schema_version, verification_notes, jurisdiction struct, sources array<struct>; a missing field is null, an empty one ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validation import url_problem

# What a pack may and must hold.
VERSION = "1.0"
COVERAGE = ("source_discovery", "source_indexed", "qa_ready", "public_supported")
JURISDICTION_TYPES = ("municipality", "county", "independent_city", "state", "regional_authority", "special_district")
SOURCE_TYPES = ("zoning_ordinance", "zoning_map", "planning_page", "permit_page", "building_code", "health_code", "fire_code", "gis_layer", "fee_schedule", "application_form", "state_law")
GLOBAL_TYPES = ("building_code", "health_code", "fire_code", "state_law")
JURISDICTION_FIELDS = ("jurisdiction_id", "name", "coverage_status", "state", "state_fips", "county_fips", "place_fips", "jurisdiction_type", "parent_jurisdiction_id", "official_source_urls", "zoning_map_url", "planning_contact")
SOURCE_FIELDS = ("source_id", "title", "section_ref", "jurisdiction_id", "url", "effective_date", "source_type", "districts", "uses")
#: Topics of a zoning ordinance, and how they are worded.
MARKERS = {
    "lot area": r"minimum lot area|lot area of|minimum lot size",
    "yards": r"\b(front|rear|side) yard\b",
    "setbacks": r"\bsetback",
    "height limits": r"maximum height|building height|height limit",
    "permitted uses": r"permitted uses|uses permitted|principal permitted|uses are permitted",
    "district regulations": r"district regulations|districts are hereby established|zoning districts established",
    "lot width": r"minimum lot width|lot width of|minimum width",
    "density": r"dwelling units per acre|maximum density|units per acre",
}
LEAST_ORDINANCES, ERROR_BELOW, WARNING_BELOW = 3, 5, 7

PACK = (
    "path string, schema_version string, verification_notes string, jurisdiction struct<jurisdiction_id:string,name:string,coverage_status:string,state:string,state_fips:string,county_fips:string,place_fips:string,jurisdiction_type:string,parent_jurisdiction_id:string,"
    "official_source_urls:array<string>,zoning_map_url:string,planning_contact:struct<url:string,email:string,phone:string>>, sources array<struct<source_id:string,title:string,section_ref:string,jurisdiction_id:string,url:string,effective_date:string,source_type:string,"
    "districts:array<string>,uses:array<string>,excerpt:string,full_text:string,metadata:struct<curated_local_fallback:boolean,fallback_reason:string,applies_to_states:array<string>>>>"
)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _issue(when: Column, text: Column | str, severity: str = "error") -> Column:
    return F.when(when, F.struct(F.lit(severity).alias("severity"), (text if isinstance(text, Column) else F.lit(text)).alias("issue")))


def _url(url: Column, name: str, local_ok: Column | bool = False) -> Column:
    problem = url_problem(url, local_ok)
    return _issue(problem.isNotNull(), F.concat(F.lit(f"{name}: "), problem))


def _one_of(c: Column, name: str, allowed: tuple[str, ...]) -> list[Column]:
    return [_issue((_text(c) != "") & ~_text(c).isin(*allowed), f"{name}: not allowed"), _issue(c.isNotNull() & (_text(c) == ""), f"{name}: empty")]


def _told(rows: DataFrame, *issues: Column) -> DataFrame:
    return rows.select("path", "place", F.explode(F.array_compact(F.array(*issues))).alias("i")).select("path", "place", "i.severity", "i.issue")


def pack_issues(packs: DataFrame) -> DataFrame:
    """(path, place, severity, issue): place is a source's index, null for the pack's own issues.

    Sources travel without their texts; only the topics that each ordinance's text holds are summed per pack. A repeated source_id is an
    issue from its second place on, by path and place.
    """
    j = F.col("jurisdiction")
    none = packs.withColumn("place", F.lit(None).cast("int"))
    contact = j["planning_contact"]
    own = _told(
        none, _issue(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "schema_version"), _issue(j.isNull(), "jurisdiction: no object"), _issue(_text(F.col("verification_notes")) == "", "verification_notes"), _issue(F.coalesce(F.size("sources"), F.lit(0)) <= 0, "sources: none"),
        *[_issue(j[f].isNull(), f"jurisdiction.{f}: required") for f in JURISDICTION_FIELDS], *[_issue(j[f].isNotNull() & (_text(j[f]) == ""), f"jurisdiction.{f}: empty") for f in ("jurisdiction_id", "name", "state")],
        *_one_of(j["coverage_status"], "jurisdiction.coverage_status", COVERAGE), *_one_of(j["jurisdiction_type"], "jurisdiction.jurisdiction_type", JURISDICTION_TYPES),
        _issue(F.coalesce(F.size(j["official_source_urls"]), F.lit(0)) <= 0, "jurisdiction.official_source_urls: none"), _issue(contact.isNull(), "jurisdiction.planning_contact: no object"),
        _issue(contact.isNotNull() & (F.concat(*[_text(contact[f]) for f in ("url", "email", "phone")]) == ""), "jurisdiction.planning_contact: empty"), F.when(_text(j["zoning_map_url"]) != "", _url(j["zoning_map_url"], "jurisdiction.zoning_map_url")), F.when(_text(contact["url"]) != "", _url(contact["url"], "jurisdiction.planning_contact.url")),
    )
    urls = packs.select("path", F.lit(None).cast("int").alias("place"), F.explode(j["official_source_urls"]).alias("url"))
    official = _told(urls, _url(F.col("url"), "jurisdiction.official_source_urls"))

    text = F.lower(F.concat_ws(" ", "s.excerpt", "s.full_text"))
    rows = packs.select("path", _text(j["jurisdiction_id"]).alias("pack"), _text(j["parent_jurisdiction_id"]).alias("parent"), F.upper(_text(j["state"])).alias("state"), F.posexplode("sources").alias("place", "s"))
    ordinance = _text(F.col("s.source_type")) == "zoning_ordinance"
    slim = rows.select("path", "pack", "parent", "state", "place", F.col("s").dropFields("excerpt", "full_text").alias("s"), (_text(F.col("s.excerpt")) == "").alias("no_excerpt"), (_text(F.col("s.full_text")) == "").alias("no_text"), F.when(ordinance, F.array(*[text.rlike(p) for p in MARKERS.values()])).alias("topics"))
    s, m = F.col("s"), F.col("s.metadata")
    local = F.coalesce(m["curated_local_fallback"], F.lit(False))
    districts = F.filter(F.transform(s["districts"], lambda x: F.lower(_text(x))), lambda x: x != "")
    filled = lambda c: F.coalesce(F.size(F.filter(c, lambda x: _text(x) != "")), F.lit(0)) > 0
    where = _text(s["jurisdiction_id"])
    elsewhere = (where != "") & (where != F.col("pack")) & ~((F.col("parent") != "") & (where == F.col("parent")))
    states = F.transform(F.coalesce(m["applies_to_states"], F.array().cast("array<string>")), lambda x: F.upper(_text(x)))
    stated = _told(
        slim, *[_issue(s[f].isNull(), f"{f}: required") for f in SOURCE_FIELDS], _issue(F.col("no_excerpt") & F.col("no_text"), "excerpt or full_text: required"), *[_issue(s[f].isNotNull() & (_text(s[f]) == ""), f"{f}: empty") for f in ("source_id", "title", "section_ref", "jurisdiction_id", "effective_date")],
        *_one_of(s["source_type"], "source_type", SOURCE_TYPES), _url(s["url"], "url", local), _issue(local & (_text(m["fallback_reason"]) == ""), "metadata.fallback_reason: required"), _issue(~filled(s["districts"]), "districts: none"), _issue((F.size(districts) == 1) & (districts[0] == "unknown"), "districts: only unknown", "warning"), _issue(~filled(s["uses"]), "uses: none"),
        _issue(elsewhere & (where != "*"), "jurisdiction_id: another's"), _issue(elsewhere & (where == "*") & ~F.coalesce(_text(s["source_type"]).isin(*GLOBAL_TYPES), F.lit(False)), "jurisdiction_id: '*' is for laws"), _issue(elsewhere & (where == "*") & ~((F.col("state") != "") & F.array_contains(states, F.col("state"))), "metadata.applies_to_states: not the pack's"),
    )
    ids = slim.select("path", "place", _text(s["source_id"]).alias("id")).where("id <> ''")
    again = ids.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("path", "place"))).where("n > 1").select("path", "place", F.lit("error").alias("severity"), F.lit("source_id: repeated").alias("issue"))

    seen = slim.where("topics is not null").groupBy("path").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.col("topics")[i]).alias(f"t{i}") for i in range(len(MARKERS))])
    found = sum((F.col(f"t{i}").cast("int") for i in range(len(MARKERS))), F.lit(0))
    missing = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"t{i}"), F.lit(k)) for i, k in enumerate(MARKERS)]))), ", ")
    thin = seen.where(F.col("n") >= LEAST_ORDINANCES).withColumn("found", found).where(F.col("found") < WARNING_BELOW)
    thin = thin.select("path", F.lit(None).cast("int").alias("place"), F.when(F.col("found") < ERROR_BELOW, "error").otherwise("warning").alias("severity"), F.concat(F.lit("topics missing: "), missing).alias("issue"))
    return reduce(DataFrame.unionByName, (own, official, stated, again, thin))


def pack_summary(packs: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, jurisdiction_id, sources, errors, warnings) of every pack, those without issues too."""
    counts = issues.groupBy("path").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = F.lit(0).cast("long")
    named = F.coalesce(F.nullif(_text(F.col("jurisdiction.jurisdiction_id")), F.lit("")), F.lit("unknown"))
    out = packs.select("path", named.alias("jurisdiction_id"), F.greatest(F.lit(0), F.coalesce(F.size("sources"), F.lit(0))).alias("sources")).join(counts, "path", "left")
    return out.select("path", "jurisdiction_id", "sources", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"))


def promoted(drafts: DataFrame, issues: DataFrame) -> DataFrame:
    """Packs without errors, as they are curated: their coverage is set to source_indexed whatever they state."""
    bad = issues.where("severity = 'error'").select("path").distinct()
    return drafts.join(bad, "path", "left_anti").withColumn("jurisdiction", F.col("jurisdiction").withField("coverage_status", F.lit("source_indexed")))
