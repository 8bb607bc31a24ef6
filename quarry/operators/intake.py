"""From a request's address to its jurisdiction, parcel and district, from its description to an intake, and to a status.

Dimensions (jurisdictions, rules) are one row of a sorted array that meets each request; they are refused above a size.
Parcels are polygons: requests meet them by cells of a grid, and an exact test follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as X

# Statuses that may be answered, address keywords and what they stand for, in order.
SERVABLE = ("public_supported", "source_indexed")
ADDRESS_KEYWORDS = (
    ("downtown", "mixed-use-core"), ("market", "mixed-use-core"), ("industrial", "industrial-zone"), ("business park", "commercial-employment"), ("suburb", "residential-low-density"), ("residential", "residential-low-density"),
)
PARCEL_KEYWORDS = (
    ("downtown", "mixed-use-core"), ("main st", "mixed-use-core"), ("market", "mixed-use-core"), ("industrial", "industrial-zone"), ("business park", "commercial-employment"), ("suburb", "residential-low-density"), ("residential", "residential-low-density"),
)
GUESSED = ("keyword_fallback", "component_rule")


def servable(status: Column) -> Column:
    return F.coalesce(status.isin(*SERVABLE), F.lit(False))


def dimension(rows: DataFrame, order: str, name: str, most: int = 10_000) -> DataFrame:
    """A small table as one row: an array of its rows in order. ValueError if it isn't small."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"{name}: more than {most} rows are no dimension")
    columns = [order, *[c for c in rows.columns if c != order]]
    return rows.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def component(components: Column, kind: str, field: str = "long_name") -> Column:
    """The name of the first component of a kind, trimmed; '' without one. A missing short name is the long one."""
    found = F.get(F.filter(components, lambda c: F.array_contains(c["types"], kind)), F.lit(0))
    return F.coalesce(F.trim(F.coalesce(F.nullif(found[field], F.lit("")), found["long_name"])), F.lit(""))


def keyword_district(address: Column, rules: tuple[tuple[str, str], ...] = PARCEL_KEYWORDS) -> Column:
    """The district of the first keyword that an address holds; null without one."""
    lower = F.lower(address)
    return X.ladder(*[(lower.contains(word), district) for word, district in rules])


def component_district(components: Column, rules: Column, defaults: Column) -> Column:
    """By the first rule (type, name, district) that one of the components fits, then by the city, then 'default', then 'unknown'; an unknown
    one becomes district-<neighbourhood>, if there is such a component."""
    stated = F.filter(rules, lambda r: (F.trim(r["type"]) != "") & (F.trim(r["name"]) != ""))
    fits = F.filter(stated, lambda r: F.exists(components, lambda c: F.array_contains(c["types"], F.trim(r["type"])) & (F.lower(F.trim(c["long_name"])) == F.lower(F.trim(r["name"])))))
    cities = F.transform(F.filter(components, lambda c: F.array_contains(c["types"], "locality")), lambda c: F.try_element_at(defaults, F.trim(c["long_name"])))
    mapped = F.coalesce(F.trim(F.get(fits, F.lit(0))["district"]), F.get(F.array_compact(cities), F.lit(0)), F.try_element_at(defaults, F.lit("default")), F.lit("unknown"))
    near = F.filter(components, lambda c: F.arrays_overlap(c["types"], F.array(F.lit("sublocality_level_1"), F.lit("neighborhood"))) & (c["long_name"] != ""))
    slug = F.concat(F.lit("district-"), X.slugify(F.get(near, F.lit(0))["long_name"]))
    return F.when(mapped != "unknown", mapped).otherwise(F.coalesce(slug, F.lit("unknown")))


def us_jurisdiction(components: Column, address: Column) -> tuple[Column, Column]:
    """(id, name) made of a US address's components; null for other countries and without a state."""
    short, state = component(components, "administrative_area_level_1", "short_name"), component(components, "administrative_area_level_1")
    county, country = component(components, "administrative_area_level_2"), F.upper(component(components, "country", "short_name"))
    place = F.coalesce(*[F.nullif(component(components, k), F.lit("")) for k in ("locality", "postal_town", "sublocality")])
    known = country.isin("", "US", "USA") & (F.coalesce(F.nullif(short, F.lit("")), state) != "")
    label = F.coalesce(F.nullif(short, F.lit("")), state)
    county_slug = F.when(county != "", X.slugify(F.regexp_replace(county, " County", ""))).otherwise("unknown-county")
    made = F.concat_ws("-", F.lit("us"), X.slugify(label), county_slug, F.coalesce(X.slugify(place), F.lit("unincorporated")))
    return F.when(known, made), F.when(known, F.concat(F.coalesce(place, F.nullif(county, F.lit("")), address), F.lit(", "), label))


def resolve(requests: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """requests with jurisdiction_id, jurisdiction_name, coverage_status, method and jurisdiction_confidence.

    In turn: the stated id (1.0; 0.7 if it isn't registered); a jurisdiction that the address's components fit, counties last (0.95), or an id
    made of them; one whose locality or county and whose state the address names (0.85); nothing, with coordinates (0.2) or without (0).
    requests: address, lat, lng, explicit_id, components array<struct<types, long_name, short_name>>. jurisdictions: position,
    jurisdiction_id, name, coverage_status, match_strategy, localities, counties, states (arrays of names).
    """
    names = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x)).alias(c)
    slim = jurisdictions.select("position", "jurisdiction_id", "name", "coverage_status", "match_strategy", names("localities"), names("counties"), names("states"))
    met = requests.join(F.broadcast(dimension(slim, "position", "dims")))  # one row
    address = F.lower(F.coalesce("address", F.lit("")))
    parts = F.coalesce(F.col("components"), F.array().cast(requests.schema["components"].dataType))
    met = met.withColumn("__a", address).withColumn("__l", F.lower(component(parts, "locality"))).withColumn("__c", F.lower(component(parts, "administrative_area_level_2"))).withColumn("__s", F.lower(component(parts, "administrative_area_level_1")))
    said = lambda xs: F.exists(xs, lambda n: F.contains(F.col("__a"), n))
    told = lambda part, xs: F.when(F.col(part) != "", F.array_contains(xs, F.col(part))).otherwise(said(xs))

    def fits(j: Column) -> Column:
        local, county = told("__l", j["localities"]), told("__c", j["counties"])
        place = F.when(j["match_strategy"] == "county", county).when(j["match_strategy"] == "locality_and_county", local & (county | (F.col("__c") == ""))).otherwise(local)
        return place & told("__s", j["states"])

    first = lambda xs: F.get(xs, F.lit(0))
    by_id = first(F.filter("dims", lambda j: j["jurisdiction_id"] == F.col("explicit_id")))
    inner = F.coalesce(first(F.filter("dims", lambda j: (j["match_strategy"] != "county") & fits(j))), first(F.filter("dims", lambda j: (j["match_strategy"] == "county") & fits(j))))
    by_text = first(F.filter("dims", lambda j: (said(j["localities"]) | said(j["counties"])) & said(j["states"])))
    made_id, made_name = us_jurisdiction(parts, F.coalesce("address", F.lit("")))
    stated, geocoded = F.coalesce(F.col("explicit_id") != "", F.lit(False)), F.size(parts) > 0

    def found(j: Column, method: str, confidence: float) -> Column:
        return F.when(j.isNotNull(), F.struct(j["jurisdiction_id"].alias("id"), j["name"].alias("name"), j["coverage_status"].alias("status"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))

    def plain(id_: Column, name: Column, status: str | None, method: str, confidence: float) -> Column:
        return F.struct(id_.alias("id"), name.alias("name"), F.lit(status).alias("status"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    none = F.lit(None).cast("string")
    result = F.coalesce(
        F.when(stated, F.coalesce(found(by_id, "explicit", 1.0), plain(F.col("explicit_id"), F.col("explicit_id"), "unsupported", "explicit", 0.7))),
        F.when(geocoded, F.coalesce(found(inner, "geocode", 0.95), F.when(made_id.isNotNull(), plain(made_id, made_name, "unsupported", "geocode", 0.95)))),
        found(by_text, "fixture", 0.85),
        F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), plain(none, none, None, "geocode", 0.2)),
        plain(none, none, None, "unknown", 0.0),
    )
    met = met.withColumn("__r", result)
    return met.select(*requests.columns, F.col("__r.id").alias("jurisdiction_id"), F.col("__r.name").alias("jurisdiction_name"), F.col("__r.status").alias("coverage_status"), F.col("__r.method").alias("method"), F.col("__r.confidence").alias("jurisdiction_confidence"))


def parcels_at(points: DataFrame, parcels: DataFrame, cell: float) -> DataFrame:
    """(point columns, parcel_id, zoning_code): the parcel that each point lies in, of its town; of several the one of smallest id.

    points: qid, jurisdiction_id, lat, lng. parcels: parcel_id, jurisdiction_id, zoning_code, ring array<struct<x, y>> (x: lng, y: lat; closed or
    not). Parcels and points meet in cells of a grid, so a point is tested against the parcels near it only; inside is an odd number of edges
    crossed by the ray to the east. cell: about the size of a parcel; a parcel is copied to the cells of its bounding box.
    """
    at = lambda v: F.floor(v / cell).cast("long")
    least, most = lambda xs, f: F.array_min(F.transform(xs, lambda p: p[f])), lambda xs, f: F.array_max(F.transform(xs, lambda p: p[f]))
    spread = parcels.where(F.size("ring") >= 3).withColumn("cx", F.explode(F.sequence(at(least("ring", "x")), at(most("ring", "x"))))).withColumn("cy", F.explode(F.sequence(at(least("ring", "y")), at(most("ring", "y")))))
    near = points.withColumn("cx", at(F.col("lng"))).withColumn("cy", at(F.col("lat"))).join(spread, ["jurisdiction_id", "cx", "cy"])
    edges = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    crossed = F.filter(edges, lambda e: ((e["ay"] > F.col("lat")) != (e["by"] > F.col("lat"))) & (F.col("lng") < e["ax"] + (F.col("lat") - e["ay"]) / (e["by"] - e["ay"]) * (e["bx"] - e["ax"])))
    inside = near.where(F.size(crossed) % 2 == 1).groupBy("qid").agg(F.min(F.struct("parcel_id", "zoning_code")).alias("p"))
    return points.join(inside, "qid", "left").select(*points.columns, "p.parcel_id", "p.zoning_code")


def lookup_parcels(requests: DataFrame, fixtures: DataFrame, parcels: DataFrame, codes: DataFrame, cell: float = 0.01) -> DataFrame:
    """requests with parcel_id, zoning_district, zoning_code, district_method, district_confidence.

    In turn: the first fixture of the jurisdiction whose pattern the address holds; the parcel the coordinates lie in, with its code's district if
    the code (letters and digits only) is known, else none; a keyword of the address; nothing. fixtures: position, jurisdiction_id,
    address_pattern, parcel_id, zoning_district. codes: jurisdiction_id, code, district.
    """
    rows = requests.withColumn("__a", F.lower(F.coalesce("address", F.lit(""))))
    f = fixtures.where("coalesce(address_pattern, '') <> ''").select(F.col("jurisdiction_id").alias("__j"), "position", F.lower("address_pattern").alias("pattern"), F.col("parcel_id").alias("f_parcel"), F.col("zoning_district").alias("f_district"))
    hit = rows.join(f, (F.col("jurisdiction_id") == F.col("__j")) & F.contains("__a", "pattern")).groupBy("qid").agg(F.min_by(F.struct("f_parcel", "f_district"), "position").alias("f"))
    located = parcels_at(requests.where("lat is not null and lng is not null").select("qid", "jurisdiction_id", "lat", "lng"), parcels, cell).where("parcel_id is not null")
    known = codes.select("jurisdiction_id", X.normal_code(F.col("code")).alias("__code"), "district").groupBy("jurisdiction_id", "__code").agg(F.min("district").alias("g_district"))
    located = located.withColumn("__code", X.normal_code(F.col("zoning_code"))).join(known, ["jurisdiction_id", "__code"], "left").select("qid", F.struct(F.col("parcel_id").alias("id"), F.col("zoning_code").alias("code"), F.col("g_district").alias("district")).alias("g"))
    keyword = keyword_district(F.col("__a"))
    method = F.when(F.col("f").isNotNull(), "fixture").when(F.col("g.district").isNotNull(), "gis_lookup").when(F.col("g").isNotNull(), "gis_unmapped_district").when(keyword.isNotNull(), "keyword_fallback").otherwise("unknown")
    out = rows.join(hit, "qid", "left").join(located, "qid", "left").withColumn("district_method", method)
    chosen = lambda f, g, k: F.when(F.col("district_method") == "fixture", f).when(F.col("district_method").startswith("gis"), g).when(F.col("district_method") == "keyword_fallback", k)
    none = F.lit(None).cast("string")
    confidence = F.when(F.col("district_method").isin("fixture", "gis_lookup"), 0.9).when(F.col("district_method") == "keyword_fallback", 0.3).otherwise(0.0)
    return out.select(*requests.columns, chosen(F.col("f.f_parcel"), F.col("g.id"), none).alias("parcel_id"), chosen(F.col("f.f_district"), F.col("g.district"), keyword).alias("zoning_district"), chosen(none, F.col("g.code"), none).alias("zoning_code"), "district_method", confidence.alias("district_confidence"))


def clean_address(raw: Column) -> tuple[Column, Column]:
    """(the address with single spaces, its confidence): 0 below 5 characters, 0.3 unverified."""
    cleaned = X.collapse(F.coalesce(raw, F.lit("")))
    return cleaned, F.when(F.length(cleaned) < 5, 0.0).otherwise(0.3)


def normalize(requests: DataFrame, rules: Column, defaults: Column) -> DataFrame:
    """Resolved requests with their parcel, to support_status, district, district_method, district_confidence.

    'invalid' without an address, 'unsupported' where the jurisdiction isn't servable, both with an unknown district. Else the parcel's
    district, then the components', then a keyword's. Needs the columns of resolve, lookup_parcels and address_confidence.
    """
    valid, open_ = F.col("address_confidence") > 0, servable(F.col("coverage_status"))
    parts = F.coalesce(F.col("components"), F.array().cast(requests.schema["components"].dataType))
    by_parts = F.nullif(component_district(parts, rules, defaults), F.lit("unknown"))
    by_word = keyword_district(F.coalesce("address", F.lit("")), ADDRESS_KEYWORDS)
    ready = valid & open_
    found = F.coalesce("zoning_district", by_parts, by_word, F.lit("unknown"))
    method = F.when(F.col("zoning_district").isNotNull(), F.col("district_method")).when(by_parts.isNotNull(), "component_rule").when(by_word.isNotNull(), "keyword_fallback").otherwise("unknown")
    sure = F.when(F.col("zoning_district").isNotNull(), F.col("district_confidence")).when(by_parts.isNotNull() | by_word.isNotNull(), 0.3).otherwise(0.0)
    rest = [c for c in requests.columns if c not in ("district_method", "district_confidence")]
    return requests.select(*rest, F.when(~valid, "invalid").when(~open_, "unsupported").otherwise("supported").alias("support_status"), F.when(ready, found).otherwise("unknown").alias("district"), F.when(ready, method).otherwise("unknown").alias("district_method"), F.when(ready, sure).otherwise(0.0).alias("district_confidence"))


def intake(description: Column) -> Column:
    """What a description is about: inferred_use, use_type, project_scope, construction_scope, business_activity, triggers, missing_details,
    clarification_questions, confidence ('high' without missing details, 'low' from three on)."""
    t, missing = F.lower(description), X.missing_fields(description)
    use = F.when(X.has(t, *X.FOOD), "food-service").otherwise(X.inferred_use(description))
    food = use.isin("home-based-food-business", "food-business", "food-service")
    construction = X.ladder((X.has(t, "garage") & X.has(t, "convert", "conversion"), "garage_conversion"), (X.has(t, "interior", "renovation"), "interior_work"), (X.has(t, "addition", "build"), "new_construction"))
    activity = F.coalesce(X.ladder((X.has(t, "coffee", "cafe"), "coffee_shop"), (X.has(t, "bakery"), "bakery"), (X.has(t, "restaurant"), "restaurant")), F.when(use != "general", F.replace(use, F.lit("-"), F.lit("_"))))
    return F.struct(
        use.alias("inferred_use"), F.when(food, "food_service").otherwise(F.replace(use, F.lit("-"), F.lit("_"))).alias("use_type"), X.project_scope(description).alias("project_scope"), construction.alias("construction_scope"), activity.alias("business_activity"),
        X.triggers(description).alias("triggers"), missing.alias("missing_details"), F.transform(missing, lambda m: F.concat(F.lit("Please provide "), m, F.lit("."))).alias("clarification_questions"), F.when(F.size(missing) >= 3, "low").when(F.size(missing) > 0, "medium").otherwise("high").alias("confidence"),
    )


def asked_district(district: Column, confidence: Column) -> Column:
    """The district that retrieval asks for: unknown below a confidence of 0.7."""
    return F.when(confidence >= 0.7, district).otherwise("unknown")


def analysed_district(district: Column, method: Column, confidence: Column, guessed: tuple[str, ...] = GUESSED) -> Column:
    """The district that the analysis is told: a guess below a confidence of 0.7 is kept from it."""
    return F.when(method.isin(*guessed) & (confidence < 0.7), "unknown").otherwise(district)


def status(confidence: Column, citations: Column, missing: Column, district: Column) -> Column:
    """needs_clarification with missing details, else low_confidence below 0.6, without citations or without a district, else success."""
    return F.when(missing > 0, "needs_clarification").when((confidence < 0.6) | (citations == 0) | (district == "unknown"), "low_confidence").otherwise("success")


def capped(confidence: Column, index_ready: Column) -> Column:
    """0.1 to 0.55 while the index isn't ready."""
    return F.when(index_ready, confidence).otherwise(F.greatest(F.lit(0.1), F.least(confidence, F.lit(0.55))))


def parse_payload(content: Column, warning: str = "The use is not listed; only the jurisdiction may classify it.") -> Column:
    """An analysis from a model's JSON: decision, summary, lists of permits, questions and warnings. A use flagged as unlisted can't be decided:
    the decision becomes unknown, with a warning. Null where the text isn't such an object."""
    p = F.from_json(content, "decision string, summary string, required_permits array<string>, follow_up_questions array<string>, warnings array<string>, unlisted_use_determination boolean")
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    off = F.coalesce(p["unlisted_use_determination"], F.lit(False)) & (p["decision"] != "unknown")
    return F.when(p["decision"].isNotNull() & p["summary"].isNotNull(), F.struct(
        F.when(off, "unknown").otherwise(p["decision"]).alias("decision"), p["summary"].alias("summary"), listed(p["required_permits"]).alias("required_permits"), listed(p["follow_up_questions"]).alias("follow_up_questions"),
        F.when(off, F.concat(listed(p["warnings"]), F.array(F.lit(warning)))).otherwise(listed(p["warnings"])).alias("warnings"),
    ))


def comply(cases: DataFrame) -> DataFrame:
    """cases (description, district, citations array<struct<chunk_id>>, payload: a model's JSON, null if the call failed) with decision,
    feasibility, source, warnings and citation_chunk_ids: without citations nothing is decided; without a readable payload the plain rules decide."""
    from quarry.functions import numbers as N

    p, some = parse_payload(F.col("payload")), F.size("citations") > 0
    out = cases.withColumn("__p", p).withColumn("decision", F.when(~some, "unknown").otherwise(F.coalesce("__p.decision", N.verdict(F.col("description"), F.col("district")))))
    source = F.when(~some, "none").when(F.col("__p").isNull(), "deterministic").otherwise("model")
    warnings = F.when(~some, F.array(F.lit("No citation-backed evidence was available."))).when(F.col("__p").isNull(), F.array(F.lit("analysis fallback engaged"))).otherwise(F.col("__p.warnings"))
    ids = F.when(some, F.transform("citations", lambda c: c["chunk_id"])).otherwise(F.array().cast("array<string>"))
    return out.select(*cases.columns, "decision", N.feasibility(F.col("decision")).alias("feasibility"), source.alias("source"), warnings.alias("warnings"), ids.alias("citation_chunk_ids"))


def latest_update(audit: DataFrame, kinds: tuple[str, ...] = ("source.reindex.completed", "source.index.auto_reindex.completed", "source.import.completed", "source.seed.completed")) -> DataFrame:
    """One row, updated: the latest time of the first of the kinds that the audit (kind, at) holds at all."""
    times = audit.where(F.col("kind").isin(*kinds)).groupBy("kind").agg(F.max("at").alias("at"))
    return times.agg(F.min_by("at", F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))).alias("updated"))


def usage_since(usage: DataFrame, since: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of usage (kind, at, ...) since a time, counted by kind and keys."""
    return usage.where(F.col("at") >= since).groupBy("kind", *keys).agg(F.count(F.lit(1)).alias("n"))


def within_limits(usage: DataFrame, limits: dict[str, int], day: Column) -> DataFrame:
    """(user, kind, used, left) of a day: how much of each kind's limit a user has used."""
    rows = usage.where((F.to_date("at") == day) & F.col("kind").isin(*limits)).groupBy("user", "kind").agg(F.count(F.lit(1)).alias("used"))
    most = X.ladder(*[(F.col("kind") == k, str(v)) for k, v in limits.items()]).cast("long")
    return rows.withColumn("left", F.greatest(F.lit(0), most - F.col("used")))


def first_and_last(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """(key, first, last): of the rows of a key, the value met first and the one met last."""
    return rows.groupBy(key).agg(F.min_by(value, position).alias("first"), F.max_by(value, position).alias("last"))


def append_new(held: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """held, and the rows of page whose key isn't there yet, each key once."""
    return held.unionByName(page.dropDuplicates([key]).join(held.select(key), key, "left_anti"))


def eligible(jurisdictions: DataFrame, sources: DataFrame, chunks: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(jurisdiction_id, eligible, errors, warnings): whether each jurisdiction may be public, and what stands against it.

    jurisdictions: jurisdiction_id, coverage_status, contacts array<string>, urls array<string>. sources: source_id, jurisdiction_id, url,
    effective_date. chunks: source_id. scenarios: jurisdiction_id, supported boolean, min_citations.
    """
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("url", "effective_date")]))
    own = sources.join(chunks.select("source_id").distinct().withColumn("held", F.lit(1)), "source_id", "left").withColumn("gaps", gaps)
    told = F.when(F.size("gaps") > 0, F.concat(F.lit("source "), "source_id", F.lit(" lacks "), F.array_join("gaps", ", ")))
    s = own.groupBy("jurisdiction_id").agg(F.count(F.lit(1)).alias("sources"), F.count("held").alias("indexed"), F.array_sort(F.collect_list(told)).alias("lacking"))
    good = F.coalesce(F.col("supported") & (F.col("min_citations") >= 1), F.lit(False))
    g = scenarios.groupBy("jurisdiction_id").agg(F.count(F.lit(1)).alias("scenarios"), F.count_if(good).alias("proving"))
    out = jurisdictions.join(s, "jurisdiction_id", "left").join(g, "jurisdiction_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    any_of = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "")
    before = X.labels((~any_of("contacts"), "no planning contact"), (~any_of("urls"), "no official source"), (~F.coalesce(F.col("coverage_status").isin("qa_ready", "public_supported"), F.lit(False)), "coverage not ready"), (zero("sources") == 0, "no local source"))
    after = X.labels((zero("indexed") == 0, "no indexed chunks"), (zero("scenarios") == 0, "no golden scenario"), ((zero("scenarios") > 0) & (zero("proving") == 0), "no scenario expects support"))
    errors = F.concat(before, F.coalesce("lacking", F.array().cast("array<string>")), after)
    return out.select("jurisdiction_id", errors.alias("errors"), X.labels(((zero("scenarios") == 1) & (zero("proving") == 1), "one golden scenario")).alias("warnings")).withColumn("eligible", F.size("errors") == 0)


def in_order(rows: DataFrame, per: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group by order (suggestions, lists of a page)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(per).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def checklist(results: DataFrame) -> DataFrame:
    """(id, steps, permits, departments, warnings) of analyses: id, decision, permits array<string>, triggers array<string>, warnings.

    Stated permits stand; without any, those that the triggers ask for. A conditional or restricted decision begins with a meeting, an
    unknown one with the office; departments follow from the triggers, planning first.
    """
    by_trigger = F.create_map(*[F.lit(x) for x in ("health_department", "Health permit", "building_permit", "Building permit", "signage", "Sign permit", "change_of_use", "Zoning permit")])
    offices = F.create_map(*[F.lit(x) for x in ("health_department", "Health", "building_permit", "Building", "parking", "Transportation")])
    named = lambda m: F.array_compact(F.transform(F.coalesce("triggers", F.array().cast("array<string>")), lambda t: F.try_element_at(m, t)))
    permits = F.when(F.coalesce(F.size("permits"), F.lit(0)) > 0, F.col("permits")).otherwise(named(by_trigger))
    first = F.when(F.col("decision") == "unknown", "Confirm the district with the planning office").when(F.col("decision").isin("conditional", "restricted"), "Ask for a meeting with the planning office")
    steps = F.array_compact(F.concat(F.array(first), F.transform(permits, lambda p: F.concat(F.lit("Apply: "), p))))
    return results.select("id", steps.alias("steps"), permits.alias("permits"), F.array_distinct(F.concat(F.array(F.lit("Planning")), named(offices))).alias("departments"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def trust(contexts: DataFrame, sources: DataFrame, index: DataFrame, audit: DataFrame) -> DataFrame:
    """contexts (qid, jurisdiction_id, supported, district, method, confidence, citations) with what an answer rests on: whether a jurisdiction was
    analysed, how many sources there are, whether the index is ready, when it was last updated. index: source_id, ready."""
    counts = sources.agg(F.count(F.lit(1)).alias("source_count")).join(index.agg(F.coalesce(F.bool_and("ready"), F.lit(False)).alias("vector_readiness"))).join(latest_update(audit))  # one row
    analysed = F.col("jurisdiction_id").isNotNull() & (F.col("jurisdiction_id") != "") & F.coalesce(F.col("supported"), F.lit(True))
    return contexts.join(F.broadcast(counts)).withColumn("jurisdiction_analyzed", F.coalesce(analysed, F.lit(False)))


def index_ready(expected: DataFrame, held: DataFrame) -> DataFrame:
    """One row: sources, indexed, stale, missing, ready. expected: source, hash. held chunks: source, hash. Ready: there are sources, none stale or missing."""
    from .relational import stale

    wrong = stale(expected, held).groupBy().agg(F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "missing").alias("missing"))
    out = expected.agg(F.count(F.lit(1)).alias("sources")).join(wrong)  # one row each
    return out.withColumn("indexed", F.col("sources") - F.col("missing")).withColumn("ready", (F.col("sources") > 0) & (F.col("stale") + F.col("missing") == 0))


def reindexed(expected: DataFrame, held: DataFrame, chunked: DataFrame) -> DataFrame:
    """The index after a run: chunks of sources as they are now in place of stale ones, those of sources that are gone pruned, the others untouched.
    expected: source, hash. held, chunked: source, hash, chunk_id and the same further columns; chunked is needed for changed sources only."""
    from .relational import stale

    changed = stale(expected, held).select("source")
    kept = held.join(expected.select("source"), "source", "left_semi").join(changed, "source", "left_anti")
    return kept.unionByName(chunked.join(changed, "source", "left_semi"))


def classified_groups(groups: DataFrame, replies: DataFrame, districts: tuple[str, ...], least: float = 0.6) -> DataFrame:
    """(group_id, district, confidence): a model's reply (group_id, reply) for each group of sections, out of a closed list; without a reply, with
    another value or a low confidence the group is unknown."""
    from .validation import parse_reply

    # A reply's decision is its district here.
    decision, confidence = parse_reply(F.col("reply"))
    out = groups.join(replies, "group_id", "left").withColumn("__d", decision).withColumn("confidence", confidence)
    return out.select("group_id", F.when(F.col("__d").isin(*districts) & (F.col("confidence") >= least), F.col("__d")).otherwise("unknown").alias("district"), "confidence")


def rules_of(results: DataFrame) -> DataFrame:
    """One row, rules: title conditions of classified groups (position, title, district), those that say nothing (unknown) left out, in order."""
    return results.where("district <> 'unknown'").agg(F.array_sort(F.collect_list(F.struct("position", F.col("title").alias("title_contains"), F.array("district").alias("districts")))).alias("rules"))


def siblings(codes: DataFrame) -> DataFrame:
    """(code, number) for every chapter and the parts it is split in: entries of a code whose number begins with the chapter's and a hyphen.

    codes: code, number. The part before a number's last hyphen names its chapter: an equi-join, for each hyphen of the number.
    """
    parts = F.split("number", "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    split = codes.where(F.contains("number", F.lit("-"))).select("code", "number", F.explode(heads).alias("head"))
    chapters = codes.select("code", F.col("number").alias("head"))
    return chapters.join(split, ["code", "head"]).select("code", F.col("head").alias("chapter"), "number")
