"""One run from cases to reports: citation checks, a model's reply or the plain rules, status, stage reports, checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import replies
from quarry.functions import text as X

from .intake import analysed_district, capped, status
from .relational import applies

# What reports say.
NO_EVIDENCE = "We could not find enough source material for this district and project type to make a reliable zoning call."
NO_CITATIONS = "No citation-backed evidence was available."
NO_CHUNKS = "No retrieved source chunks are available for this analysis."
NO_ORDINANCES = "No relevant ordinances were found in the current zoning source registry. Please contact the planning office."
NOT_READY = "Source index readiness is incomplete; verify this result with the planning office."
ASK_OFFICE = "Confirm the applicable zoning district and use standards with the planning office."
INSUFFICIENT = "Evidence is insufficient for a reliable zoning decision."
LOW = ("Confidence is low due to incomplete evidence or conflicting context.", "Human-in-the-loop fallback: verify the parcel directly with the zoning or planning office.")
NOT_SUPPORTED = "The requested jurisdiction is not currently supported."
CONTACT = "Human-in-the-loop fallback: contact the local planning office before acting."
CONTACT_FOR = "Contact the local planning office for zoning district and permit path confirmation."
SUMMARIES = {
    "unknown": "District could not be confidently mapped. Additional parcel verification is required.",
    "conditional": "Garage-to-bakery conversion appears conditionally feasible with fire, health, and parking approvals.",
    "likely_allowed": "Proposed use appears likely allowed, subject to standard permit review.",
}
# Checklists without and with evidence, each (steps of action, documents, department; permits; documents; departments).
WITHOUT = (
    (
        ("Contact the planning department for parcel-level zoning verification", ("property address", "parcel number if available", "project description"), "Planning Department"),
        ("Request the current zoning district, permitted use table, and recent amendments", ("written zoning inquiry", "site sketch if available"), "Planning Department"),
        ("Confirm permit sequencing before spending on design or construction", ("draft floor plan", "business operations summary"), "Permit Office"),
    ),
    ("Zoning Verification Request", "Planning Counter Review"), ("Property Address", "Project Narrative", "Parcel Number", "Site Sketch"), ("Planning", "Permitting"),
)
WITH = (
    (
        ("Request zoning verification letter for the parcel", ("site plan", "property ownership proof"), "Planning Department"),
        ("Submit change-of-use permit application", ("business description", "floor plan", "parking plan"), "Permit Office"),
        ("Complete fire and health compliance inspections", ("equipment specification", "ventilation design"), "Fire Marshal and Health Department"),
    ),
    ("Change-of-Use Permit", "Business License", "Health Permit"), ("Site Plan", "Floor Plan", "Parking Plan", "Fire Safety Plan"), ("Planning", "Permitting", "Fire", "Health"),
)


def _none() -> Column:
    return F.array().cast("array<string>")


def _listed(*texts: str | Column) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])


def _when(condition: Column, *texts: str | Column) -> Column:
    """The texts if the condition holds, else none."""
    return F.when(condition, _listed(*texts)).otherwise(_none())


def _given(c: str) -> Column:
    return F.coalesce(F.col(c), _none())


def checked(cases: DataFrame, citations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """cases with cited, claims, invalid_ids, undated, valid and coverage: what each case cites, and what stands against it.

    cases: id, jurisdiction_id, parent_id, state and more. citations: id, place, chunk_id, source_id, title, section_ref, jurisdiction_id,
    effective_date. sources, one row each: source_id, jurisdiction_id, states array<string>; without them (None) sources aren't looked up. A
    source's jurisdiction stands before the citation's own. A case's citations, a dozen, come together in its row in order of place; ties by
    chunk_id. Repeated citations stay, what is said of them is said once. A case without citations is not valid.
    """
    known = sources.select(F.col("source_id").alias("__s"), F.col("jurisdiction_id").alias("__j"), F.col("states").alias("__states")) if sources is not None else None
    met = citations.select("id", "place", "chunk_id", "source_id", "title", "section_ref", F.col("jurisdiction_id").alias("__own"), "effective_date")
    met = met.join(cases.select("id", F.col("jurisdiction_id").alias("__target"), F.col("parent_id").alias("__parent"), F.col("state").alias("__state")), "id")
    met = met.join(known, F.col("source_id") == F.col("__s"), "left") if known is not None else met.withColumns({"__s": F.col("source_id"), "__j": F.col("__own"), "__states": _none()})
    named = F.coalesce(F.col("source_id") != "", F.lit(False))
    origin = F.when(F.col("__s").isNull(), F.col("__own")).otherwise(F.col("__j"))
    unknown = named & F.col("__s").isNull()
    target = F.coalesce(F.col("__target") != "", F.lit(False))
    foreign = named & target & ~F.coalesce(applies(origin, F.col("__target"), F.col("__parent"), F.col("__state"), F.col("__states")), F.lit(False))
    where = F.coalesce(F.nullif(origin, F.lit("")), F.lit("an unknown jurisdiction"))
    claims = F.array_compact(F.array(F.when(unknown, F.concat("source_id", F.lit(" was not found in the local source registry."))), F.when(foreign, F.concat("source_id", F.lit(" belongs to "), where, F.lit(", not "), "__target", F.lit(".")))))
    wrong = F.when(~named, "<missing>").when(unknown | foreign, F.col("source_id"))
    undated = F.when(named & (F.coalesce(F.col("effective_date").cast("string"), F.lit("")) == ""), F.concat("source_id", F.lit(" is missing an effective date.")))
    one = F.struct("place", "chunk_id", "title", "section_ref", claims.alias("claims"), wrong.alias("wrong"), undated.alias("undated"))
    told = met.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("__cited"))
    out = cases.join(told, "id", "left")
    out = out.withColumn("__cited", F.coalesce("__cited", F.array().cast(told.schema["__cited"].dataType)))
    of = lambda f: F.array_compact(F.transform("__cited", lambda x: x[f]))
    out = out.withColumns({
        "cited": F.transform("__cited", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["title"].alias("title"), x["section_ref"].alias("section_ref"))),
        "claims": F.when(F.size("__cited") == 0, _listed(NO_CHUNKS)).otherwise(F.array_distinct(F.flatten(F.transform("__cited", lambda x: x["claims"])))),
        "invalid_ids": F.array_distinct(of("wrong")), "undated": of("undated"),
    }).drop("__cited")
    valid = (F.size("claims") == 0) & (F.size("invalid_ids") == 0)
    return out.withColumn("valid", valid).withColumn("coverage", F.when(valid & (F.size("cited") > 0), 1.0).otherwise(0.0))


def follow_ups(questions: Column) -> Column:
    """Questions, each kind once, in order: of those that ask the same the first that is more than 'please provide ...' stands. Blank ones go."""
    clean = F.filter(F.transform(questions, X.collapse), lambda q: q != "")
    pairs = F.transform(clean, lambda q: F.struct(X.question_key(q).alias("key"), q.alias("q"), F.startswith(F.lower(q), F.lit("please provide ")).alias("generic")))

    def chosen(p: Column) -> Column:
        first = lambda k, more: F.get(F.filter(p, lambda x: (x["key"] == k) & (~x["generic"] | F.lit(not more))), F.lit(0))["q"]
        return F.array_distinct(F.transform(F.array_distinct(F.transform(p, lambda x: x["key"])), lambda k: F.coalesce(first(k, True), first(k, False))))

    return F.get(F.transform(F.array(pairs), chosen), F.lit(0))


def decided(cases: DataFrame) -> DataFrame:
    """checked cases with way, decision and compliance. Further columns: description, district, district_method, district_confidence, supported,
    reply, reply_error.

    way: none without citations or in a jurisdiction that is not supported (nothing is decided), rules where the call failed (reply is null),
    else model. Ids that the reply cites and the case doesn't are removed with a warning; without a valid one its confidence is 0.3 at most.
    """
    ids = F.filter(F.transform("cited", lambda c: c["chunk_id"]), lambda x: F.coalesce(x != "", F.lit(False)))
    rows = cases.withColumns({"__ids": ids, "__unsupported": F.coalesce((F.col("jurisdiction_id") != "") & ~F.col("supported"), F.lit(False))})
    rows = rows.withColumn("way", F.when(F.col("__unsupported") | (F.size("cited") == 0), "none").when(F.col("reply").isNull(), "rules").otherwise("model"))
    told = analysed_district(F.col("district"), F.col("district_method"), F.col("district_confidence"))
    kept = [c for c in rows.columns if c != "__allowed"]
    # An empty list of allowed ids would allow any: an id that no citation has stands in it.
    m = replies.normalised(rows.withColumn("__allowed", F.when(F.size("__ids") > 0, F.col("__ids")).otherwise(_listed("\u0000"))), "reply", "__allowed")
    fields = ("decision", "feasibility", "confidence", "summary", "findings", "required_permits", "permit_path", "warnings", "unresolved_questions", "follow_up_questions", "citation_ids")
    m = m.select(*kept, F.struct(*fields).alias("__m")).withColumn("__rule", N.verdict(F.coalesce("description", F.lit("")), F.coalesce(told, F.lit("unknown"))))
    rule = F.col("__rule")
    by = lambda none, rules, f: F.when(F.col("way") == "none", none).when(F.col("way") == "rules", rules).otherwise(F.col(f"__m.{f}"))
    share = F.when(F.size("__ids") > 0, 0.5).otherwise(0.3)
    told_summary = X.ladder(*[(rule == k, v) for k, v in SUMMARIES.items()])
    finding = F.struct(F.lit("general").alias("category"), N.finding_status(rule).alias("status"), told_summary.alias("summary"), F.slice("__ids", 1, 3).alias("citation_ids"), share.alias("confidence"))
    failed = F.concat(F.lit("model analysis fallback engaged: "), F.coalesce("reply_error", F.lit("no reply")))
    compliance = F.struct(
        by(F.lit("unknown"), N.feasibility(rule), "feasibility").alias("feasibility"), by(F.lit(0.3), share, "confidence").alias("confidence"), by(F.lit(NO_EVIDENCE), told_summary, "summary").alias("summary"),
        F.when(F.col("way") == "none", F.filter("__m.findings", lambda f: F.lit(False))).when(F.col("way") == "rules", F.array(finding)).otherwise(F.col("__m.findings")).alias("findings"),
        by(_none(), _none(), "required_permits").alias("required_permits"), by(F.lit("unknown"), N.permit_path(rule), "permit_path").alias("permit_path"), by(_listed(NO_CITATIONS), _listed(failed), "warnings").alias("warnings"),
        by(_listed(ASK_OFFICE), _when(rule == "unknown", INSUFFICIENT), "unresolved_questions").alias("unresolved_questions"), by(_none(), F.col("__ids"), "citation_ids").alias("citation_chunk_ids"),
    )
    return m.select(*[c for c in kept if c != "__ids"], by(F.lit("unknown"), rule, "decision").alias("decision"), by(_none(), _none(), "follow_up_questions").alias("__asked"), compliance.alias("compliance"))


def _checklist(some: Column) -> Column:
    """The checklist with or without evidence; permits that the analysis states stand in place of its own."""
    step = lambda i, s: F.struct(F.lit(i).alias("order"), F.lit(s[0]).alias("action"), _listed(*s[1]).alias("required_docs"), F.lit(s[2]).alias("department"))
    steps = [F.array(*[step(i + 1, s) for i, s in enumerate(kind[0])]) for kind in (WITH, WITHOUT)]
    one = lambda i: F.when(some, _listed(*WITH[i])).otherwise(_listed(*WITHOUT[i]))
    own = F.col("compliance.required_permits")
    return F.struct(F.when(some, steps[0]).otherwise(steps[1]).alias("steps"), F.when(F.size(own) > 0, own).otherwise(one(1)).alias("permits"), one(2).alias("documents"), one(3).alias("departments"))


def _stage(key: str, label: str, state: Column, headline: Column, *details: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), state.alias("status"), headline.alias("headline"), F.flatten(F.array(*details)).alias("details"))


def analyse(cases: DataFrame, citations: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The results of all cases in one job: id, status, decision, confidence, summary, compliance, valid, coverage, claims, invalid_ids, cited,
    follow_up_questions, warnings, checklist, stages (key, label, status, headline, details), disclaimers aside.

    cases: id, description, category, intent, use, missing, questions, triggers, notes (arrays of texts, null: none), district, district_method,
    district_confidence, jurisdiction_id, jurisdiction_name, parent_id, state, supported, index_ready, index_warnings, reply, reply_error. See
    checked for citations and sources. A jurisdiction that is not supported ends early: its citations count for nothing. Nulls in texts count
    as unknown, a null index_ready as not ready. Ids are unique; empty tables give an empty result. The one shuffle beyond the joins puts a case's citations together.
    """
    for_all = cases.withColumns({"district": F.coalesce("district", F.lit("unknown")), "district_confidence": F.coalesce("district_confidence", F.lit(0.0)), "index_ready": F.coalesce("index_ready", F.lit(False))})
    r = decided(checked(for_all, citations, sources))
    off, missing = F.col("__unsupported"), F.coalesce(F.size("missing"), F.lit(0))
    missing = F.greatest(F.lit(0), missing)
    r = r.withColumn("cited", F.when(off, F.filter("cited", lambda c: F.lit(False))).otherwise(F.col("cited")))
    some = F.size("cited") > 0
    r = r.withColumns({
        "confidence": F.when(off, 0.3).otherwise(capped(N.confidence(missing, F.size("cited")), F.col("index_ready"))), "valid": F.col("valid") & ~off, "coverage": F.when(off, 0.0).otherwise(F.col("coverage")),
        "claims": F.when(off, _listed(NOT_SUPPORTED)).otherwise(F.col("claims")), "invalid_ids": F.when(off, _none()).otherwise(F.col("invalid_ids")),
    })
    low = (F.col("confidence") < 0.6) | ~some | (F.col("district") == "unknown")
    r = r.withColumn("status", F.when(off, "low_confidence").otherwise(status(F.col("confidence"), F.size("cited"), missing, F.col("district"))))
    asked = F.concat("__asked", F.when(missing > 0, _given("questions")).otherwise(_none()))
    warnings = F.concat(
        _given("notes"), "compliance.warnings", F.when(~F.col("index_ready"), F.concat(_given("index_warnings"), _listed(NOT_READY))).otherwise(_none()),
        _when(~some, NO_ORDINANCES), "undated", _when(low, *LOW),
    )
    place = F.coalesce(F.nullif(F.col("jurisdiction_name"), F.lit("")), F.lit("This jurisdiction"))
    early = F.concat(_listed(F.concat(place, F.lit(" is not currently supported.")), CONTACT), "compliance.warnings")
    r = r.withColumns({"follow_up_questions": F.when(off, _listed(CONTACT_FOR)).otherwise(follow_ups(asked)), "warnings": F.when(off, early).otherwise(warnings), "checklist": _checklist(some)})

    said = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    unclear, without = ~off & (missing > 0), F.col("district") == "unknown"
    intake = _stage(
        "intake", "Understand Project", F.when(unclear, "needs_clarification").otherwise("completed"),
        F.when(unclear, "The project brief needs a few more details before the zoning call is reliable.").otherwise(F.concat(F.lit("Captured a "), said("category"), F.lit(" request to "), said("intent"), F.lit("."))),
        _listed(line("Project category", said("category")), line("Inferred use", said("use")), line("Missing details", missing.cast("string")), line("Triggers", F.coalesce(F.nullif(F.array_join(_given("triggers"), ", "), F.lit("")), F.lit("none detected")))),
        F.when(unclear, F.transform(_given("missing"), lambda m: F.concat(F.lit("Missing: "), m))).otherwise(_none()),
    )
    location = _stage(
        "location", "Resolve Property", F.when(without, "warning").otherwise("completed"),
        F.when(without, "Jurisdiction was resolved, but the zoning district is still unknown.").otherwise("Resolved jurisdiction and district context for retrieval."),
        _listed(line("Jurisdiction", F.coalesce(F.nullif(F.col("jurisdiction_name"), F.lit("")), F.lit("Not recorded"))), line("District context", F.col("district"))),
    )
    first = F.transform(F.slice("cited", 1, 3), lambda c: F.concat(F.coalesce(c["title"], F.lit("")), F.lit(" ("), F.coalesce(c["section_ref"], F.lit("")), F.lit(")")))
    retrieval = _stage(
        "retrieval", "Retrieve Sources", F.when(off, "skipped").when(some, "completed").otherwise("warning"),
        F.when(off, "Skipped source retrieval because this jurisdiction is not currently supported.").when(some, F.concat(F.lit("Retrieved "), F.size("cited").cast("string"), F.lit(" relevant zoning source excerpts for review."))).otherwise("No relevant municipal ordinances were found in the current source registry."),
        F.when(off, _listed("No source coverage is configured for this jurisdiction.")).when(some, F.concat(_listed(line("District searched", F.col("district")), line("Use searched", said("use"))), first)).otherwise(_listed("The system could not retrieve matching zoning text for this district and use.", "A human review with the planning department is recommended before acting.")),
    )
    two = lambda c: F.format_string("%.2f", c)
    compliance = _stage(
        "compliance", "Analyze Compliance", F.when(off, "skipped").when(F.col("status") == "low_confidence", "warning").when(F.col("status") == "needs_clarification", "needs_clarification").otherwise("completed"), F.col("compliance.summary"),
        _listed(line("Decision", F.col("decision")), line("Confidence", two(F.col("confidence")))), F.when(off, _none()).otherwise(_listed(line("Citation coverage", two(F.col("coverage"))))),
    )
    count = lambda c: F.size(c).cast("string")
    checklist = _stage(
        "checklist", "Generate Checklist", F.lit("completed"), F.when(off, "Prepared fallback steps for checking this property with the planning office.").otherwise("Prepared permit steps, required documents, and review departments."),
        _listed(line("Checklist steps", count("checklist.steps"))), F.when(off, _none()).otherwise(_listed(line("Permits", count("checklist.permits")), line("Warnings", count("warnings")))),
    )
    return r.select("id", "status", "decision", "confidence", F.col("compliance.summary").alias("summary"), "compliance", "valid", "coverage", "claims", "invalid_ids", "cited", "follow_up_questions", "warnings", "checklist", F.array(intake, location, retrieval, compliance, checklist).alias("stages"))
