"""The analysis of cases from citations to reports."""

import json

import pytest

from quarry.operators import analysis as A
from quarry.operators.validation import asked_once

CASE = "id string, description string, category string, intent string, use string, missing array<string>, questions array<string>, triggers array<string>, notes array<string>, district string, district_method string, district_confidence double, jurisdiction_id string, jurisdiction_name string, parent_id string, state string, supported boolean, index_ready boolean, index_warnings array<string>, reply string, reply_error string"
CITED = "id string, place int, chunk_id string, source_id string, title string, section_ref string, jurisdiction_id string, effective_date string"


def case(id, **more):
    row = dict(id=id, description="A bakery", category="bakery", intent="open", use="food", missing=[], questions=["Please provide operating hours"], triggers=["parking"], notes=None, district="R-1", district_method="parcel", district_confidence=0.9, jurisdiction_id="j", jurisdiction_name="Town", parent_id="p", state="VA", supported=True, index_ready=True, index_warnings=None, reply=None, reply_error=None)
    return tuple((row | more).values())


def cite(id, place, chunk="c1", source="s1", date="2024-01-01"):
    return (id, place, chunk, source, f"T{place}", f"§{place}", "j", date)


@pytest.fixture(scope="module")
def results(spark):
    reply = json.dumps({"decision": "conditional", "summary": "Fine.", "confidence": 0.9, "citation_chunk_ids": ["zzz"], "required_permits": ["Use permit"], "follow_up_questions": ["What are the hours?"], "findings": [{"status": "compliant", "citation_ids": ["c1", "zzz"]}]})
    cases = [
        case("model", reply=reply, missing=["operating hours"]), case("good", reply=reply.replace('"citation_chunk_ids": ["zzz"]', '"citation_chunk_ids": ["c2"]')), case("failed", reply_error="timeout"), case("guessed", district_method="keyword_fallback", district_confidence=0.5),
        case("nothing", reply=reply), case("off", supported=False, reply=reply), case("foreign"), case("stale", index_ready=False, index_warnings=["2 sources stale"], reply=reply),
        case("nulls", description=None, category=None, intent=None, use=None, missing=None, questions=None, triggers=None, district=None, district_method=None, district_confidence=None, jurisdiction_id=None, jurisdiction_name=None, supported=None, index_ready=None, reply="{"),
        case("chunkless", reply=reply),
    ]
    cited = [cite(c, p, f"c{p}", f"s{p}") for c in ("model", "good", "failed", "guessed", "off", "stale", "nulls") for p in (2, 1)]
    cited += [cite("foreign", 1, source="s9"), cite("foreign", 2, source="s3", date=None), cite("foreign", 3, source=None), cite("foreign", 4, source="s4"), cite("foreign", 5, source="s3", date=""), cite("chunkless", 1, chunk=None), cite("gone", 1)]
    sources = [("s1", "j", []), ("s2", "p", None), ("s3", "elsewhere", []), ("s4", "*", [" va"])]
    df = A.analyse(spark.createDataFrame(cases, CASE).repartition(3), spark.createDataFrame(cited, CITED), spark.createDataFrame(sources, "source_id string, jurisdiction_id string, states array<string>"))
    return {r.id: r for r in df.collect()}


def test_every_case_has_one_result(results):
    assert sorted(results) == ["chunkless", "failed", "foreign", "good", "guessed", "model", "nothing", "nulls", "off", "stale"]


def test_ids_that_a_reply_makes_up_are_removed(results):
    r = results["model"]
    assert r.compliance.citation_chunk_ids == [] and r.compliance.confidence == 0.3 and r.compliance.findings[0].citation_ids == ["c1"]
    assert r.warnings[:2] == ["Invalid citation IDs were removed: zzz", "Confidence capped because no valid citation IDs were supplied."]
    assert (r.status, r.decision, r.valid, r.coverage) == ("needs_clarification", "conditional", True, 1.0)
    assert r.follow_up_questions == ["What are the hours?"] and r.checklist.permits == ["Use permit"]
    assert r.stages[0].status == "needs_clarification" and r.stages[0].details[-1] == "Missing: operating hours"
    # No chunk id at all: nothing may be cited.
    assert results["chunkless"].compliance.citation_chunk_ids == [] and results["chunkless"].compliance.confidence == 0.3


def test_a_good_reply_is_a_success(results):
    r = results["good"]
    assert (r.status, r.compliance.confidence, r.compliance.citation_chunk_ids) == ("success", 0.9, ["c2"])
    assert round(r.confidence, 6) == 0.92 and r.follow_up_questions == ["What are the hours?"]
    assert [c.chunk_id for c in r.cited] == ["c1", "c2"] and r.stages[2].details[2:] == ["T1 (§1)", "T2 (§2)"]
    assert r.stages[3].details == ["Decision: conditional", "Confidence: 0.92", "Citation coverage: 1.00"]


def test_failed_calls_and_guessed_districts(results):
    r = results["failed"]
    assert (r.decision, r.compliance.confidence, r.compliance.permit_path, r.compliance.citation_chunk_ids) == ("likely_allowed", 0.5, "by-right", ["c1", "c2"])
    assert r.warnings == ["model analysis fallback engaged: timeout"] and r.checklist.permits == list(A.WITH[1])
    assert results["guessed"].decision == "unknown" and results["guessed"].compliance.unresolved_questions == [A.INSUFFICIENT]


def test_no_evidence_and_no_support(results):
    r = results["nothing"]
    assert (r.status, r.decision, r.compliance.confidence, r.claims, r.coverage) == ("low_confidence", "unknown", 0.3, [A.NO_CHUNKS], 0.0)
    assert r.warnings == [A.NO_CITATIONS, A.NO_ORDINANCES, *A.LOW] and r.compliance.findings == [] and r.checklist.departments == ["Planning", "Permitting"]
    r = results["off"]
    assert (r.status, r.decision, r.confidence, r.cited, r.valid) == ("low_confidence", "unknown", 0.3, [], False)
    assert [s.status for s in r.stages] == ["completed", "completed", "skipped", "skipped", "completed"] and r.warnings == ["Town is not currently supported.", A.CONTACT, A.NO_CITATIONS]
    assert r.follow_up_questions == [A.CONTACT_FOR] and r.stages[3].details == ["Decision: unknown", "Confidence: 0.30"]


def test_citations_that_do_not_hold(results):
    r = results["foreign"]
    assert r.invalid_ids == ["s9", "s3", "<missing>"] and not r.valid
    assert r.claims == ["s9 was not found in the local source registry.", "s3 belongs to elsewhere, not j."]
    assert [w for w in r.warnings if "effective" in w] == ["s3 is missing an effective date."] * 2


def test_index_not_ready_and_nulls(results):
    assert results["stale"].confidence == 0.55 and results["stale"].status == "low_confidence"
    assert ["2 sources stale", A.NOT_READY] == [w for w in results["stale"].warnings if w in ("2 sources stale", A.NOT_READY)]
    r = results["nulls"]
    assert (r.status, r.decision, r.confidence) == ("low_confidence", "unknown", 0.55) and r.stages[1].details == ["Jurisdiction: Not recorded", "District context: unknown"]


def test_empty_tables(spark):
    c, s = spark.createDataFrame([], CASE), spark.createDataFrame([], CITED)
    assert A.analyse(c, s).count() == 0
    assert A.analyse(spark.createDataFrame([case("a")], CASE), s).first().status == "low_confidence"


def test_follow_ups(spark):
    asked = [" Please  provide parking", "How much parking?", "Is there more parking?", "", "Please provide hours", "Lot size?", "What is the lot size"]
    assert spark.createDataFrame([(asked,)], "q array<string>").select(A.follow_ups(A.F.col("q"))).first()[0] == ["How much parking?", "Please provide hours", "Lot size?"]


def test_asked_once(spark):
    rows = [("a", 1, "Please provide parking"), ("a", 2, "How much  parking?"), ("a", 3, "More parking?"), ("a", 4, " "), ("a", 5, None), ("a", 6, "Lot size?"), ("a", 7, "lot-size"), ("b", 1, "Please provide parking"), ("b", 1, "Please provide parking")]
    got = asked_once(spark.createDataFrame(rows, "g string, at int, q string"), "g", "at", "q")
    assert sorted(map(tuple, got.collect())) == [("a", 1, "How much parking?"), ("a", 6, "Lot size?"), ("b", 1, "Please provide parking")]
    assert asked_once(spark.createDataFrame([], "g string, at int, q string"), "g", "at", "q").count() == 0
