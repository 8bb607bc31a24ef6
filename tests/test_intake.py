"""Cascades on hand-made requests."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import intake as I

PART = "array<struct<types:array<string>,long_name:string,short_name:string>>"


def part(kind, name, short=""):
    return ([kind], name, short)


@pytest.fixture(scope="module")
def places(spark):
    rows = [(0, "b-va", "B, VA", "public_supported", "locality", ["Bern"], ["Mont County"], ["VA", "Virginia"]), (1, "m-va", "M, VA", "source_indexed", "county", ["Bern"], ["Mont County"], ["Virginia"]), (2, "r-va", "R, VA", "unsupported", "locality_and_county", ["Rome"], ["Rome County"], ["Virginia"])]
    return spark.createDataFrame(rows, "position int, jurisdiction_id string, name string, coverage_status string, match_strategy string, localities array<string>, counties array<string>, states array<string>")


def requests(spark, rows):
    return spark.createDataFrame(rows, f"qid long, address string, lat double, lng double, explicit_id string, components {PART}")


def test_resolve(spark, places):
    state = part("administrative_area_level_1", "Virginia", "VA")
    rows = [
        (1, "x", None, None, "m-va", None), (2, "x", None, None, "z", None), (3, "x", None, None, None, [part("locality", "bern"), state]), (4, "x", None, None, None, [part("administrative_area_level_2", "Mont County"), state]), (5, "x", None, None, None, [part("locality", "Rome"), state]),
        (6, "x", None, None, None, [part("locality", "Rome"), part("administrative_area_level_2", "Other County"), state]), (7, "1 Main St, Bern, VA", None, None, None, None), (8, "nowhere", 1.0, 2.0, None, None), (9, "nowhere", None, 2.0, None, None), (10, None, None, None, "", []),
        (11, "x", 1.0, 1.0, None, [part("locality", "Ulm"), part("country", "Germany", "DE"), state]), (12, "Y", None, None, None, [part("administrative_area_level_2", "Kent County"), part("administrative_area_level_1", "Maryland")]),
    ]
    got = {r.qid: (r.jurisdiction_id, r.method, r.jurisdiction_confidence) for r in I.resolve(requests(spark, rows), places).collect()}
    assert got == {
        1: ("m-va", "explicit", 1.0), 2: ("z", "explicit", 0.7), 3: ("b-va", "geocode", 0.95), 4: ("m-va", "geocode", 0.95), 5: ("r-va", "geocode", 0.95), 6: ("us-va-other-rome", "geocode", 0.95), 7: ("b-va", "fixture", 0.85), 8: (None, "geocode", 0.2),
        9: (None, "unknown", 0.0), 10: (None, "unknown", 0.0), 11: (None, "geocode", 0.2), 12: ("us-maryland-kent-unincorporated", "geocode", 0.95),
    }


def test_parcels_and_districts(spark, places):
    square = [(x, y) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]
    notch = [(x, y) for x, y in ((2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (3.0, 0.5), (2.0, 2.0))]
    parcels = spark.createDataFrame([("p1", "b-va", "R-1", square), ("p2", "b-va", "zz", notch), ("p3", "other", "R-1", square)], "parcel_id string, jurisdiction_id string, zoning_code string, ring array<struct<x:double,y:double>>")
    codes = spark.createDataFrame([("b-va", "r1", "residential")], "jurisdiction_id string, code string, district string")
    fixtures = spark.createDataFrame([(1, "b-va", "12 Elm", "f1", "office"), (0, "b-va", "Elm", "f0", "park"), (2, "b-va", "", "f2", "x")], "position int, jurisdiction_id string, address_pattern string, parcel_id string, zoning_district string")
    rows = [(1, "12 elm st", 0.5, 0.5), (2, "9 oak", 0.5, 0.5), (3, "9 oak", 1.0, 2.2), (4, "9 oak", 1.5, 3.0), (5, "9 Main St", None, None), (6, "9 oak", None, None), (7, "", 0.5, 0.5)]
    df = spark.createDataFrame([(i, a, y, x, "b-va" if i != 7 else "none", None, "public_supported" if i != 6 else "qa_ready", 0.3 if i != 5 else 0.3) for i, a, y, x in rows], f"qid long, address string, lat double, lng double, jurisdiction_id string, components {PART}, coverage_status string, address_confidence double")
    found = I.lookup_parcels(df, fixtures, parcels, codes, cell=0.5)
    got = {r.qid: (r.parcel_id, r.zoning_district, r.zoning_code, r.district_method, r.district_confidence) for r in found.collect()}
    assert got == {
        1: ("f0", "park", None, "fixture", 0.9), 2: ("p1", "residential", "R-1", "gis_lookup", 0.9), 3: ("p2", None, "zz", "gis_unmapped_district", 0.0), 4: (None, None, None, "unknown", 0.0), 5: (None, "mixed-use-core", None, "keyword_fallback", 0.3), 6: (None, None, None, "unknown", 0.0), 7: (None, None, None, "unknown", 0.0),
    }
    rules = F.array(F.struct(F.lit("route").alias("type"), F.lit("Elm").alias("name"), F.lit("strip").alias("district")))
    defaults = F.create_map(F.lit("Bern"), F.lit("old-town"))
    ends = {r.qid: (r.support_status, r.district, r.district_method, r.district_confidence) for r in I.normalize(found, rules, defaults).collect()}
    assert ends[1] == ("supported", "park", "fixture", 0.9) and ends[5] == ("supported", "mixed-use-core", "keyword_fallback", 0.3) and ends[6] == ("unsupported", "unknown", "unknown", 0.0) and ends[3] == ("supported", "unknown", "unknown", 0.0)
    by = lambda *xs: spark.createDataFrame([(list(xs),)], f"c {PART}").select(I.component_district(F.col("c"), rules, defaults).alias("d")).first().d
    assert by(part("route", " elm ")) == "strip" and by(part("locality", "Bern")) == "old-town" and by(part("neighborhood", "Old Mill!")) == "district-old-mill" and by() == "unknown"
    assert tuple(spark.range(1).select(*I.clean_address(F.lit(" a  b "))).first()) == ("a b", 0.0)


def test_intake_and_compliance(spark):
    x = spark.range(1).select(I.intake(F.lit("Convert my garage into a bakery")).alias("x")).first().x
    assert (x.inferred_use, x.use_type, x.project_scope, x.construction_scope, x.business_activity, x.confidence) == ("home-based-food-business", "food_service", "change_of_use", "garage_conversion", "bakery", "low")
    assert x.clarification_questions[0] == "Please provide project scope and intended use."
    good = '{"decision": "conditional", "summary": "s", "warnings": ["w"]}'
    off = '{"decision": "likely_allowed", "summary": "s", "unlisted_use_determination": true}'
    rows = [(1, "shop", "r1", [], good), (2, "shop", "r1", ["c1"], good), (3, "shop", "r1", ["c1"], off), (4, "bakery in garage", "r1", ["c1"], "no json"), (5, "shop", "unknown", ["c1"], None)]
    df = spark.createDataFrame([(i, a, b, [(c,) for c in cs], p) for i, a, b, cs, p in rows], "id long, description string, district string, citations array<struct<chunk_id:string>>, payload string")
    got = {r.id: (r.decision, r.source, len(r.warnings), r.citation_chunk_ids) for r in I.comply(df).collect()}
    assert got == {1: ("unknown", "none", 1, []), 2: ("conditional", "model", 1, ["c1"]), 3: ("unknown", "model", 1, ["c1"]), 4: ("conditional", "deterministic", 1, ["c1"]), 5: ("unknown", "deterministic", 1, ["c1"])}
    told = spark.createDataFrame([("source.import.completed", 5), ("source.seed.completed", 9), ("source.import.completed", 7)], "kind string, at long")
    assert I.latest_update(told).first().updated == 7 and I.latest_update(told.limit(0)).first().updated is None
