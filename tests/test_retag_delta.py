from quarry.operators import relational as R


def test_retag_delta(spark):
    """A store without a source isn't stale, but the table of sources is; one of several chunk rows is enough; order counts; empty tags aren't in payloads."""
    tags = "id string, districts array<string>, uses array<string>"
    entries = spark.createDataFrame([(k, ["a", "b"], ["u", ""]) for k in ("same", "unstored", "stored", "chunk", "payload", "absent")], tags)
    stored = spark.createDataFrame([(k, ["b", "a"] if k == "stored" else ["a", "b"], ["u", ""]) for k in ("same", "stored", "chunk", "payload", "absent", "foreign")], tags)
    chunks = spark.createDataFrame([("same", ",a,b,", ",u,,"), ("chunk", ",a,b,", ",u,,"), ("chunk", ",a,b,", ",u,"), ("foreign", "", "")], "id string, districts string, uses string")
    payloads = spark.createDataFrame([("same", ["a", "b"], ["u"]), ("payload", ["a", "b"], ["u", ""]), ("foreign", [], [])], tags)
    assert sorted(r.id for r in R.retag_delta(entries, stored, chunks, payloads, "id").collect()) == ["chunk", "payload", "stored", "unstored"]
