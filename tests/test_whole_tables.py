"""Queries take every row of their tables, and texts whole."""

import os

from quarry.operators import chunking
from quarry.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_all_replies(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert registry.queries()["x56_all_replies"](spark, SF).select("event_id").distinct().count() == events.select("event_id").distinct().count()


def test_all_coverage(spark):
    tables = spark.read.parquet(f"{SF}/documents.parquet").where("contains(text, '|')")
    got = registry.queries()["c01_all_coverage"](spark, SF)
    assert tables.count() > 0 and tables.join(got, "doc_id", "left_anti").count() == 0


def test_repeated_headers():
    """Tables over several chunks, also with rows like their header, with texts between and rows too long for a header."""
    table = lambda n, row: "\n".join(["| a | b |", *(row.format(i) for i in range(n))])
    for text in (table(200, "| {} | x y |"), table(200, "| a | b |"), "\n\n".join([table(60, "| {} | x |"), "words " * 300, table(90, "| c | d |\n| {} | z |")]), table(9, "| {} | " + "long " * 190 + "|")):
        chunks = chunking.pack(text)
        assert len(chunks) > 1 and chunking.unrepeated(text, chunks) == " ".join(text.split())
        assert chunking.unrepeated(text, chunks[:1] + chunks[2:]) != " ".join(text.split())
    assert chunking.pack(table(200, "| {} | x y |"))[1].startswith("| a | b |")


def test_whole_context(spark, tmp_path):
    """Turns that differ behind their 40th character make contexts that differ; space around turns doesn't."""
    rows = [(1, 0, "user", "x" * 60 + "a"), (2, 0, "user", "x" * 60 + "b"), (3, 0, "user", "\n" + "x" * 60 + "a \t"), (3, 1, "user", " \n"), (4, 0, "user", "  ")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.context_md5 for r in registry.queries()["x29_whole_context"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[1] != got[2] and got[1] == got[3]


def test_row_fingerprint(spark, tmp_path):
    """The same for rows in another order and other partitions, another with a row more."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.repartition(7, "quality").write.parquet(f"{tmp_path}/a/labels.parquet")
    labels.unionAll(labels.limit(1)).write.parquet(f"{tmp_path}/b/labels.parquet")
    first, again, more = (registry.queries()["a07_row_fingerprint"](spark, p).first().fingerprint for p in (SF, f"{tmp_path}/a", f"{tmp_path}/b"))
    assert first == again != more
