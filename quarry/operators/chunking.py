"""Chunks of a corpus: line-aware packing with repeated table headers, named by content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X

MOST, LEAST = 900, 50


def wrap(line: str, most: int) -> Iterator[str]:
    """Words of a line, as many as fit; a longer word stands alone, whole."""
    held: list[str] = []
    size = -1
    for word in line.split():
        if held and size + 1 + len(word) > most:
            yield " ".join(held)
            held, size = [], -1
        held.append(word)
        size += 1 + len(word)
    if held:
        yield " ".join(held)


def pack(text: str | None, most: int = MOST) -> list[str]:
    """Lines packed into chunks of at most `most` characters; a chunk that continues a run of table lines begins with its header, if both fit."""
    out: list[str] = []
    now, header = "", None
    for raw in (text or "").split("\n"):
        line = " ".join(raw.split())
        if not line:
            continue
        is_row = line.count("|") >= 2
        above = header if is_row else None
        header = (header or line) if is_row else None
        for piece in wrap(line, most):
            if now and len(now) + 1 + len(piece) > most:
                out.append(now)
                now = f"{above}\n{piece}" if above and len(above) + 1 + len(piece) <= most else piece
            else:
                now = f"{now}\n{piece}" if now else piece
    return [*out, now] if now else out


def unrepeated(text: str | None, chunks: list[str]) -> str:
    """The words of pack()'s chunks in order, without the headers it repeated."""
    own, above, header = [], [], None  # the words of text; for each, the header above its line
    for raw in (text or "").split("\n"):
        words = raw.split()
        if not words:
            continue
        line = " ".join(words)
        is_row = line.count("|") >= 2
        above += [header if is_row else None] * len(words)
        header = (header or line) if is_row else None
        own += words
    out: list[str] = []
    for chunk in chunks:
        first, _, rest = chunk.partition("\n")
        at, more = len(out), rest.split()
        again = out and more and at < len(own) and above[at] == first and own[at : at + len(more)] == more
        out += more if again else chunk.split()
    return " ".join(out)


def build_chunks(sources: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """chunk_id, source_id, chunk_index, section_ref, jurisdiction_id, districts, uses, source_text_hash, token_count, chunk_text.

    Chunks below `least` characters are dropped, unless a source has just one. Markdown sources (is_markdown, if the column is there)
    are first split at their ## and ### headings, which become the section_ref. Each chunk is stamped with its source's title.
    """
    text = F.col("full_text")
    whole = F.array(F.struct(F.col("section_ref").alias("section"), text.alias("body")))
    if "is_markdown" in sources.columns:
        whole = F.when(F.col("is_markdown"), markdown_sections(text, F.col("section_ref"))).otherwise(whole)
    rows = sources.select("source_id", "title", "jurisdiction_id", "districts", "uses", X.line_hash(text).alias("hash"), whole.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                some = batch.slice(at, 1000)
                made = [[{"section_ref": s["section"], "text": c} for s in parts or () for c in pack(s["body"], most)] for parts in some.column(6).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(made, kind)], [*some.schema.names[:-1], "all"])

    # A source's sections stay in its row and are numbered there: nothing moves.
    kind = pa.list_(pa.struct([("section_ref", pa.string()), ("text", pa.string())]))
    listed = rows.mapInArrow(run, "source_id string, title string, jurisdiction_id string, districts array<string>, uses array<string>, hash string, all array<struct<section_ref:string,text:string>>")
    long = F.filter("all", lambda x: F.length(F.trim(x["text"])) >= least)
    kept = F.when((F.size("long") == 0) & (F.size("all") == 1), F.col("all")).otherwise(F.col("long"))
    out = listed.withColumn("long", long).withColumn("kept", kept).select("*", F.posexplode("kept").alias("chunk_index", "c"))
    out = out.withColumn("section_ref", F.col("c.section_ref")).withColumn("chunk_text", X.header_stamp(F.col("title"), F.col("c.text")))
    return out.select(
        X.chunk_id(F.col("source_id"), F.col("section_ref"), F.col("chunk_index"), F.col("hash")).alias("chunk_id"), "source_id", "chunk_index", "section_ref", "jurisdiction_id", "districts", "uses",
        F.col("hash").alias("source_text_hash"), F.size(X.words(F.col("chunk_text"))).alias("token_count"), "chunk_text",
    )


def markdown_sections(text, default):
    """array<struct<section, body>>: a text split at its ## and ### headings (not # or ####); what stands before the first keeps the default."""
    pieces = F.split(text, r"(?m)^(?=#{2,3}\s)")
    heading = lambda p: F.regexp_extract(p, r"^#{2,3}\s+([^\n]+)", 1)
    body = lambda p: F.trim(F.regexp_replace(p, r"^#{2,3}\s[^\n]*", ""))
    made = F.transform(pieces, lambda p: F.struct(F.when(heading(p) != "", F.trim(heading(p))).otherwise(default).alias("section"), body(p).alias("body")))
    return F.filter(made, lambda s: s["body"] != "")
