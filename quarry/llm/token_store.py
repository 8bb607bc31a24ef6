"""Token-id output: a content-addressed store.

Layout below one folder, all Parquet:

  encoded/    kind=chunk: digest, size, data, wide: each distinct chunk once, in buckets by digest; data is the ids as
              little-endian unsigned 16-bit integers (wide: 32-bit, where an id doesn't fit), compressed with zstd
              kind=document: the documents as they were encoded, from which the recipes are made
  recipes/    part, doc_id, start, n, root, chunks: each document's chunk digests in order, in ascending doc_id order
  manifest/   part, docs, ids, root: the Merkle root of each part's document roots
  layout/     buckets: how many buckets the chunks are in

A rolling hash over the last 32 ids cuts the stream of a document, so equal passages of 32 ids and more cut alike and
their chunks are stored once. digest is blake2b (16 bytes) of the ids as unsigned 32-bit integers; a document's root is
the Merkle root of its chunk digests. Reading back puts every document together from its chunks and checks each chunk
against its digest, each document against its root and length, and every part against the manifest. Chunks meet the
recipes in the buckets they were written in, so only those of documents of several chunks are moved, once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import word_table
from .common import broadcast_if_small, parts_of, settle, shared_dir, table, tidy

_GEAR = np.random.default_rng(17).integers(0, 2**32, 1 << 16, dtype="u4")
_MASK = np.uint32(0x3FF << 21)  # a cut every 1024 ids on average
LEAST, MOST = 256, 4096


def cuts(flat: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For documents flat[ends[i] : ends[i + 1]] the ends of their chunks in flat: where the rolling hash of the last 32 ids has 10 zero
    bits, LEAST to MOST apart. LEAST is above 32, so what stands before a document doesn't count."""
    h = _GEAR[flat & np.uint32(0xFFFF)]
    for step in (1, 2, 4, 8, 16):  # sums of 2, 4, ... 32 shifted values
        h[step:] += h[:-step] << np.uint32(step)
    marks = np.flatnonzero((h & _MASK) == 0) + 1
    at, out = np.searchsorted(marks, ends, side="right"), []
    for i, (begin, end) in enumerate(zip(ends.tolist(), ends.tolist()[1:], strict=False)):
        own, last = [], begin
        for mark in marks[at[i] : at[i + 1]].tolist():
            while mark - last > MOST:
                last += MOST
                own.append(last)
            if mark - last >= LEAST and mark < end:
                own.append(mark)
                last = mark
        while end - last > MOST:
            last += MOST
            own.append(last)
        out.append([*own, end] if end > last else own)
    return out


def digest(data: bytes | np.ndarray) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root over leaves in order; an odd one out is carried up as it is. Of none: the digest of nothing."""
    level = list(leaves)
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


def _packed(ids: np.ndarray, to: zstandard.ZstdCompressor) -> tuple[bytes, bool]:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return to.compress(ids.astype("<u4" if wide else "<u2").tobytes()), wide


def _unpacked(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4" if wide else "<u2").astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, id_col="doc_id", text_col="text", end_id: int = 0, kept_words: int = 400_000, bucket_bytes: int = 64_000_000) -> None:
    """Encode each text, append end_id, and write the store. Null texts count as empty: the end id alone.

    Documents stand in ascending doc_id order, null ids last; rows of one id in the order of their roots. Other columns
    are ignored. An empty table gives an empty store. bucket_bytes: text for each bucket of chunks.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, to = word_table(tokenizer_path, kept_words), zstandard.ZstdCompressor(level=1)
        met: set[bytes] = set()  # chunks that this task has put out already
        row, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in parts_of(batch, batch.column(1), 8_000_000):
                flat, ends = words.encode(texts)
                flat, ends = np.insert(flat, ends[1:], end_id).astype("<u4"), ends + np.arange(len(ends))
                names = ("digest", "kind", "doc_id", "n", "root", "chunks", "size", "data", "wide")
                rows: dict[str, list] = {c: [] for c in names}
                for doc, begin, own in zip(part.column(0).to_pylist(), ends.tolist(), cuts(flat, ends), strict=False):
                    made, last = [], begin
                    for at in own:
                        piece = flat[last:at]
                        d = digest(piece)
                        made.append(d)
                        if d not in met:
                            if len(met) < 500_000:
                                met.add(d)
                            packed, wide = _packed(piece, to)
                            for c, v in zip(names, (d, "chunk", None, None, None, None, at - last, packed, wide), strict=True):
                                rows[c].append(v)
                        last = at
                    row += 1  # a document's key only deals it out evenly
                    for c, v in zip(names, (digest(b"%d/%d" % (task, row)), "document", doc, last - begin, merkle(made), made, None, None, None), strict=True):
                        rows[c].append(v)
                kinds = (pa.binary(), pa.string(), part.schema.field(0).type, pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(names))

    kind = f"digest binary, kind string, doc_id {docs.schema[id_col].dataType.simpleString()}, n long, root binary, chunks array<binary>, size int, data binary, wide boolean"
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = max(1, -(-(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
    # Documents and chunks leave one pass over the texts; equal chunks meet in one bucket.
    again = F.lag("kind").over(Window.partitionBy("digest").orderBy("kind")).isNotNull()
    rows = slim.mapInArrow(tidy(encode), kind).repartition(buckets, "digest").withColumn("again", again).where("kind = 'document' or not again").drop("again")
    rows.write.option("path", f"{folder}/encoded").option("compression", "none").partitionBy("kind").bucketBy(buckets, "digest").saveAsTable(f"token_store_{uuid.uuid4().hex}")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/layout")
    # The order of documents, and where each starts: sums within range partitions, then over the partitions.
    found = spark.read.schema(kind).parquet(f"{folder}/encoded").where("kind = 'document'").select("doc_id", "n", "root", "chunks")
    dealt = settle(found.repartitionByRange(max(1, -(-found.count() // 200_000)), F.col("doc_id").asc_nulls_last(), "root").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("ids"))
    sums = settle(sums.withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("part").alias("__part"), "before"))
    run = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "root").rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumn("upto", F.sum("n").over(run)).join(broadcast_if_small(sums), F.col("part") == F.col("__part"))
    out = out.select("part", "doc_id", (F.col("before") + F.col("upto") - F.col("n")).alias("start"), "n", "root", "chunks")
    out.sortWithinPartitions("part", "start").write.parquet(f"{folder}/recipes")
    _roots(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def _roots(recipes: DataFrame) -> DataFrame:
    """part, docs, ids, root from the roots of each part's documents, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle([x["root"] for x in rows]) for rows in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(roots, pa.binary())], ["part", "docs", "ids", "root"])

    grouped = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("ids"), F.array_sort(F.collect_list(F.struct("start", "root"))).alias("roots"))
    return grouped.mapInArrow(tidy(run), "part int, docs long, ids long, root binary")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """digest, size, data, wide, as a table in its buckets: a join by digest doesn't move it."""
    name, buckets = f"token_chunks_{uuid.uuid4().hex}", spark.read.schema("buckets int").parquet(f"{folder}/layout").first()[0]
    place = f"{folder}/encoded/kind=chunk"
    spark.sql(f"create table {name} (digest binary, size int, data binary, wide boolean) using parquet clustered by (digest) into {buckets} buckets location '{place}'")
    return spark.table(name)


def _put_together(n: int, root: bytes, chunks: list[bytes], found: list[dict]) -> np.ndarray:
    """The ids of a document from its chunks in order, checked."""
    made: list[np.ndarray] = []
    for name, x in zip(chunks, found, strict=True):
        if x["data"] is None:
            raise ValueError(f"chunk {name.hex()} is missing")
        made.append(_unpacked(x["data"], x["wide"]))
        if len(made[-1]) != x["size"] or digest(made[-1]) != name:
            raise ValueError(f"chunk {name.hex()} doesn't match its digest")
    ids = np.concatenate([*made, np.zeros(0, "<u4")])
    if len(ids) != n or merkle(chunks) != root:
        raise ValueError("a document doesn't match its root")
    return ids


def verify(spark: SparkSession, folder: str) -> None:
    """Raise ValueError unless the recipes give the manifest's roots."""
    now, then = _roots(spark.read.parquet(f"{folder}/recipes")), spark.read.parquet(f"{folder}/manifest")
    if now.exceptAll(then).limit(1).count() or then.exceptAll(now).limit(1).count():
        raise ValueError(f"{folder}: recipes and manifest differ")


def _read(spark: SparkSession, folder: str, made: Callable[[list[np.ndarray]], pa.Array], kind: str) -> DataFrame:
    """doc_id, start, n_tokens and made's column of every document, put together from its chunks. A chunk or document that is missing or
    wrong raises ValueError."""
    verify(spark, folder)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [_put_together(*row) for row in zip(*[part.column(c).to_pylist() for c in ("n", "root", "chunks", "found")], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], made(ids)], ["doc_id", "start", "n_tokens", "made"])

    recipes, chunks = spark.read.parquet(f"{folder}/recipes"), _chunks(spark, folder)
    x = F.struct("size", "data", "wide")
    one = recipes.where(F.size("chunks") == 1).withColumn("digest", F.element_at("chunks", 1)).join(chunks, "digest", "left")
    one = one.select("doc_id", "start", "n", "root", "chunks", F.array(x).alias("found"))
    named = recipes.where(F.size("chunks") != 1).select("doc_id", "start", "n", "root", "chunks", F.posexplode_outer("chunks").alias("at", "digest"))
    parts = named.select("start", "at", "digest").join(chunks, "digest", "left").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "size", "data", "wide"))).alias("found"))
    many = recipes.where(F.size("chunks") != 1).join(parts, "start", "left").select("doc_id", "start", "n", "root", "chunks", F.transform("found", lambda y: F.struct(y["size"].alias("size"), y["data"].alias("data"), y["wide"].alias("wide"))).alias("found"))
    schema = f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, made {kind}"
    return one.unionAll(many).mapInArrow(tidy(join), schema)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, put together and checked: see _read."""
    crcs = lambda ids: pa.array([zlib.crc32(x) for x in ids], pa.int64())
    return _read(spark, folder, crcs, "long").withColumnRenamed("made", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids array<int> of every document, put together and checked: see _read."""
    lists = lambda ids: pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))
    return _read(spark, folder, lists, "array<int>").withColumnRenamed("made", "ids")


def op3_token_store(spark, sf_dir):
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token_store-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder)


QUERIES = {"op3_token_store": op3_token_store}
ORACLE: dict[str, str] = {}
