"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The word class of the contracts: runs of anything but ASCII space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"

#: Runs of letters and digits, all beyond ASCII among them, once A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared folder: later readers and lost executors don't compute it again, so the shuffle files that it took go at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    shared_dir(spark)
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return df.select("*").checkpoint()  # a new frame takes the setting
    finally:
        spark.conf.set(key, before)


class Held:
    """Tables that several jobs read, kept on the executors' disks, not in their memory (and computed again if one is lost), until the block ends."""

    def __init__(self):
        self._frames: list[DataFrame] = []

    def __enter__(self) -> Held:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self._frames.append(df.persist(StorageLevel.DISK_ONLY))
        return self._frames[-1]

    def __exit__(self, *_) -> None:
        for df in self._frames:
            df.unpersist()
        self._frames.clear()
        give_back()


def cut(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df settled, in one file for so many rows: for results that are small beside the work they take.

    A settled table hands on Spark's guess of its size, which joins multiply; once held and counted its size is known. Without that
    the guess has twice the digits after each round of joins, and planning takes minutes.
    """
    with Held() as held:
        kept = held(settle(df))
        return settle(kept.coalesce(max(1, -(-kept.count() // rows))))


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null. Each word becomes one mark, so memory stays near the text's own size."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, _SPACES, "")), F.lit(0)).cast("long")


def terms(text: Column) -> Column:
    """The terms of a text in order, lower-cased in A-Z alone; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def terms_of(utf8: bytes) -> list[bytes]:
    """terms() of one text in UTF-8: each byte that is no part of a term becomes a space."""
    return utf8.translate(_TERM_BYTES).split()


def unit_hash(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) from the parts; the same in any engine that has md5."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def learnable(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is not 1: the rows that models may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A settled table as a broadcast side where it has few rows; beyond that Spark picks the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def parts_of(batch: pa.RecordBatch, texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch, of about `most` bytes of text or one text each, so that memory is bounded by the longest text."""
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if i > start and held + (n or 0) > most:
            yield batch.slice(start, i - start), texts.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(texts):
        yield batch.slice(start), texts.slice(start)


def give_back() -> None:
    """Give what this process has freed back to the system: frames that are no longer used (and their plans in the JVM), Arrow's pool, the C heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, giving the memory it freed back to the system behind each batch it puts out and at its end: workers live on for
    later tasks, and what their allocators keep (up to 200 MB were measured) counts against the executor's memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            trim = ctypes.CDLL(None).malloc_trim
        except (OSError, AttributeError):  # another C library
            trim = int
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()
            trim(0)
        pa.default_memory_pool().release_unused()
        trim(0)

    return tidied


def text_batches(batch: pa.RecordBatch, texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for part, some in parts_of(batch, texts, most):
        yield part, some.to_pylist()


#: Bytes of rows that cross to a Python worker at once.
BATCH_BYTES = 8_000_000


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session's rows cross to Python workers in batches of about `most` bytes, or one row: with texts of some KB, 10,000 rows at once
    are several times that, in the JVM's buffers and in the worker's. A smaller bound that the session has is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def keep_rows(docs: DataFrame, text_col: str, decide: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of docs whose text decide() accepts, with all their columns, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(at)):
                yield part.filter(pa.array(decide(texts), pa.bool_()))

    names = [f"c{i}" for i in range(len(docs.columns))]
    kind = StructType([StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    return docs.toDF(*names).mapInArrow(tidy(run), kind).toDF(*docs.columns)
