"""Compression of vectors to one byte a part, with codebooks learned from all of them.

Vectors are cut into equal parts; each part is told by the nearest entry of its position's codebook, and the codebooks
are refined in rounds over all vectors (Lloyd's method, in whole numbers, so that any order of adding gives the same).
The nearest entry is found by annular pruning: entries are sorted by norm; by the triangle inequality one that is nearer
than the best so far has a norm within that distance of the vector's own, which two binary searches turn into an interval
of the sorted entries, and only that annulus is measured, exactly and with its borders included. Each task adds up its
vectors by entry before anything moves: a round sends one row for each entry that a task used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, settle, table, tidy

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts that are measured together: sorted by norm, so that their annuli nearly coincide.
_TOGETHER = 256


def limit_of(width: int) -> int:
    """The largest component that is told apart: with it, squared distances of parts and of whole vectors stay within 2^60."""
    return 2 ** ((58 - max(width * PARTS - 1, 1).bit_length()) // 2)


class Codebook:
    """The entries of one part position, ready to be searched: sorted by norm, of equal norms the lower index first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        squares = (entries * entries).sum(1)
        self.order = np.argsort(squares, kind="stable")
        self.squares = squares[self.order]
        self.norms = np.sqrt(self.squares.astype("f8"))
        self.sorted = entries[self.order]
        self.most = int(np.abs(entries).max(initial=0))
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, ties to the lower index; squared distance) for each row of x, whole numbers."""
        index, apart = np.zeros(len(x), "i8"), np.zeros(len(x), "i8")
        # Sums of products below 2^53 are exact in doubles, and much faster there.
        kind = "f8" if max(self.most, int(np.abs(x).max(initial=0))) ** 2 * max(x.shape[1], 1) < 2**51 else "i8"
        squares = (x * x).sum(1)
        norms, books = np.sqrt(squares.astype("f8")), self.sorted.astype(kind)
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, len(x), _TOGETHER):
            rows = by_norm[at : at + _TOGETHER]
            part, own = x[rows].astype(kind), norms[rows]
            # The best so far: the entries around the part's own norm.
            close = np.clip(np.searchsorted(self.norms, own), 0, len(self.norms) - 1)
            low, high = max(int(close.min()) - 4, 0), int(close.max()) + 4
            best = self._apart(part, squares[rows], books, low, high).min(1)
            # Norms are rounded: a little is added to the reach, so that no entry on the border is lost.
            reach = np.sqrt(best.astype("f8")) * (1 + 1e-12) + 1e-9 * (own + 1)
            low, high = int(np.searchsorted(self.norms, (own - reach).min(), "left")), int(np.searchsorted(self.norms, (own + reach).max(), "right"))
            found = self._apart(part, squares[rows], books, low, high)
            least = found.min(1)
            index[rows] = np.where(found == least[:, None], self.order[low:high], len(self.order)).min(1)
            apart[rows] = least.astype("i8")
        return index, apart

    def _apart(self, part: np.ndarray, squares: np.ndarray, books: np.ndarray, low: int, high: int) -> np.ndarray:
        self.measured += len(part) * len(books[low:high])
        return squares.astype(part.dtype)[:, None] + self.squares[low:high].astype(part.dtype) - 2 * (part @ books[low:high].T)


def whole_numbers(v: Column, limit: Column | int) -> Column:
    """floor(SCALE * x) of each component, held to the limit on both sides."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(limit).cast("double")), -F.lit(limit).cast("double"))))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> tuple[DataFrame, int]:
    """(vec_id, label, x: whole numbers; the length of a part). Vectors that are null or hold null or non-finite components are left out,
    and those whose length isn't the most frequent one (of two as frequent, the larger)."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.where(F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = most[0]["d"] if most else 0
    width = -(-d // PARTS)
    return rows.where(F.size("v") == d).select("vec_id", "label", whole_numbers(F.col("v"), limit_of(width)).alias("x")), width


def _cut(column: pa.Array, width: int) -> np.ndarray:
    """[vector, part, component]; vectors whose length the parts don't divide get zeros behind them."""
    flat = column.flatten().to_numpy().reshape(len(column), -1)
    return np.pad(flat, ((0, 0), (0, width * PARTS - flat.shape[1]))).reshape(len(column), PARTS, width)


def train(rows: DataFrame, width: int, *, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """[part, entry, component] from rows of usable(). The first entries are the parts of the smallest vec_ids (rows that share one: by
    their components; those without an id last); there are fewer where there are fewer rows. Entries that no part is nearest to stay."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()
    books = np.ascontiguousarray(_cut(first.column(0).combine_chunks(), width).transpose(1, 0, 2)) if first.num_rows else np.zeros((PARTS, 0, width), "i8")
    for _ in range(rounds if books.shape[1] and width else 0):
        known = books

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = [Codebook(b) for b in known]
            sums, counts = np.zeros(known.shape, "i8"), np.zeros(known.shape[:2], "i8")
            for batch in batches:
                for at in range(0, len(batch), 8192):
                    x = _cut(batch.column(0).slice(at, 8192), width)
                    for p in range(PARTS):
                        index, _ = search[p].nearest(np.ascontiguousarray(x[:, p]))
                        order = np.argsort(index, kind="stable")
                        used, begin = np.unique(index[order], return_index=True)
                        sums[p, used] += np.add.reduceat(x[order, p], begin, axis=0)
                        counts[p] += np.bincount(index, minlength=known.shape[1])
            part, entry = np.nonzero(counts)
            flat = sums[part, entry]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(flat.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), lists], ["part", "entry", "n", "sums"])

        found = rows.select("x").mapInArrow(tidy(add_up), "part int, entry int, n long, sums array<long>")
        added = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect()
        books = books.copy()
        for r in added:
            books[r["part"], r["entry"]] = np.array(r["sums"], "i8") // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distance in whole numbers) for each of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.slice(at, 8192)
                x = _cut(part.column(2), width)
                found = [search[p].nearest(np.ascontiguousarray(x[:, p])) for p in range(PARTS)]
                code = np.stack([i.astype("u1") for i, _ in found], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(a for _, a in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(tidy(run), f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, id_col="vec_id", code_col="code") -> DataFrame:
    """vec_id, decoded: the vectors (arrays of double) that the codes stand for, padding of lengths that four doesn't divide included; null for a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [None if c is None else np.concatenate([b[i] for b, i in zip(books, bytes.fromhex(c), strict=True)]) / SCALE for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.list_(pa.float64()))], ["vec_id", "decoded"])

    return codes.select(F.col(id_col).cast("long"), code_col).mapInArrow(tidy(run), "vec_id long, decoded array<double>")


def compress(vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col: str | None = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each usable row of vectors.

    Components count in whole numbers, floor(1024 * x); beyond limit_of() (65,536 for 64 dimensions) they are held to it, so that
    every sum fits. label_error: error summed over the rows of one label, those without one together. Repeated rows are each
    coded; an empty table gives no rows; vectors whose length four doesn't divide are coded as if zeros followed; at most 256
    entries fit a code. Left out: see usable. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: at most 256 entries")
    rows, width = usable(vectors, id_col, vector_col, label_col)
    books = train(rows, width, entries=entries, rounds=rounds)
    digest = hashlib.sha256(",".join(str(int(c)) for c in books.ravel()).encode()).hexdigest()
    coded = settle(encode(rows, books, width))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    both = coded.join(broadcast_if_small(settle(sums)), F.col("label").eqNullSafe(F.col("l")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    start = """
with v as materialized (select vec_id, label, [floor(1024 * c::double) for c in embedding] as x from embeddings
  where embedding is not null and len(embedding) = len([c for c in embedding if c is not null and isfinite(c)])),
p as materialized (select vec_id, label, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] as y from v, range(4) t(part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as idx, y from p where vec_id in (select vec_id from v order by vec_id limit 256)),
"""
    assign = """a{r} as materialized (select vec_id, label, part, any_value(y) as y, min(apart * 256 + idx) % 256 as idx, min(apart * 256 + idx) // 256 as apart
  from (select vec_id, label, p.part, p.y, idx, (list_dot_product(p.y, p.y) + list_dot_product(c{r}.y, c{r}.y) - 2 * list_dot_product(p.y, c{r}.y))::bigint as apart from p join c{r} using (part)) group by vec_id, label, part),
"""
    update = """c{s} as materialized (select c.part, c.idx, coalesce(n.y, c.y) as y from c{r} c left join (
  select part, idx, list(floor(total / n) order by i) as y from (
    select part, idx, i, sum(e) as total, count(*) as n from (select part, idx, unnest(range(1, len(y) + 1)) as i, unnest(y) as e from a{r}) group by part, idx, i) group by part, idx) n on n.part = c.part and n.idx = c.idx),
"""
    end = """e as (select vec_id, label, string_agg(lpad(to_hex(idx), 2, '0'), '' order by part) as code, sum(apart)::bigint as error from a{r} group by vec_id, label),
s as (select sha256(string_agg(c::bigint::varchar, ',' order by part, idx, i)) as codebooks_sha256 from (select part, idx, unnest(range(1, len(y) + 1)) as i, unnest(y) as c from c{r}))
select vec_id, lower(code) as code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from e, s
"""
    rounds = "".join(assign.format(r=r) + update.format(r=r, s=r + 1) for r in range(ROUNDS))
    return start + rounds + assign.format(r=ROUNDS) + end.format(r=ROUNDS)


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLE = {"op11_vector_codes": _sql()}
