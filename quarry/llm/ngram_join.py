"""N-gram Jaccard join: documents whose sets of word n-grams are alike, by joins in prefix trees.

Sets are ordered globally, rare n-grams first. Texts with equal sets form a class, and one set stands for it. Classes
whose sets have the same n-gram of smallest second hash are dealt to the same tries: in each, members are looked up,
sharing the overlap with common path pieces and leaving subtrees whose remaining length can't reach the threshold or
that are linked already. That finds most links. The rest is found through the n-grams that two linked sets
must share near their beginnings: n-grams there that join different components name pairs to look up in tries of their
own, first one pair for each two components, then all that are left. Bounds that no linked pair fails (place of the
n-gram, parity sketches, shared beginnings) keep the pairs few. So no link between components is lost, and large groups
of near copies aren't spelled out in pairs.

The order of n-grams comes from counts over all documents, in buckets: it steers the work, any order gives the same
components. N-grams are told apart by 58 bits of a hash, classes by 64.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, broadcast_if_small, cut, give_back, parts_of, settle, table, tidy
from .graph import components

#: Buckets that n-grams are counted in: about one for 32 n-grams, within these bounds (a byte each, sent to every task).
FEWEST, MOST_BUCKETS = 1 << 18, 1 << 25
#: Cells of the parity sketches: those that travel with n-grams are folds of those that pairs are checked with.
CELLS, WIDE = 256, 2048
_CHUNK = 1 << 14
_PART = 2_000_000  # bytes of text at a time, or one text
_LOW = np.uint64((1 << 58) - 1)


_LOWER = np.frombuffer(bytes(range(256)).lower(), "u1")  # A-Z only
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.random.default_rng(23).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE, _BACK = 0x9E3779B97F4A7C15 | 3, pow(0x9E3779B97F4A7C15 | 3, -1, 1 << 64)
_BLOCK = 1 << 21  # bytes hashed at a time


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words in UTF-8 bytes, A-Z in lower case, where each begins); a word ends at white space and at each border.

    A word's hash is the sum of its bytes' numbers times the powers of a base, from sums over all bytes: no word is made.
    """
    found, at, inside = [], 0, np.zeros(len(data) + 1, bool)
    inside[borders] = True
    while at < len(data):
        end = min(at + _BLOCK, len(data))
        while end < len(data) and not _SPACE[data[end]] and not inside[end]:  # to the end of a word
            step = _SPACE[data[end : end + _BLOCK]] | inside[end : min(end + _BLOCK, len(data))]
            end += int(step.argmax()) if step.any() else len(step)
        block = data[at:end]
        full = ~_SPACE[block]
        begins = full.copy()
        begins[1:] &= ~full[:-1] | inside[at + 1 : end]
        ends = full.copy()
        ends[:-1] &= ~full[1:] | inside[at + 1 : end]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        if len(first):
            n = max(_BLOCK, 1 << int(len(block) - 1).bit_length())
            sums = np.cumsum(_LETTER[_LOWER[block]] * _powers(_BASE, n)[: len(block)])
            h = sums[last] - np.where(first > 0, sums[first - 1], np.uint64(0))
            found.append((_mixed(h * _powers(_BACK, n)[first]), first + at))
        at = end
    if not found:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    return np.concatenate([h for h, _ in found]), np.concatenate([f for _, f in found])


def shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of the distinct n-grams of its words, A-Z in lower case; fewer than n words count as one n-gram."""
    if not len(texts):
        return []
    borders = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[borders[0] : borders[-1]]
    borders -= borders[0]
    w, starts = word_hashes(data, borders)
    at = np.searchsorted(starts, borders)
    size = len(w) - n + 1
    h = np.zeros(max(size, 0), "u8")
    for k in range(n if size > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : size + k]
    h = _mixed(h + np.uint64(n))
    out = []
    for a, b, there in zip(at.tolist(), at.tolist()[1:], texts.is_valid().to_pylist(), strict=False):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a and there:
            short = 0
            for x in w[a:b].tolist():
                short = (short * 0x9E3779B97F4A7C15 + x) % (1 << 64)
            out.append(_mixed(np.array([(short + b - a) % (1 << 64)], "u8")))
        else:
            out.append(np.zeros(0, "u8"))
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h & np.uint64(buckets - 1)).astype("i4")


def _levels(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """For each bucket of n-grams 0 if it is as full as most, or how many times that doubled. The buckets grow with the
    corpus, so that how full most are doesn't."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(max(1 << (size // 7 // 32).bit_length(), FEWEST), MOST_BUCKETS)
    chunks = buckets // _CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size, part = np.zeros(buckets, "u4"), [], 0, None

        def flush():
            if held:
                at, times = np.unique(np.concatenate(held), return_counts=True)
                total[at] += times.astype("u4")
            held.clear()

        for batch in batches:
            part = batch.column(1)[0].as_py() if len(batch) else part
            for _, texts in parts_of(batch, batch.column(0), _PART):
                held += [_bucket(h, buckets) for h in shingles(texts, n)]
                size += sum(map(len, held[-len(texts) :]))
                if size > 2_000_000:
                    flush()
                    size = 0
        flush()
        if part is not None:
            for i, c in enumerate(total.reshape(-1, _CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)], pa.binary())], ["chunk", "part", "counts"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_CHUNK, "u4")
        for data in rows["counts"]:
            total += np.frombuffer(zlib.decompress(data), "u4")
        return pd.DataFrame({"chunk": [key[0]], "part": [key[1]], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "chunk int, part int, counts binary"
    found = docs.select(F.col(text_col).alias("t"), F.spark_partition_id().alias("p")).mapInArrow(tidy(count), kind)
    for _ in range(2):  # sums of at most 100 each, however many partitions there are
        found = found.groupBy("chunk", F.floor(F.col("part") / 100).cast("int").alias("part")).applyInPandas(add, kind)
    total = np.zeros((chunks, _CHUNK), "u4")
    for row in settle(found).toLocalIterator():
        total[row["chunk"]] += np.frombuffer(zlib.decompress(row["counts"]), "u4")
    usual = max(2 * total.sum(dtype="i8") / buckets, 4.0)
    out = np.clip(np.floor(np.log2(np.maximum(total.ravel(), 1) / usual)) + 1, 0, 60).astype("u1")
    del total
    give_back()
    return out


def _ordered(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """n-grams as numbers whose order is the global one: level, then hash."""
    return np.sort((levels[_bucket(h, len(levels))].astype("u8") << np.uint64(58)) | (h & _LOW))


def _class_id(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(h: np.ndarray) -> bytes:
    """The parity of the n-grams in each of WIDE cells: it differs in at most as many cells as two sets differ in n-grams."""
    return np.packbits(np.bincount((h >> np.uint64(21) & np.uint64(WIDE - 1)).astype("i8"), minlength=WIDE) & 1).tobytes()


def needed(nx, ny, percent: int):
    """The smallest overlap at which sets of these sizes link: 100 * overlap >= percent * union."""
    return -((-percent * (nx + ny)) // (100 + percent))


class _Trie:
    """A compressed trie over ordered sets. Node: (first member, past the last, from depth, to depth, children, shortest, longest)."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        common = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common.append(int(differ.argmax()) if differ.any() else m)
        self.common = np.array(common)
        self.root = self._node(0, len(self.sets), 0)

    def _node(self, lo: int, hi: int, depth: int) -> list:
        sizes = self.sizes[lo:hi]
        to = len(self.sets[lo]) if hi - lo == 1 else int(self.common[lo + 1 : hi].min())
        return [lo, hi, depth, to, None, int(sizes.min()), int(sizes.max())]

    def children(self, node: list) -> list[list]:
        lo, hi, _, to, found, _, _ = node
        if found is None:
            cuts = [lo, *(np.flatnonzero(self.common[lo + 1 : hi] == to) + lo + 1).tolist(), hi] if hi - lo > 1 else []
            node[4] = found = [self._node(a, b, to) for a, b in zip(cuts, cuts[1:], strict=False)]
        return found


def link(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the number of one set of its component; sets are linked by a path of pairs at the threshold."""
    trie = _Trie(sets)
    group = np.arange(len(sets))
    for i, x in enumerate(trie.sets):
        n, stack = len(x), [(trie.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            lo, hi, depth, to, _, shortest, longest = node
            if hi <= i + 1 or (group[lo:hi] == group[i]).all():
                continue
            if to > depth:
                run = trie.sets[lo][depth:to]
                where = np.searchsorted(x[at:], run) + at
                overlap += int((x[np.minimum(where, n - 1)] == run)[where < n].sum())
                at = int(np.searchsorted(x, run[-1], side="right"))
            # The size at which the bound is best: what is left of x just fits.
            y = min(max(to + n - at, shortest), longest)
            if overlap + min(n - at, y - to) < needed(n, y, percent):
                continue
            if hi - lo == 1:
                group[group == group[lo]] = group[i]  # the bound, at the full length, is the overlap itself
            else:
                stack += [(c, overlap, at) for c in reversed(trie.children(node))]
    out = np.empty(len(sets), int)
    out[trie.order] = np.array(trie.order)[group] if len(sets) else group
    return out


def _links_in_groups(members: DataFrame, percent: int) -> DataFrame:
    """edges (a, b) of classes from members(gid, class_id, grams): each group is a trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, grams in _groups(batches):
            sets = [np.frombuffer(g, "u8") for g in grams]
            for at in link(sets, percent).reshape(1, -1):
                pairs = [(ids[i], ids[k]) for i, k in enumerate(at.tolist()) if i != k]
                yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.int64()) for j in (0, 1)], ["a", "b"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "gid").sortWithinPartitions("gid", "class_id").mapInArrow(tidy(run), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Class ids and sets of each group of rows sorted by (gid, class_id), each class once."""
    now, ids, grams = None, [], []
    for batch in batches:
        for gid, one, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if gid != now:
                if len(ids) > 1:
                    yield ids, grams
                now, ids, grams = gid, [], []
            if not ids or ids[-1] != one:
                ids.append(one)
                grams.append(data.as_py())
    if len(ids) > 1:
        yield ids, grams


def _with_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, n: int, levels: np.ndarray) -> DataFrame:
    """members(gid, class_id, rep) with the ordered set of each class, from the text of its document rep: gid, class_id, grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts_of(batch, batch.column(0), _PART):
                gids, ids, sets = [], [], []
                for h, found in zip(shingles(texts, n), part.column(1).to_pylist(), strict=True):
                    own, data = _class_id(h), _ordered(h, levels).tobytes()
                    for m in found:
                        if m["class_id"] == own:  # else the id stands for other texts, too
                            gids.append(m["gid"]), ids.append(own), sets.append(data)
                yield pa.RecordBatch.from_arrays([pa.array(gids, pa.string()), pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["gid", "class_id", "grams"])

    # Each class is in few groups at a time: see the callers.
    wanted = cut(members.groupBy("rep").agg(F.collect_set(F.struct("gid", "class_id")).alias("in")))
    texts = docs.join(broadcast_if_small(wanted, 500_000), docs[id_col].eqNullSafe(wanted["rep"])).select(docs[text_col].alias("t"), "in")
    return texts.mapInArrow(tidy(run), "gid string, class_id long, grams binary")


def _split_groups(members: DataFrame, most: int, grams: int) -> DataFrame:
    """members(gid, class_id, rep, n) with large groups dealt into parts of about `most` sets or `grams` n-grams; groups of one go."""
    sizes = members.groupBy("gid").agg(F.count(F.lit(1)).alias("__k"), F.sum("n").alias("__n")).where("__k > 1")
    sizes = cut(sizes.select(F.col("gid").alias("__gid"), F.ceil(F.greatest(F.col("__k") / most, F.col("__n") / grams)).alias("__parts")))
    part = F.pmod(F.xxhash64("class_id"), F.col("__parts"))
    return members.join(broadcast_if_small(sizes), F.col("gid") == F.col("__gid")).select(F.concat_ws("-", "gid", part).alias("gid"), "class_id", "rep", "n")


def similar_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", n: int = 5, percent: int = 80, most: int = 256, grams: int = 1_000_000) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, class_id.

    Documents link when 100 * intersection >= percent * union of their sets of distinct word n-grams. component_id is the
    smallest doc_id that links reach, the document's own if there is none; class_id is equal for equal sets. Null and
    empty texts and texts without words have n_shingles 0 and link with nothing. Null ids link by their texts like
    others. Other columns are ignored. most and grams bound a trie's sets and n-grams.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    levels = _levels(docs, "text", n)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts_of(batch, batch.column(1), _PART):
                sizes, ids, anchors, sketches, heads = [], [], [], [], []
                for h in shingles(texts, n):
                    sizes.append(len(h))
                    ids.append(_class_id(h) if len(h) else None)
                    anchors.append(int((h * np.uint64(0xD6E8FEB86659FD93) ^ h >> np.uint64(31)).min().astype("i8")) if len(h) else None)
                    sketches.append(_sketch(h))
                    heads.append(_ordered(h, levels)[: len(h) - -(-percent * len(h) // 100) + 1].astype("i8"))
                ends = np.cumsum([0, *map(len, heads)]).astype("i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*heads, np.zeros(0, "i8")])))
                cells = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(b"".join(sketches), "i8")), WIDE // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(anchors, pa.int64()), cells, lists], ["doc_id", "n", "class_id", "anchor", "sketch", "head"])

    rows = docs.mapInArrow(tidy(begin), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, class_id long, anchor long, sketch array<long>, head array<long>")
    all_rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    with Held() as held:

        def look_up(members: DataFrame) -> DataFrame:
            return _links_in_groups(_with_sets(docs, members, "doc_id", "text", n, levels), percent)

        copied = _copied(all_rows)
        classes = _classes(held, all_rows, copied)
        branches = classes.select(F.col("anchor").cast("string").alias("gid"), "class_id", "rep", "n")
        edges = cut(look_up(_split_groups(branches, most, grams)))
        known = components(edges)
        posts = held(_open_posts(held, classes, known, percent))
        for last in (False, True):
            pairs = cut(_open_pairs(posts, known, percent, last))
            pairs = cut(_overlapping(cut(_near(pairs, classes, percent)), classes, percent))
            if pairs.limit(1).count():
                edges = edges.unionAll(cut(look_up(_pair_groups(pairs, most))))
                known = components(edges)
        return _label(all_rows, classes, copied, known)


def _copied(rows: DataFrame) -> DataFrame:
    """class_id, kept, rep of each class of several rows: the row that stands for it, of the smallest doc_id, and that doc_id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    found = rows.where("class_id is not null").groupBy("class_id").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return cut(found.select("class_id", F.col("first.row").alias("kept"), F.col("first.doc_id").alias("rep")))


def _classes(held: Held, rows: DataFrame, copied: DataFrame, most: int = 500_000) -> DataFrame:
    """class_id, n, anchor, sketch, head, rep: a row of each class. Rows stay where they are while few classes have copies;
    otherwise Spark picks the join, and its result is kept."""
    few = copied.limit(most + 1).count() <= most
    of = copied.select(F.col("class_id").alias("__class"), "kept")
    joined = rows.where("class_id is not null").join(F.broadcast(of) if few else of, F.col("class_id") == F.col("__class"), "left").where("kept is null or kept = row")
    found = joined.select("class_id", "n", "anchor", "sketch", "head", F.col("doc_id").alias("rep"))
    return found if few else held(found)


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with c, the component of class_id, and many: whether that has several members."""
    of = known.select(F.col("node").alias("__node"), "component")
    joined = rows.join(broadcast_if_small(of, 500_000), F.col("class_id") == F.col("__node"), "left")
    return joined.select(*rows.columns, F.coalesce("component", "class_id").alias("c"), F.col("component").isNotNull().alias("many"))


def _open_posts(held: Held, classes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """class_id, n, s0.., at, lead, gram, m: the beginnings of sets, only n-grams that different components have there.

    Of two linked sets the smaller has an n-gram they share among its first n - needed(n, n) + 1 (lead), the larger among
    its first n - percent% of n + 1. m: whether one of the components has several members. An n-gram of two sets whose
    sizes are too far apart joins nothing.
    """
    cells = []
    for i in range(CELLS // 64):
        folded = F.get("sketch", F.lit(i))
        for k in range(i + CELLS // 64, WIDE // 64, CELLS // 64):
            folded = folded.bitwiseXOR(F.get("sketch", F.lit(k)))
        cells.append(folded.alias(f"s{i}"))
    posts = _labelled(classes.select("class_id", "n", *cells, "head"), known)
    posts = posts.select("class_id", "n", *[f"s{i}" for i in range(CELLS // 64)], "c", "many", F.posexplode("head").alias("at", "gram"))
    posts = posts.withColumn("lead", F.col("at") <= F.col("n") - F.ceil(F.lit(2 * percent) * F.col("n") / (100 + percent)))
    state = posts.groupBy("gram").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.max("many").alias("m"), F.max("lead").alias("lead"))
    grams = cut(state.where("a <> b and lead").select(F.col("gram").alias("__gram"), "m"))
    posts = held(posts.drop("c", "many").join(broadcast_if_small(grams, 2_000_000), F.col("gram") == F.col("__gram")).drop("__gram"))
    sizes = posts.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    apart = cut(sizes.where((F.col("k") == 2) & (F.col("lo") * 100 < F.col("hi") * percent)).select(F.col("gram").alias("__gram")))
    return posts.join(broadcast_if_small(apart, 2_000_000), F.col("gram") == F.col("__gram"), "left_anti")


def _open_pairs(posts: DataFrame, known: DataFrame, percent: int, last: bool) -> DataFrame:
    """Pairs (x, y) of classes of different components that may link.

    last: all such pairs. Otherwise one pair for each two components, of which one has several members. A pair doesn't
    link if the place of an n-gram leaves too few for the rest, or if the sketches show that the sets differ in too
    many n-grams.
    """
    posts, cells = _labelled(posts if last else posts.where("m"), known).drop("m"), [f"s{i}" for i in range(CELLS // 64)]
    if last:
        posts = posts.drop("many")
    else:
        posts = posts.groupBy("gram", "c").agg(F.min(F.struct((~F.col("lead")).alias("late"), "n", "class_id", *cells, "at", "lead", "many")).alias("s")).select("gram", "c", "s.*").drop("late")
    x, y = posts.where("lead").drop("lead").alias("x"), posts.drop("lead").alias("y")
    need = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / (100 + percent))
    room = F.least("x.at", "y.at") + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    differ = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in cells), F.lit(0))
    first = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.class_id") < F.col("y.class_id")))
    fits = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.c") != F.col("y.c")) & (first | F.lit(not last)) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    met = x.join(y, fits & (room >= need) & (differ <= F.col("x.n") + F.col("y.n") - 2 * need))
    pair = F.struct(F.col("x.class_id").alias("x"), F.col("y.class_id").alias("y"))
    if last:
        return met.select(pair.alias("s")).distinct().select("s.*")
    return met.where("x.many or y.many").groupBy(F.least("x.c", "y.c").alias("low"), F.greatest("x.c", "y.c").alias("high")).agg(F.min(pair).alias("s")).select("s.*")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide sketches allow a link, with x_rep and y_rep."""
    named = broadcast_if_small(pairs, 500_000)
    sides = [classes.join(named, F.col("class_id") == F.col(s)).select("x", "y", F.col("n").alias(f"{s}n"), F.col("sketch").alias(f"{s}s"), F.col("rep").alias(f"{s}_rep")) for s in "xy"]
    differ = F.aggregate(F.zip_with("xs", "ys", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, v: t + v)
    need = F.ceil(F.lit(percent) * (F.col("xn") + F.col("yn")) / (100 + percent))
    return sides[0].join(sides[1], ["x", "y"]).where(differ <= F.col("xn") + F.col("yn") - 2 * need).select("x", "x_rep", "y", "y_rep")


def _overlapping(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose beginnings share enough n-grams: beyond the end of the one that ends first, only its own rest can be shared.

    31 bits of each n-gram are enough here: a chance match only lets a pair through.
    """
    named, bits = broadcast_if_small(pairs.select("x", "y"), 500_000), F.transform("head", lambda g: g.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    sides = [classes.join(named, F.col("class_id") == F.col(s)).select("x", "y", F.col("n").alias(f"{s}n"), bits.alias(f"{s}h")) for s in "xy"]
    rest = F.greatest(F.col("xn") - F.size("xh"), F.col("yn") - F.size("yh"))
    shared = F.size(F.array_intersect("xh", "yh")) + (F.size("xh") - F.size(F.array_distinct("xh")))
    both = sides[0].join(sides[1], ["x", "y"]).where((shared + rest) * (100 + percent) >= percent * (F.col("xn") + F.col("yn")))
    return pairs.join(both.select("x", "y"), ["x", "y"])


def _pair_groups(pairs: DataFrame, most: int) -> DataFrame:
    """members(gid, class_id, rep): each x with the sets it is to be compared with, dealt into groups of about `most`."""
    parts = cut(pairs.groupBy(F.col("x").alias("__x")).agg(F.ceil(F.count(F.lit(1)) / most).alias("__parts")))
    dealt = pairs.join(broadcast_if_small(parts), F.col("x") == F.col("__x")).withColumn("gid", F.concat_ws("-", "x", F.pmod(F.xxhash64("y"), F.col("__parts"))))
    own = dealt.select("gid", F.col("x").alias("class_id"), F.col("x_rep").alias("rep")).distinct()
    return own.unionAll(dealt.select("gid", F.col("y").alias("class_id"), F.col("y_rep").alias("rep")))


def _label(rows: DataFrame, classes: DataFrame, copied: DataFrame, known: DataFrame) -> DataFrame:
    """Only classes of several documents or sets need a look-up; any other document is its own component."""
    of = known.select(F.col("node").alias("__node"), "component")
    linked = classes.select("class_id", "rep").join(broadcast_if_small(of, 500_000), F.col("class_id") == F.col("__node")).select("class_id", "rep", F.col("component").alias("c"))
    alone = copied.join(of, F.col("class_id") == F.col("__node"), "left_anti").select("class_id", "rep", F.col("class_id").alias("c"))
    named = cut(linked.unionAll(alone))
    least = cut(named.groupBy(F.col("c").alias("__c")).agg(F.min("rep").alias("component_id")))
    labels = cut(named.join(least, F.col("c") == F.col("__c")).select(F.col("class_id").alias("__class"), "component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "class_id").join(broadcast_if_small(labels, 500_000), F.col("class_id") == F.col("__class"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "class_id")


def keep_one_of_each(docs: DataFrame, *, id_col="doc_id", text_col="text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs less all but one of each group that links join: the one of the smallest id stays.

    Where ids are null or repeat, rows are told apart by their place, and of equal ids the first row stays. Rows
    without words all stay.
    """
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("k")).where("k > 1 or id is null")
    if ids.limit(1).count():
        key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    else:
        key = F.col(id_col)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], key.alias("__key"))
    found = similar_documents(rows, id_col="__key", text_col=f"c{docs.columns.index(text_col)}", n=n, percent=percent)
    gone = settle(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")))
    kept = rows.join(broadcast_if_small(gone, 500_000), F.col("__key") == F.col("__gone"), "left_anti")
    return kept.drop("__key").toDF(*docs.columns)


def op7_ngram_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"), n=4, percent=85)


QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLE: dict[str, str] = {}
