"""Language ID by error-correcting output codes.

Each language has a codeword; a logistic classifier over hashed character n-grams predicts each bit. A text gets the
language whose codeword has the least loss, bits weighted by how well their classifier does on rows kept from its
training; texts whose two best codewords lie close together are flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep_rows, learnable, table, text_batches, tidy, unit_hash

DIMS = 4096
SEED = 7


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Counts of character 1- to 3-grams of the whole lower-cased text by hash, logarithmic, of length 1."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(c < 65, np.uint32(32), c)  # digits, spaces and most marks count as one
    two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) ^ c[2:]
    counts = np.zeros(DIMS, "f4")
    for k, grams in enumerate((c, two, three)):
        h = (grams ^ np.uint32(0x632BE5AB * (k + 1) & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
        counts += np.bincount(h >> np.uint32(20), minlength=DIMS)
    out = np.log1p(counts)
    return out / max(float(np.sqrt(out @ out)), 1e-9)


def codewords(n: int, seed: int = SEED) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 5 languages, else the best spread of some random codes of 10 log2(n) bits."""
    if n <= 5:
        return np.array([[1 if k == 0 or not (b >> (k - 1)) & 1 else -1 for b in range(1, 2 ** (n - 1))] for k in range(n)], "f4").reshape(n, -1)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, most = None, -1.0
    for _ in range(200):
        code = rng.choice(np.array([-1.0, 1.0], "f4"), (n, bits))
        apart = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if apart > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, apart
    return best


def fit(x: np.ndarray, y: np.ndarray, n: int, *, steps: int = 120, rate: float = 0.02, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """A classifier for each bit, by gradient descent with momentum; each language counts alike. y: language numbers."""
    code = codewords(n)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < n:
        held[:] = False
    xt, yt = x[~held], y[~held]
    share = (1 / np.bincount(yt, minlength=n).clip(1))[yt].astype("f4")[:, None] / n
    target = code[yt]
    w, b = np.zeros((x.shape[1], code.shape[1]), "f4"), np.zeros(code.shape[1], "f4")
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    scale = 40.0
    for _ in range(steps):
        pull = -target / (1 + np.exp(np.clip(target * (xt @ w * scale + b), -30, 30))) * share
        vw = 0.9 * vw + (xt.T @ pull) * scale + decay * w
        vb = 0.9 * vb + pull.sum(0)
        w, b = w - rate * vw, b - rate * vb
    test = held if held.any() else ~held
    right = ((x[test] @ w * scale + b) * code[y[test]] > 0).mean(0)
    return {"code": code, "w": w * scale, "b": b, "trust": np.clip(2 * right - 1, 0.05, 1).astype("f4")}


def decode(model: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score from 0 to 1, margin to the second language) of each row of x."""
    n = len(model["code"])
    if n == 1:
        return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
    f = x @ model["w"] + model["b"]
    # log(1 + exp(-c f)) is its mean over c = 1 and -1, less c f / 2: no array of rows x languages x bits.
    share = model["trust"] / model["trust"].sum()
    loss = ((np.logaddexp(0, f) - f / 2) @ share)[:, None] - (f * share / 2) @ model["code"].T
    odds = np.exp(-(loss - loss.min(1, keepdims=True)) * model["code"].shape[1] / 2)
    p = odds / odds.sum(1, keepdims=True)
    two = np.sort(p, 1)
    return loss.argmin(1), p.max(1).astype("f8"), (two[:, -1] - two[:, -2]).astype("f8")


def train(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", sample: int = 2400) -> tuple[list[str], dict | None]:
    """(languages, model) from about `sample` rows, spread evenly over all languages, from 20 rows on for each.

    Only rows with a text with letters, a language and crc32(id) mod 3 other than 1 take part; each language with such a row is learned.
    """
    rows = docs.where(learnable(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return [], None
    each = max(20, sample // len(counts))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in counts], "__lang string, __rate double")
    chosen = rows.join(F.broadcast(rates), F.col(lang_col) == F.col("__lang")).where(unit_hash(F.col(id_col), seed=SEED) < F.col("__rate"))  # a row for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(1)):
                full = [i for i, t in enumerate(texts) if has_letter(t)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full, pa.int64())), pa.array([features(texts[i]).astype("f2").tobytes() for i in full], pa.binary())], ["lang", "x"])

    found = chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "lang string, x binary").orderBy("lang", F.xxhash64("x"), "x").collect()
    names = sorted({r["lang"] for r in found})
    if not names:
        return [], None
    place = {k: i for i, k in enumerate(names)}
    x = np.stack([np.frombuffer(r["x"], "f2") for r in found]).astype("f4")
    y = np.array([place[r["lang"]] for r in found])
    del found
    model = fit(x, y, len(names)) if len(names) > 1 else {"code": np.ones((1, 0), "f4")}
    del x, y
    give_back()
    return names, model


def judge(texts: list[str | None], names: list[str], model: dict | None) -> tuple[list[str], list[float], list[float]]:
    """(language, score, margin) of each text; 'und', 0, 0 for null texts, texts without a letter, and where nothing was learned."""
    full = [i for i, t in enumerate(texts) if names and has_letter(t)]
    lang, score, margin = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    for at in range(0, len(full), 256):
        some = full[at : at + 256]
        for i, k, s, m in zip(some, *decode(model, np.stack([features(texts[i]) for i in some])), strict=True):
            lang[i], score[i], margin[i] = names[k], float(s), float(m)
    return lang, score, margin


def identify(docs: DataFrame, names: list[str], model: dict | None, *, id_col="doc_id", text_col="text", close: float = 0.1) -> DataFrame:
    """A row for each row of docs: doc_id, lang_pred, score, margin, ambiguous (margin below close).

    See judge() for texts without a language. Repeated rows and ids are judged row by row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_batches(batch, batch.column(1)):
                lang, score, margin = judge(texts, names, model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, margin double")
    return out.withColumn("ambiguous", F.col("margin") < close)


def keep_identified(docs: DataFrame, names: list[str], model: dict | None, *, text_col="text", close: float = 0.1) -> DataFrame:
    """The rows of docs whose language is known and not ambiguous, with all their columns."""

    def decide(texts: list[str | None]) -> list[bool]:
        lang, _, margin = judge(texts, names, model)
        return [k != "und" and m >= close for k, m in zip(lang, margin, strict=True)]

    return keep_rows(docs, text_col, decide)


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, model = train(docs)
    return identify(docs, names, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "ambiguous")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
