"""Dates, vectors, scores and ladders of decisions, as Columns."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .text import ladder


def lenient_date(text: Column) -> Column:
    """A date from an ISO timestamp or from the first 10 characters; null if neither is one."""
    return F.coalesce(F.to_date(F.try_to_timestamp(text)), F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))))


def us_long_date(text: Column) -> Column:
    """'... Month d, yyyy ...' as a date; null without one."""
    found = F.regexp_extract(text, r"((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})", 1)
    return F.to_date(F.try_to_timestamp(found, F.lit("MMMM d, yyyy")))


def expand_year(year: Column) -> Column:
    """Two-digit years: up to 49 in the 2000s, others in the 1900s."""
    return F.when(year >= 100, year).when(year <= 49, year + 2000).otherwise(year + 1900)


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers; null if there is none."""
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")))


def published(text: Column) -> Column:
    """The part of an ISO time before its T; null for empty texts and for 0001-01-01, which stands for no date."""
    day = F.split_part(text, F.lit("T"), F.lit(1))
    return F.when((text != "") & ~F.startswith(day, F.lit("0001-01-01")), day)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 for empty vectors and vectors of different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    own = F.transform(v, lambda x: x.cast("double"))
    by = lambda norm: F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(own)
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), by), F.lit(0))  # the lambda's variable: the norm is found once, not for each component


def token_cell(token: Column, dims: int = 64) -> tuple[Column, Column]:
    """(cell, sign) of a token in a signed hashing embedding: the first two bytes of its SHA-256 and the parity of the third."""
    h = F.sha2(token, 256)
    cell = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % dims
    sign = F.when(F.conv(F.substring(h, 5, 2), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return cell, sign


#: Tokens of which a worker keeps the cell.
KEPT_TOKENS = 200_000
_TOKEN = re.compile("[a-z0-9]+")


_CELLS: dict[str, tuple[int, int]] = {}


def _place(token: str) -> tuple[int, int]:
    """(the first two bytes of its SHA-256, its sign) of a token."""
    h = hashlib.sha256(token.encode()).digest()
    if len(_CELLS) >= KEPT_TOKENS:
        _CELLS.clear()
    _CELLS[token] = found = (h[0] * 256 + h[1], 1 - h[2] % 2 * 2)
    return found


def _add_up(text: str | None, dims: int) -> list[float]:
    out = [0] * dims
    for token, times in Counter(_TOKEN.findall(text or "")).items():
        cell, sign = _CELLS.get(token) or _place(token)
        out[cell % dims] += sign * times
    return [float(x) for x in out]


def _signed_counts(lowered: pd.Series, dims: pd.Series) -> pd.Series:
    return pd.Series([_add_up(text, n) for text, n in zip(lowered, dims, strict=True)], dtype=object)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A text's tokens added up in signed cells (see token_cell), at length 1; a text without tokens is the zero vector.

    The tokens of a text are counted and their cells looked up in one pass: work grows with the text, not with the text times the cells.
    """
    return F.get(F.transform(F.array(F.pandas_udf(_signed_counts, ArrayType(DoubleType()))(F.lower(text), F.lit(dims))), unit), F.lit(0))


def confidence(missing: Column, citations: Column) -> Column:
    """From the numbers of missing fields and citations, 0.1 to 0.98."""
    score = F.lit(0.82) - F.least(F.lit(0.35), 0.07 * missing) + F.least(F.lit(0.15), 0.05 * citations) - F.when(citations == 0, 0.28).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.98), score))


def permit_path(decision: Column) -> Column:
    return ladder((decision == "likely_allowed", "by-right"), (decision == "conditional", "special_use_permit"), (decision == "restricted", "variance"), default="unknown")


def feasibility(decision: Column) -> Column:
    return ladder((decision == "likely_allowed", "feasible"), (decision == "restricted", "infeasible"), (decision == "conditional", "conditional"), default="unknown")


def finding_status(decision: Column) -> Column:
    return ladder((decision == "likely_allowed", "compliant"), (decision == "restricted", "non_compliant"), (decision == "conditional", "conditional"), default="unknown")


def verdict(description: Column, district: Column) -> Column:
    """The deterministic decision: unknown without a district, conditional for a bakery in a garage, else likely allowed."""
    t = F.lower(description)
    return ladder((district == "unknown", "unknown"), (t.contains("bakery") & t.contains("garage"), "conditional"), default="likely_allowed")
