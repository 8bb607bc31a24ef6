"""Constraints as data: rows that meet them all are kept, the others put aside with reasons, in one pass with counters."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.sources.tables import settled


@dataclass(frozen=True)
class Constraint:
    """kind: required, min_length, max_length, at_least, at_most, one_of, matches. All but `required` hold for null."""

    field: str
    kind: str
    bound: object = None

    @property
    def name(self) -> str:
        return f"{self.field}: {self.kind}" + ("" if self.bound is None else f" {'|'.join(self.bound) if isinstance(self.bound, tuple) else self.bound}")

    def broken(self) -> Column:
        """True where the row breaks it, never null."""
        c, b = F.col(self.field), self.bound
        tests = {
            "required": lambda: c.isNull(), "min_length": lambda: F.length(c) < b, "max_length": lambda: F.length(c) > b, "at_least": lambda: (c < b) | F.isnan(c.cast("double")),
            "at_most": lambda: (c > b) | F.isnan(c.cast("double")), "one_of": lambda: ~c.isin(*b), "matches": lambda: ~c.rlike(b),
        }
        return F.coalesce(tests[self.kind](), F.lit(False))


def _sized(field: str, least: int | None, most: int | None, required: bool = True) -> list[Constraint]:
    out = [Constraint(field, "required")] if required else []
    out += [Constraint(field, "min_length", least)] if least else []
    return out + ([Constraint(field, "max_length", most)] if most else [])


# The lengths and ranges of a source's and a chunk's fields.
SOURCE = tuple(
    [*_sized("source_id", 2, 200), *_sized("title", 3, 500), *_sized("excerpt", 10, 4000), *_sized("section_ref", 1, 200), *_sized("jurisdiction_id", None, 200, False), *_sized("url", None, 2000, False)]
    + [*_sized("effective_date", None, 50, False), *_sized("source_type", 1, 200), *_sized("retrieved_at", None, 80, False), *_sized("source_version", None, 120, False), *_sized("content_hash", 64, 64, False), *_sized("full_text", None, 250_000, False)]
)
CHUNK = tuple(
    [*_sized("chunk_id", 2, 240), *_sized("source_id", 2, 200), *_sized("title", 3, 500), *_sized("chunk_text", 10, 1200), Constraint("chunk_index", "required"), Constraint("chunk_index", "at_least", 0), *_sized("source_text_hash", 64, 64)]
    + [*_sized("section_ref", 1, 200), *_sized("jurisdiction_id", None, 200, False), *_sized("url", None, 2000, False), *_sized("effective_date", None, 50, False), *_sized("source_type", 1, 200), Constraint("token_count", "at_least", 0)]
)


def of_columns(rows: DataFrame, constraints: tuple[Constraint, ...]) -> tuple[Constraint, ...]:
    """The constraints on columns that rows has."""
    return tuple(c for c in constraints if c.field in rows.columns)


def judged(rows: DataFrame, constraints: tuple[Constraint, ...], reasons: str = "reasons") -> DataFrame:
    """rows with the names of the constraints each breaks, in their order; an empty array for those that are right."""
    told = [F.when(c.broken(), F.lit(c.name)) for c in constraints]
    return rows.withColumn(reasons, F.array_compact(F.array(*told)) if told else F.array().cast("array<string>"))


def split(rows: DataFrame, constraints: tuple[Constraint, ...], reasons: str = "reasons") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(kept, rejected with their reasons, counters): rows are read and judged once, into the shared folder. Counters: rows, kept, rejected and
    each constraint by name, observed in that pass. A missing column is an AnalysisException; an empty table gives zeros."""
    seen = Observation()
    bad = functools.reduce(lambda a, b: a | b, [c.broken() for c in constraints], F.lit(False))
    counters = [F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("kept"), F.count_if(bad).alias("rejected"), *[F.count_if(c.broken()).alias(c.name) for c in constraints]]
    both = settled(judged(rows.observe(seen, *counters), constraints, reasons))
    return both.where(F.size(reasons) == 0).drop(reasons), both.where(F.size(reasons) > 0), dict(seen.get)


def report(counters: dict[str, int], rows: DataFrame) -> DataFrame:
    """(name, n): the counters as a table."""
    return rows.sparkSession.createDataFrame(sorted(counters.items()), "name string, n long")
