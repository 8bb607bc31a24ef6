"""Replies of models: JSON that may be fenced, nested or flat, typed or not, read as variants.

What a reply says wrong is put right or left out field by field; only what is no JSON object at all has an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the fields may say, and the decision that follows from feasibility.
DECISIONS = ("likely_allowed", "conditional", "restricted", "unknown")
FOLLOWS = {"feasible": "likely_allowed", "conditional": "conditional", "infeasible": "restricted", "unknown": "unknown"}
STATUSES = ("compliant", "conditional", "non_compliant", "unknown")
NO_SUMMARY = "Local model did not return a usable summary."
CAPPED = "Confidence capped because no valid citation IDs were supplied."
CAP = 0.3


def unfenced(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _text(v: Column, path: str) -> Column:
    """A scalar as text, null where it is empty, an object, a list or not there."""
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def _texts(v: Column, path: str) -> Column:
    """The scalars of a list as texts; none where it is no list."""
    return F.array_compact(F.coalesce(F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")), F.array().cast("array<string>")))


def _share(v: Column, path: str, default: float) -> Column:
    """A number, or text that is one, held within 0 and 1."""
    n = F.try_variant_get(v, path, "double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n.isNull() | F.isnan(n), F.lit(default)).otherwise(n)))


def _one_of(c: Column, values: tuple[str, ...]) -> Column:
    return F.when(c.isin(*values), c).otherwise("unknown")


def normalised(rows: DataFrame, reply: str = "reply", allowed: str = "allowed") -> DataFrame:
    """rows with decision, feasibility, confidence, summary, findings, required_permits, permit_path, warnings, unresolved_questions,
    follow_up_questions, citation_ids and error, which replace columns of these names.

    The findings may stand in the reply itself or under `compliance`. allowed: the ids that may be cited (null or empty: any); others go, with a
    warning, and without a valid citation the confidence is 0.3 at most. Values out of their closed lists count as unknown, lists that are
    none as empty. A reply that is null or no JSON object gives unknown, confidence 0, empty lists, and an error.
    """
    v = F.try_parse_json(unfenced(F.col(reply)))
    work = rows.withColumn("__v", v).withColumn("__error", F.when(F.col(reply).isNull(), "no reply").when(F.col("__v").isNull(), "no JSON").when(~is_object(F.col("__v")), "no object"))
    work = work.withColumn("__nested", F.try_variant_get("__v", "$.compliance", "variant"))
    work = work.withColumn("__raw", F.when(is_object(F.col("__nested")), F.col("__nested")).otherwise(F.col("__v")))
    top, raw = F.col("__v"), F.col("__raw")
    any_id = F.size(F.coalesce(F.col(allowed), F.array().cast("array<string>"))) == 0
    valid = lambda ids: F.when(any_id, ids).otherwise(F.filter(ids, lambda x: F.array_contains(F.col(allowed), x)))
    work = work.withColumn("__cited", _texts(raw, "$.citation_chunk_ids")).withColumn("__valid", valid(F.col("__cited")))
    wrong = F.array_sort(F.array_except("__cited", "__valid"))
    share = _share(raw, "$.confidence", CAP)
    cap = (F.size("__valid") == 0) & (share > CAP)
    finding = lambda f: F.struct(
        F.coalesce(_text(f, "$.category"), F.lit("general")).alias("category"), _one_of(_text(f, "$.status"), STATUSES).alias("status"), F.coalesce(_text(f, "$.summary"), F.lit("")).alias("summary"),
        valid(_texts(f, "$.citation_ids")).alias("citation_ids"), _share(f, "$.confidence", CAP).alias("confidence"),
    )
    listed = F.filter(F.coalesce(F.try_variant_get(raw, "$.findings", "array<variant>"), F.expr("cast(array() as array<variant>)")), is_object)
    feasibility = _one_of(_text(raw, "$.feasibility"), tuple(FOLLOWS))
    said = F.coalesce(_text(top, "$.decision"), F.lit("unknown"))
    follows = F.element_at(F.create_map(*[F.lit(x) for pair in FOLLOWS.items() for x in pair]), feasibility)
    none = F.array().cast("array<string>")
    permits = F.when(F.try_variant_get(raw, "$.required_permits", "variant").isNotNull(), _texts(raw, "$.required_permits")).otherwise(_texts(top, "$.required_permits"))
    warnings = F.concat(_texts(raw, "$.warnings"), F.when(F.size(wrong) > 0, F.array(F.concat(F.lit("Invalid citation IDs were removed: "), F.array_join(wrong, ", ")))).otherwise(none), F.when(cap, F.array(F.lit(CAPPED))).otherwise(none))
    told = {
        "decision": (F.when(said == "unknown", follows).otherwise(_one_of(said, DECISIONS)), F.lit("unknown")), "feasibility": (feasibility, F.lit("unknown")), "confidence": (F.when(cap, F.lit(CAP)).otherwise(share), F.lit(0.0)),
        "summary": (F.coalesce(_text(raw, "$.summary"), _text(top, "$.summary"), F.lit(NO_SUMMARY)), F.lit(NO_SUMMARY)), "findings": (F.transform(listed, finding), None), "required_permits": (permits, none),
        "permit_path": (F.coalesce(_text(raw, "$.permit_path"), F.lit("unknown")), F.lit("unknown")), "warnings": (warnings, none), "unresolved_questions": (_texts(raw, "$.unresolved_questions"), none),
        "follow_up_questions": (_texts(top, "$.follow_up_questions"), none), "citation_ids": (F.col("__valid"), none),
    }
    failed = F.col("__error").isNotNull()
    columns = {k: F.when(~failed, c).otherwise(other) if other is not None else F.when(~failed, c).otherwise(F.array()) for k, (c, other) in told.items()}
    return work.withColumns(columns).withColumn("error", F.col("__error")).drop("__v", "__error", "__nested", "__raw", "__cited", "__valid")
