"""Text functions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Lower case; all but a-z and 0-9 becomes single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def csv_list(text: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def collapse(text: Column) -> Column:
    """White space of any kind (Unicode too) as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def collapse_lines(text: Column) -> Column:
    """Each line collapsed, empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: x != ""), "\n")


def excerpt(text: Column, n: int = 500) -> Column:
    return F.substring(collapse(text), 1, n)


def content_hash(text: Column) -> Column:
    """SHA-256 of the collapsed text."""
    return F.sha2(collapse(text), 256)


def line_hash(text: Column) -> Column:
    """SHA-256 of the text with its lines kept."""
    return F.sha2(collapse_lines(text), 256)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def header_stamp(title: Column, text: Column) -> Column:
    """'[title] text', unless there is no title or the text begins with it."""
    stamp = F.trim(F.coalesce(title, F.lit("")))
    return F.when((stamp == "") | F.startswith(F.ltrim(text), stamp), text).otherwise(F.concat(F.lit("["), stamp, F.lit("] "), text))


def chunk_id(source_id: Column, section: Column, index: Column, text_hash: Column) -> Column:
    """A name made of content: source, index, hash of the text, hash of all of them."""
    key = F.concat_ws("|", source_id, section, index.cast("string"), F.substring(text_hash, 1, 16))
    return F.concat_ws(":", source_id, F.lit("chunk"), index.cast("string"), F.substring(text_hash, 1, 12), F.substring(F.sha2(key, 256), 1, 8))


def section_ref(ref: Column) -> Column:
    """A section reference for comparing: without Sec., Section, §, closing points and case."""
    plain = F.regexp_replace(F.trim(ref), r"(?i)^(section|sec\.?|§+)\s*", "")
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"\.+$", ""))


def has(text: Column, *terms: str) -> Column:
    """True if any of the terms is in the text."""
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(text, F.lit(term))
    return out


def ladder(*steps: tuple[Column, str | None], default: str | None = None) -> Column:
    """The value of the first step whose condition holds."""
    out = F.when(steps[0][0], F.lit(steps[0][1]))
    for condition, value in steps[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def labels(*pairs: tuple[Column, str]) -> Column:
    """All labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(label)) for condition, label in pairs]))


def coerce(values: Column, allowed: tuple[str, ...], default: str = "unknown") -> Column:
    """Values outside the closed vocabulary become the default; each once, in order."""
    return F.array_distinct(F.transform(values, lambda x: F.when(x.isin(*allowed), x).otherwise(F.lit(default))))


def normal_code(code: Column) -> Column:
    """Letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(code, r"[^\p{L}\p{N}]", ""))


def stem_title(stem: Column) -> Column:
    return F.initcap(F.translate(stem, "-_", "  "))


# The words of the intake and triage rules.
FOOD = ("coffee", "cafe", "restaurant")
TRIGGERS = (
    ("change_of_use", ("convert", "change of use", "business")),
    ("parking", ("parking", "customer", "employees", "bakery", "coffee", "restaurant", "cafe")),
    ("health_department", ("food", "bakery", "coffee", "restaurant", "cafe")),
    ("building_permit", ("construction", "renovation", "build", "interior")),
    ("signage", ("sign", "signage")),
)


def inferred_use(text: Column) -> Column:
    t = F.lower(text)
    return ladder((has(t, "garage") & has(t, "bakery"), "home-based-food-business"), (has(t, "bakery"), "food-business"), (has(t, "restaurant", "cafe"), "food-service"), default="general")


def project_scope(text: Column) -> Column:
    t = F.lower(text)
    return ladder((has(t, "change of use", "convert", "conversion"), "change_of_use"), (has(t, "addition", "build", "construction"), "new_or_expanded_construction"), default="general_review")


def triggers(text: Column) -> Column:
    t = F.lower(text)
    return labels(*[(has(t, *terms), label) for label, terms in TRIGGERS])


def missing_fields(text: Column) -> Column:
    t = F.lower(text)
    return labels(
        (F.size(words(t)) < 8, "project scope and intended use"), (~has(t, "hours"), "operating hours"), (~has(t, "employees"), "number of employees"), (~has(t, "renovation", "construction"), "construction scope"),
    )


def question_key(question: Column) -> Column:
    """What a follow-up question is about; questions of one key ask the same."""
    plain = F.trim(F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "))
    t = F.split(plain, " ")
    any_of = lambda *xs: F.arrays_overlap(t, F.array(*map(F.lit, xs)))
    both = lambda a, b: F.array_contains(t, a) & F.array_contains(t, b)
    key = ladder(
        (any_of("hours"), "operating hours"), (any_of("employee", "employees", "workers"), "number of employees"),
        (any_of("construction", "renovation", "renovations") & any_of("scope", "planned", "modifications"), "construction scope"),
        (any_of("noise") | both("surrounding", "residential"), "noise and neighborhood impact"), (any_of("parking"), "parking"), (both("lot", "size"), "lot size"),
    )
    return F.coalesce(key, plain)


def filter_csv(values: Column) -> Column:
    """A list as `,a,b,`, so that each value can be looked for between commas; an empty text for an empty or null list."""
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, F.concat(F.lit(","), F.array_join(values, ","), F.lit(","))).otherwise("")
