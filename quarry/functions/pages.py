"""What titles, names and logs of scraped codes hold, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ladder, slugify

# How hosts write the number of a section at the beginning of its title. Group 1 is the number.
GRAMMARS = {
    "municode": r"(?i)^\s*(Sec\.?\s*[0-9][0-9A-Za-z.\-]*|§\s*[0-9][0-9A-Za-z.\-]*|[A-Z]{1,2}-[0-9]{2,}[0-9A-Za-z.\-]*|[0-9]+[.\-][0-9A-Za-z][0-9A-Za-z.\-]*)",
    "amlegal": r"^\s*([0-9][0-9A-Za-z]*(?:[.\-][0-9A-Za-z]+)+)",
    "ecode360": r"(?i)^\s*(?:SECTION\s+)?(§\s*[\d][\w.\-]*|[\d][\w.\-]*)",
    "encodeplus": r"(?i)^\s*((?:appendix|article|chapter)\s+[0-9a-z]+|[0-9]+(?:\.[0-9]+)*)",
    "madcapflare": r"^\s*(\d+(?:\.\d+)*)\.?\s+\S",
    "municipalcodeonline": r"(?i)^\s*(Secs?\.?\s*[0-9][0-9A-Za-z.\-]*)",
    "generic_html": r"(?i)^\s*(Sec\.?\s*[0-9][0-9A-Za-z.\-]*|Article\s+[IVXLC0-9]+|Chapter\s+[0-9A-Za-z.\-]+)",
}
FAILURES = ("failed", "BLOCKED", "no sections", "ERROR")


def section_number(title: Column, host: str) -> Column:
    """A title's section number as a host writes it, with single spaces; null without one. "Sec" gets its point; where a title of encodeplus has
    no number, the part before its first colon stands for one."""
    t = F.coalesce(title, F.lit(""))
    found = F.trim(F.regexp_replace(F.regexp_extract(t, GRAMMARS[host], 1), r"\s+", " "))
    if host == "municode":
        found = F.regexp_replace(F.regexp_replace(found, r"[.\- ]+$", ""), r"(?i)^(Sec)(?!\.)", "$1.")
    if host == "municipalcodeonline":
        found = F.regexp_replace(found, r"(?i)^(Secs?)(?![s.])", "$1.")
    if host == "encodeplus":
        found = F.coalesce(F.nullif(found, F.lit("")), F.trim(F.substring_index(t, ":", 1)))
    return F.nullif(found, F.lit(""))


def outline_number(article: Column, letter: Column) -> Column:
    """A lettered section's number within its article: 7 and B give 7.B."""
    return F.concat_ws(".", article, letter)


def camel_title(segment: Column) -> Column:
    """A title from a URL's part in camel case, with hyphens and underscores as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(segment, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "), "[_-]+", " "))


def page_count(html: Column) -> Column:
    """The number in the link to the last page, else the largest number of 2 to 4 digits among the page links, else 0."""
    last = F.regexp_extract(html, r"(?i)rel=[\"']last[\"'][^>]*href=[\"'][^\"']*?(\d+)/[\"']", 1)
    links = F.regexp_extract(html, r"(?is)class=[\"']nav-links[\"'][^>]*>(.*?)</div>", 1)
    numbers = F.transform(F.regexp_extract_all(links, F.lit(r"\b(\d{2,4})\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.nullif(last, F.lit("")).cast("int"), F.array_max(numbers), F.lit(0))


def without_state(name: Column) -> Column:
    """A name without its last ', STATE'."""
    return F.regexp_replace(name, r", (?:(?!, ).)*$", "")


def county_names(kind: Column, name: Column, county: Column) -> Column:
    """The counties of a place: an independent city's two names, else the stated county, else a county's own name."""
    plain = without_state(F.coalesce(name, F.lit("")))
    stated = F.nullif(county, F.lit(""))
    one = F.array_compact(F.array(F.when(kind == "county", F.coalesce(stated, F.nullif(plain, F.lit("")))).otherwise(stated)))
    return F.when(kind == "independent_city", F.array(F.concat(plain, F.lit(" City")), F.concat(F.lit("City of "), plain))).otherwise(one)


def match_strategy(kind: Column) -> Column:
    return ladder((kind == "county", "county"), (kind == "independent_city", "locality_and_county"), default="locality")


def clean_fips(code: Column) -> Column:
    """A code of 1 to 10 digits, trimmed; null for anything else."""
    return F.when(F.trim(code).rlike("^[0-9]{1,10}$"), F.trim(code))


def failure_reason(log: Column, fallback: str) -> Column:
    """The last line of a log that tells of a failure, else its last line, else the fallback."""
    lines = F.filter(F.transform(F.split(F.coalesce(log, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    told = F.filter(lines, lambda x: x.rlike("|".join(FAILURES)))
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    return F.coalesce(last(told), last(lines), F.lit(fallback))


def crumb(breadcrumb: Column, i: int) -> Column:
    """The i-th item of a breadcrumb, '' beyond its end."""
    return F.coalesce(F.get(breadcrumb, F.lit(i)), F.lit(""))


def string_list(values: Column) -> Column:
    """Items trimmed, empty ones dropped; none for null."""
    return F.coalesce(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def string_map(values: Column) -> Column:
    """Entries whose value isn't blank; none for null."""
    return F.coalesce(F.map_filter(values, lambda _, v: F.trim(v) != ""), F.create_map().cast("map<string,string>"))


def payload(text: Column) -> Column:
    """A stored payload as a map; none where it isn't a JSON object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def not_after(date: Column, limit: Column) -> Column:
    """Whether an ISO date is at or before a limit, as text; blank dates and limits pass."""
    return (F.coalesce(limit, F.lit("")) == "") | (F.coalesce(date, F.lit("")) == "") | (date <= limit)


def request_key(district: Column, use: Column, jurisdiction: Column, query: Column, version: Column) -> Column:
    """SHA-256 of a request's JSON with its keys in order: the name of its result in a store."""
    named = {"district": district, "inferred_use": use, "jurisdiction_id": jurisdiction, "query": query, "source_index_version": version}
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(named.items())]), {"ignoreNullFields": "false"}), 256)


def point_id(name: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version-5 UUID of a name: SHA-1 of the namespace's bytes and the name's, with the version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def source_record(heading: Column, ref: Column, text: Column, date: Column, fallback_date: Column, date_source: str = "unknown", most: int = 20_000) -> Column:
    """A scraped section as a source: title, excerpt, full_text, section_ref, effective_date, where the date comes from, default tags."""
    from .text import collapse_lines, excerpt

    own = F.nullif(date, F.lit(""))
    return F.struct(
        F.coalesce(F.nullif(F.trim(heading), F.lit("")), ref).alias("title"), excerpt(text).alias("excerpt"), F.substring(collapse_lines(text), 1, most).alias("full_text"), F.trim(ref).alias("section_ref"),
        F.coalesce(own, fallback_date).alias("effective_date"), F.when(own.isNull(), F.lit(date_source)).alias("date_source"), F.array(F.lit("unknown")).alias("districts"), F.array(F.lit("general")).alias("uses"),
    )


def code_url(base: Column, city: Column, node: Column) -> Column:
    """A deep link of a code: the host, the city's slug, the node."""
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), slugify(city), node)
