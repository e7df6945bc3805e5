"""JSON that a model wrote: found, parsed and normalised, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NOT_STATED, begins_with, distinct_ignoring_case, flatten, once, squeeze, strip, strip_think

#: The fields of a summary record, and words that mean a value is missing.
META_FIELDS = ("title", "issuing_body", "country_or_region", "year", "document_type")
MISSING = ("none", "null", "n/a", "unknown")


def unfenced(x: Column) -> Column:
    """Without think tags and a code fence around the whole."""
    t = strip(strip_think(x))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)^```(?:json)?\s*", ""), r"(?U)\s*```\z", "")


def json_object_text(x: Column, profile: str = "a") -> Column:
    """The text of the JSON value in a reply, null where none parses. Profile a strips tags and fences first; both then try the whole and
    what lies between the first and the last brace; b takes objects only."""
    t = unfenced(x) if profile == "a" else F.coalesce(x, F.lit(""))
    valid = lambda x: once(x, lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"(?U)\S"), c))
    found = once(t, lambda c: F.coalesce(valid(c), valid(F.regexp_extract(c, r"(?s)\{.*\}", 0))))
    return once(found, lambda c: F.when(begins_with(c, "{"), c)) if profile == "b" else found


def parse_error(x: Column) -> Column:
    """Why a reply has no JSON; null where it has."""
    return F.when(strip(strip_think(x)) == "", "the reply is empty").when(json_object_text(x).isNull(), "the reply holds no valid JSON object")


def first_small_object(x: Column, fields: dict[str, str]) -> Column:
    """The first brace-to-brace stretch, its fields as text with defaults; null where there is none or it doesn't parse."""
    found = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?s)\{.*?\}", 0)
    ok = (found != "") & F.try_parse_json(found).isNotNull()
    return F.when(ok, F.struct(*[F.coalesce(F.get_json_object(found, f"$.{k}"), F.lit(d)).alias(k) for k, d in fields.items()]))


def is_object(json: Column) -> Column:
    return F.coalesce(begins_with(json, "{"), F.lit(False))


def _list_or_text(json: Column, key: str, glue: str) -> Column:
    joined = lambda raw: F.when(begins_with(raw, "["), F.array_join(F.from_json(raw, "array<string>"), glue)).otherwise(raw)
    return once(F.get_json_object(json, f"$.{key}"), joined)


def meta_field(json: Column, key: str, profile: str = "a") -> Column:
    """A field on one line; missing gives the sentinel, and in profile a so does a word that means missing."""
    absent = lambda value: value == "" if profile == "b" else (value == "") | F.lower(value).isin(*MISSING)
    return once(flatten(_list_or_text(json, key, ", ")), lambda value: F.when(absent(value), F.lit(NOT_STATED)).otherwise(value))


def raw_summary(json: Column) -> Column:
    return F.coalesce(strip(_list_or_text(json, "summary", " ")), F.lit(""))


def keyword_list(json: Column, profile: str = "a") -> Column:
    """All keywords, cleaned: from a list or from text split at commas and semicolons. Profile a strips full stops and drops repeats whatever
    their case; b only squeezes."""
    split = lambda raw: F.when(begins_with(raw, "["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, "[;,]"))
    items = F.coalesce(once(F.get_json_object(json, "$.keywords"), split), F.array().cast("array<string>"))
    if profile == "b":
        return F.filter(F.transform(items, lambda k: F.coalesce(squeeze(k), F.lit(""))), lambda k: k != "")
    clean = F.transform(items, lambda k: F.regexp_replace(flatten(k), r"^[ .]+|[ .]+$", ""))
    return distinct_ignoring_case(F.filter(clean, lambda k: k != ""))


def summary_record(json: Column, profile: str = "a") -> Column:
    """Struct of the fields, the summary on one line and at most five keywords; null for anything but an object."""

    def record(j: Column) -> Column:
        fields = [meta_field(j, k, profile).alias(k) for k in META_FIELDS]
        return F.when(is_object(j), F.struct(*fields, flatten(raw_summary(j)).alias("summary"), F.slice(keyword_list(j, profile), 1, 5).alias("keywords")))

    return once(json, record)
