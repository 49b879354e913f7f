"""Predicates deciding which records and artifacts may be stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import text as tx

# Size limits of stored records.
MAX_ARTIFACT_BYTES = 200_000
TITLE_CHARS = 300
FIELD_LIMITS = {"message": (1, 8000), "query": (1, 1000), "guest": (0, 200), "title": (0, 200)}
TOP_K_RANGE = (1, 25)
PAGE_LIMITS = {"sessions": (1, 200), "artifacts": (1, 200), "trace": (1, 1000)}


def artifact_kind(kind: Column) -> Column:
    return F.lower(tx.strip(F.coalesce(F.nullif(kind, F.lit("")), F.lit("markdown"))))


def artifact_title(title: Column) -> Column:
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))
    return F.substring(tx.strip(named), 1, TITLE_CHARS)


def artifact_reject(kind: Column, content: Column) -> Column:
    """Null when the artifact may be stored, else the first reason it may not."""
    return (
        F.when(~artifact_kind(kind).isin("markdown", "html"), F.lit("kind"))
        .when(tx.strip(F.coalesce(content, F.lit(""))) == "", F.lit("empty"))
        .when(F.octet_length(content) > MAX_ARTIFACT_BYTES, F.lit("too_large"))
    )


def has_nul(value: Column) -> Column:
    return F.contains(value, F.lit("\x00"))


def json_has_nul(json: Column) -> Column:
    """On serialised JSON a NUL is an escape; an escaped backslash before
    ``u0000`` is plain text."""
    return F.coalesce(json.rlike(r"(?<!\\)(\\\\)*\\u0000"), F.lit(False)) | has_nul(json)


def field_reject(field: str, value: Column) -> Column:
    low, high = FIELD_LIMITS[field]
    length = F.length(value)
    rule = F.when(has_nul(value), F.lit("nul")).when(length > high, F.lit("too_long"))
    if low:
        rule = rule.when(value.isNull() | (length < low), F.lit("too_short"))
    if field == "message":
        rule = rule.when(tx.strip(value) == "", F.lit("blank"))
    return rule


def range_reject(since: Column, until: Column) -> Column:
    return F.when(since > until, F.lit("reversed_range"))


def number_reject(value: Column, bounds: tuple[int, int]) -> Column:
    return F.when(~value.between(*bounds), F.lit("out_of_range"))
