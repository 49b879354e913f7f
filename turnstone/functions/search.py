"""Column expressions around a search: date bounds, filters, links, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import text as tx

# Accepted shapes of a date bound.
PARTIAL_DATE = r"\A(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?\z"


def date_bound(value: Column, is_end: bool | Column) -> Column:
    """Struct ``(bound DATE, rejected BOOLEAN)``. A year or month stands for its
    first day, or its last when it closes a range. Blank means no bound;
    anything else that is no real date is rejected."""
    end = is_end if isinstance(is_end, Column) else F.lit(is_end)
    raw = tx.strip(value)
    blank = value.isNull() | (value == "")
    shaped = raw.rlike(PARTIAL_DATE)
    year, month, day = (
        F.when(shaped, F.nullif(F.regexp_extract(raw, PARTIAL_DATE, i), F.lit(""))).cast("int")
        for i in (1, 2, 3)
    )
    month_or = F.coalesce(month, F.when(end, F.lit(12)).otherwise(F.lit(1)))
    anchor = _real_date(year, month_or, F.coalesce(day, F.lit(1)))
    bound = F.when(day.isNull() & end, F.last_day(anchor)).otherwise(anchor)
    bound = F.when(blank, F.lit(None).cast("date")).otherwise(bound)
    return F.struct(bound.alias("bound"), (~blank & bound.isNull()).alias("rejected"))


def _real_date(y: Column, m: Column, d: Column) -> Column:
    # Parsing instead of make_date: an impossible date is null, ANSI mode or not.
    real = (y >= 1) & m.between(1, 12) & d.between(1, 31)
    return F.when(real, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d)))


def filter_text(guest: Column, since: Column, until: Column) -> Column:
    """``guest, A to B`` / ``since A`` / ``until B``; empty when unfiltered."""
    a, b = since.cast("string"), until.cast("string")
    span = (
        F.when(since.isNotNull() & until.isNotNull(), F.concat(a, F.lit(" to "), b))
        .when(since.isNotNull(), F.concat(F.lit("since "), a))
        .when(until.isNotNull(), F.concat(F.lit("until "), b))
    )
    return F.concat_ws(", ", F.nullif(guest, F.lit("")), span)


def passes_filter(ep_guest: Column, ep_date: Column, guest: Column, since: Column,
                  until: Column) -> Column:
    """Guest by case-insensitive substring (no wildcards), date inside the
    inclusive range; an undated episode never satisfies a date bound."""
    by_guest = guest.isNull() | F.contains(F.lower(ep_guest), F.lower(guest))
    by_since = since.isNull() | (ep_date >= since)
    by_until = until.isNull() | (ep_date <= until)
    return F.coalesce(by_guest & by_since & by_until, F.lit(False))


def date_phrases(question: Column) -> Column:
    """Struct ``(since, until)`` read from "since/after/until/before YYYY"."""
    lower, upper = r"(?i)\b(since|after)\s+(\d{4})\b", r"(?i)\b(until|before)\s+(\d{4})\b"

    def year(pattern: str, exclusive: str, step: int) -> Column:
        found = F.nullif(F.regexp_extract(question, pattern, 2), F.lit("")).cast("int")
        word = F.lower(F.regexp_extract(question, pattern, 1))
        return (found + F.when(word == exclusive, step).otherwise(0)).cast("string")

    return F.struct(year(lower, "after", 1).alias("since"),
                    year(upper, "before", -1).alias("until"))


def deep_link(url: Column, start_seconds: Column) -> Column:
    joiner = F.when(F.contains(url, F.lit("?")), F.lit("&t=")).otherwise(F.lit("?t="))
    return (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit(""))
        .when(start_seconds.isNull(), url)
        .otherwise(F.concat(url, joiner, start_seconds.cast("string")))
    )


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p)


def cosine(a: Column, b: Column) -> Column:
    """For row-wise use; ranking a query table goes through the block kernel."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
