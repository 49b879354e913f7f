"""Column expressions over reply text: citation marks, message predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import text as tx

# Shape of a citation mark, and the widest range taken as one.
MARK = r"\[(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)\]"
WIDEST_RANGE = 50

# Openers that need no retrieval, alone or before more words.
OPENERS = (
    "hi", "hey", "hello", "thanks", "thank you", "ok", "okay", "cool",
    "who are you", "what can you do", "help", "what is this",
)
# Small talk, only as the whole message.
SMALL_TALK = (
    "whats up", "what's up", "sup", "wassup", "yo",
    "how are you", "how r u", "how are you doing", "how you doing",
    "hows it going", "how's it going", "how is it going",
    "what you doin", "what you doing", "what are you doing", "wyd",
    "good morning", "good afternoon", "good evening", "good night",
    "nothing much", "not much", "nvm", "nevermind", "never mind",
    "lol", "haha", "nice", "great", "awesome", "got it", "sounds good",
    "bye", "goodbye", "see ya", "see you", "later",
)
# Phrases that ask for a rendered document.
DOCUMENT_PHRASES = (
    "checklist", "one-pager", "one pager", "template", "document", "report",
    "audit", "cheat sheet", "worksheet", "framework doc", "rendered",
    "html page", "web page", "landing page",
)
# Wordings that mark a refusal.
REFUSALS = (
    "doesn't cover", "does not cover", "don't cover", "do not cover",
    "not covered", "don't have", "doesn't have", "do not have", "does not have",
    "no information", "not something", "outside the scope",
    "not covered in", "not something i can",
)


def cited_numbers(text: Column) -> Column:
    """Sorted distinct numbers cited as ``[n]``, ``[n, m]`` or ``[n-m]``. A
    range that runs backwards or spans more than fifty cites nothing."""
    none = F.array().cast("array<int>")

    def span(part: Column) -> Column:
        ends = F.split(F.trim(part), r"\s*[–-]\s*")
        low, high = ends[0].try_cast("int"), F.element_at(ends, -1).try_cast("int")
        return F.when((high >= low) & (high - low <= WIDEST_RANGE),
                      F.sequence(low, high)).otherwise(none)

    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(1))
    numbers = F.flatten(F.transform(
        marks, lambda m: F.flatten(F.transform(F.split(m, ","), span))))
    return F.array_sort(F.array_distinct(numbers))


def is_trivial(message: Column) -> Column:
    m = F.regexp_replace(F.lower(tx.strip(message)), r"[?!.]+\z", "")
    opener = F.lit(False)
    for phrase in OPENERS:
        opener = opener | m.startswith(phrase + " ")
    return (F.length(m) <= 3) | m.isin(*SMALL_TALK) | m.isin(*OPENERS) | opener


def asks_for_document(message: Column) -> Column:
    return tx.contains_any(F.lower(message), DOCUMENT_PHRASES)


def reads_as_refusal(reply: Column) -> Column:
    return tx.contains_any(F.lower(reply), REFUSALS)


def session_title(first_message: Column, limit: int) -> Column:
    flat = F.replace(tx.strip(first_message), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > limit,
                  F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


# A fenced object, or a bare one with a "name" and no nesting.
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```|(\{[^{}]*\"name\"[^{}]*\})"


def tool_call_in_text(content: Column, known_tools) -> Column:
    """First JSON object in ``content`` naming a known tool, as
    ``struct(tool, args)`` with the arguments as JSON text; null if none."""
    blobs = F.regexp_extract_all(content, F.lit(FENCED_OBJECT), F.lit(0))

    def read(blob: Column) -> Column:
        body = F.regexp_extract(blob, r"(?s)(\{.*\})", 1)
        name = _first_text(body, "name", "tool", "function")
        args = _first_text(body, "arguments", "parameters")
        # Arguments given as a JSON string come back unescaped, so one check
        # serves both forms; anything that is no object counts as none.
        is_object = F.try_parse_json(args).isNotNull() & args.rlike(r"(?s)\A\s*\{")
        return F.struct(
            F.when(F.try_parse_json(body).isNotNull(), name).alias("tool"),
            F.when(is_object, args).otherwise(F.lit("{}")).alias("args"))

    calls = F.filter(F.transform(blobs, read), lambda c: c["tool"].isin(list(known_tools)))
    return F.get(calls, F.lit(0))


def _first_text(json: Column, *fields: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{f}"), F.lit("")) for f in fields])
