"""Column expressions for text: whitespace, words, terms, sentences, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode defines it plus the four ASCII separators; Java's \s
# alone is ASCII.
SPACE = r"[\s\x1c-\x1f\x85]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# The PostgreSQL "english" stop-word list.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now",
]


def strip(c: Column) -> Column:
    """Both ends, any Unicode white space."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)[^\s\x1c-\x1f\x85]+"))


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def first_word(c: Column) -> Column:
    """Null where there is none; the text behind it is not read."""
    return F.nullif(F.regexp_extract(c, rf"(?U)\A{SPACE}*([^\s\x1c-\x1f\x85]+)", 1), F.lit(""))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def token_estimate(c: Column) -> Column:
    """About 1.3 tokens per word, never below one."""
    return F.greatest(F.lit(1), F.floor(word_count(c) * F.lit(1.3)).cast("int"))


def sentences(c: Column) -> Column:
    return F.split(c, rf"(?U)(?<=[.!?]){SPACE}+")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def terms(c: Column) -> Column:
    """Lower-cased tokens without stop words, in text order, repeats kept."""
    return F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS))


def content_hash(raw: Column) -> Column:
    return F.sha2(newlines_unified(raw), 256)


def newlines_unified(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\r\n?", "\n")


def contains_any(c: Column, phrases) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(c, F.lit(phrase))
    return hit


def clock_to_seconds(ts: Column) -> Column:
    """``H:MM:SS`` or ``MM:SS`` folded in base 60."""
    return F.aggregate(F.split(ts, ":"), F.lit(0), lambda acc, part: acc * 60 + part.try_cast("int"))


def clock_label(seconds: Column) -> Column:
    """``h:mm:ss`` from one hour on, ``m:ss`` below, empty when unknown."""
    whole = seconds.cast("long")
    hours = F.floor(whole / 3600)
    minutes = F.floor(whole % 3600 / 60)
    return (
        F.when(seconds.isNull(), F.lit(""))
        .when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, whole % 60))
        .otherwise(F.format_string("%d:%02d", minutes, whole % 60))
    )
