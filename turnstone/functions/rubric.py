"""The mechanically checkable essay rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import text as tx

# The limits of the rubric and the names of its checks.
MIN_WORDS, MAX_WORDS = 1050, 1450
HOOK_WORDS, MAX_BOLD, MIN_CITED = 25, 12, 3
CHECKS = (
    "word_count_in_range", "has_headline", "hook_is_short", "section_count_3_to_5", "has_list",
    "bold_not_excessive", "has_three_citations", "citations_in_range",
    "no_literal_placeholder_citations",
)


def measures(essay: Column, evidence: Column) -> Column:
    """Struct of the counts the checks are made of."""
    cited = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(essay, F.lit(r"\[(\d{1,2})\]"), F.lit(1)),
        lambda n: n.cast("int"))))
    # Only the first heading line goes; the rest of the text is untouched.
    body = tx.strip(F.regexp_replace(essay, r"(?msd)\A(.*?)^#[^\n]*", "$1"))
    hook = F.split(body, r"(?U)(?<=[.!?])\s", 2)[0]
    return F.struct(
        tx.word_count(essay).alias("word_count"),
        F.regexp_count(essay, F.lit(r"(?mdU)^##\s+(.+)$")).alias("section_count"),
        F.size(cited).alias("citation_count"),
        F.regexp_count(essay, F.lit(r"\*\*[^*]+\*\*")).alias("bold_count"),
        F.filter(cited, lambda n: (n < 1) | (n > evidence)).alias("invalid_citations"),
        F.when(body == "", F.lit(0)).otherwise(tx.word_count(hook)).alias("hook_words"),
        essay.rlike(r"(?mdU)^#\s+(.+)$").alias("headline"),
        essay.rlike(r"(?mdU)^\s*([-*]|\d+\.)\s+").alias("list"),
        essay.rlike(r"(?i)\[n\]").alias("placeholder"))


def checks(m: Column) -> Column:
    """Struct of booleans from a ``measures`` struct."""
    made = (
        m["word_count"].between(MIN_WORDS, MAX_WORDS),
        m["headline"],
        m["hook_words"].between(1, HOOK_WORDS),
        m["section_count"].between(3, 5),
        m["list"],
        m["bold_count"] <= MAX_BOLD,
        m["citation_count"] >= MIN_CITED,
        F.size(m["invalid_citations"]) == 0,
        ~m["placeholder"],
    )
    return F.struct(*[c.alias(name) for name, c in zip(CHECKS, made, strict=True)])


def n_passed(c: Column) -> Column:
    total = F.lit(0)
    for name in CHECKS:
        total = total + c[name].cast("int")
    return total


def fixes(m: Column, c: Column) -> Column:
    """One instruction per failed check, worst first."""
    said = F.format_string
    short = m["word_count"] < MIN_WORDS
    todo = [
        F.when(~c["word_count_in_range"] & short,
               said(f"Grow the text from %d to {MIN_WORDS}-{MAX_WORDS} words with evidence, "
                    "keeping its sections.", m["word_count"])),
        F.when(~c["word_count_in_range"] & ~short,
               said(f"Shorten the text from %d to at most {MAX_WORDS} words.", m["word_count"])),
        F.when(~c["section_count_3_to_5"],
               said("Use 3 to 5 second-level headings, not %d.", m["section_count"])),
        F.when(~c["no_literal_placeholder_citations"],
               F.lit("Put a real evidence number wherever a literal [n] stands.")),
        F.when(~c["has_three_citations"],
               said(f"Cite at least {MIN_CITED} different excerpts; now %d.",
                    m["citation_count"])),
        F.when(~c["citations_in_range"],
               said("Drop or correct citations that match no evidence: %s.",
                    F.array_join(m["invalid_citations"], ", "))),
        F.when(~c["has_list"], F.lit("Include a bulleted or numbered list.")),
        F.when(~c["bold_not_excessive"],
               said(f"Use bold at most {MAX_BOLD} times, not %d.", m["bold_count"])),
        F.when(~c["hook_is_short"], F.lit("Open with one short, concrete sentence.")),
        F.when(~c["has_headline"], F.lit("Start with a first-level heading.")),
    ]
    return F.array_compact(F.array(*todo))


def markdown_title(text: Column, fallback: Column) -> Column:
    """First ``# `` line, else the fallback; at most 300 characters."""
    line = F.get(F.filter(tx.lines(text), lambda ln: ln.startswith("# ")), F.lit(0))
    return F.substring(F.when(line.isNotNull(), tx.strip(F.substring(line, 3, 1 << 30)))
                       .otherwise(fallback), 1, 300)
