"""Column expressions that find and strip unsafe markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as unsafe.
DANGEROUS_TAG = (r"(?iU)<\s*(script|iframe|object|embed|form|input|button|base|link|meta"
                 r"|applet|frame|frameset)\b")
EVENT_ATTRIBUTE = r"(?iU)\son[a-z]+\s*="
SCRIPT_URL = r"(?iU)(javascript|vbscript)\s*:"
CSS_IMPORT = r"(?i)@import[^;]+;?"
CSS_REMOTE_URL = r"(?iU)url\(\s*['\"]?\s*(?!data:)[a-z]*:?//[^)]*\)"
CSS_EXPRESSION = r"(?iU)expression\s*\("
DATA_HTML = r"(?i)data:text/html[^\"'\s>]*"
SCRIPT_BLOCK = r"(?isU)<\s*script\b.*?<\s*/\s*script\s*>"


def scrub_css(html: Column) -> Column:
    """Imports removed, remote references and expressions made inert."""
    out = F.regexp_replace(html, CSS_IMPORT, "")
    out = F.regexp_replace(out, CSS_REMOTE_URL, "none")
    return F.regexp_replace(out, CSS_EXPRESSION, "none(")


def html_findings(raw: Column, cleaned: Column | None = None) -> Column:
    """Sorted names of what the input holds. ``data_html_url`` is judged on the
    cleaned text where there is one. Each CSS rule sees the text as the rules
    before it left it."""
    no_import = F.regexp_replace(raw, CSS_IMPORT, "")
    no_remote = F.regexp_replace(no_import, CSS_REMOTE_URL, "none")
    seen = [
        ("css_expression", no_remote.rlike(CSS_EXPRESSION)),
        ("css_import", raw.rlike(CSS_IMPORT)),
        ("css_remote_url", no_import.rlike(CSS_REMOTE_URL)),
        ("dangerous_tag", raw.rlike(DANGEROUS_TAG)),
        ("data_html_url", F.contains(F.lower(raw if cleaned is None else cleaned),
                                     F.lit("data:text/html"))),
        ("event_handler_attribute", raw.rlike(EVENT_ATTRIBUTE)),
        ("javascript_url", raw.rlike(SCRIPT_URL)),
    ]
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in seen]))


def clean_markdown(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, SCRIPT_BLOCK, ""), SCRIPT_URL, "")


def markdown_findings(raw: Column) -> Column:
    no_blocks = F.regexp_replace(raw, SCRIPT_BLOCK, "")
    return F.array_compact(F.array(
        F.when(no_blocks.rlike(SCRIPT_URL), F.lit("javascript_url")),
        F.when(raw.rlike(SCRIPT_BLOCK), F.lit("script_block"))))


def report(sanitizer: str, raw: Column, cleaned: Column, findings: Column) -> Column:
    """Sizes are characters, under the names the stored report uses."""
    return F.struct(
        F.lit(sanitizer).alias("sanitizer"),
        (cleaned != raw).alias("modified"),
        findings.alias("findings"),
        F.length(raw).alias("original_bytes"),
        F.length(cleaned).alias("sanitized_bytes"))
