"""HTML rewritten against an allow-list.

Parsing markup is the one sanitising step columns cannot express; findings, CSS
scrubbing and reports stay column expressions around it.
"""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import markup

# What may stay.
TAGS = {
    "a", "abbr", "article", "aside", "b", "blockquote", "br", "caption", "cite", "code", "col",
    "colgroup", "dd", "del", "details", "div", "dl", "dt", "em", "figcaption", "figure",
    "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "i", "img", "ins", "kbd",
    "li", "main", "mark", "nav", "ol", "p", "pre", "q", "s", "samp", "section", "small", "span",
    "strong", "sub", "summary", "sup", "style", "table", "tbody", "td", "tfoot", "th", "thead",
    "time", "tr", "u", "ul", "var", "wbr",
}
COMMON = {"class", "id", "style", "title", "lang", "dir", "role", "aria-label"}
OWN = {
    "a": {"href", "target"}, "img": {"src", "alt", "width", "height", "loading"},
    "td": {"colspan", "rowspan", "align"}, "th": {"colspan", "rowspan", "align", "scope"},
    "col": {"span", "width"}, "colgroup": {"span"}, "time": {"datetime"}, "details": {"open"},
}
SCHEMES = frozenset({"", "http", "https", "mailto", "data"})
LINKS = frozenset({"href", "src"})
# Dropped with everything inside them.
DROPPED = frozenset({"script", "iframe", "object", "embed", "form"})
VOID = {"br", "col", "hr", "img", "wbr", "embed", "input"}
LINK_REL = "noopener noreferrer nofollow"


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.skipping: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.skipping or tag in DROPPED:
            if tag in DROPPED and tag not in VOID:
                self.skipping.append(tag)
            return
        if tag not in TAGS:
            return
        kept = [(n, v) for n, v in dict(reversed(attrs)).items() if _allowed(tag, n, v)][::-1]
        if tag == "a":
            kept.append(("rel", LINK_REL))
        text = "".join(f' {n}="{escape(v or "")}"' for n, v in kept)
        self.out.append(f"<{tag}{text}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.skipping:
            raw = bool(self.open) and self.open[-1] == "style"
            self.out.append(data.replace("<", "") if raw else escape(data, quote=False))

    def text(self) -> str:
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def _allowed(tag: str, name: str, value: str | None) -> bool:
    if name not in COMMON and name not in OWN.get(tag, ()):
        return False
    if name not in LINKS:
        return True
    squeezed = "".join(ch for ch in value or "" if ch > " " and ch != "\x7f")
    try:
        return urlsplit(squeezed).scheme.lower() in SCHEMES
    except ValueError:
        return False


def clean_one(html: str) -> str:
    cleaner = _Cleaner()
    cleaner.feed(html)
    cleaner.close()
    return cleaner.text()


@F.pandas_udf(T.StringType())
def _clean(html: pd.Series) -> pd.Series:
    return html.map(clean_one, na_action="ignore")


def clean_html(raw: Column) -> Column:
    return F.regexp_replace(_clean(markup.scrub_css(raw)), markup.DATA_HTML, "")


def sanitize(artifacts: DataFrame) -> DataFrame:
    """``content`` made safe by kind, with ``sanitizer_report``."""
    is_html = F.coalesce(F.lower("kind") == "html", F.lit(False))
    html = artifacts.where(is_html).withColumn("_clean", _clean(markup.scrub_css(F.col("content"))))
    html = html.withColumn("_out", F.regexp_replace("_clean", markup.DATA_HTML, "")).withColumn(
        "sanitizer_report", markup.report(
            "allow-list", F.col("content"), F.col("_out"),
            markup.html_findings(F.col("content"), F.col("_clean"))))
    text = artifacts.where(~is_html).withColumn(
        "_out", markup.clean_markdown(F.col("content"))).withColumn(
        "sanitizer_report", markup.report("markdown-strip", F.col("content"), F.col("_out"),
                                          markup.markdown_findings(F.col("content"))))
    both = html.drop("_clean").unionByName(text)
    return both.withColumn("content", F.col("_out")).drop("_out")
