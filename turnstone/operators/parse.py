"""Speaker turns from transcript bodies.

A transcript is one row, and everything here stays inside that row: lines,
headers and turns are array columns, so parsing shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import text as tx
from turnstone.settings import DEFAULTS, Settings

# The three header layouts, tried in this order for a whole file.
_TIME = r"(?:\d{1,2}:)?\d{1,3}:\d{2}"
_NAME = r"[A-Z][\w'.-]*(?: [A-Z][\w'.-]*){0,4}"
UNKNOWN_SPEAKER = "Unknown speaker"


@dataclass(frozen=True)
class Layout:
    """A header pattern and the groups holding speaker, time and inline text."""

    name: str
    pattern: str
    speaker: int
    time: int | None = None
    text: int | None = None


LAYOUTS = (
    Layout("header", rf"(?U)\A([^\n(]{{0,120}}?)\s*\(({_TIME})\):\s*\z", 1, 2),
    Layout("inline", rf"(?U)\A\[({_TIME})\]\s*(?:({_NAME}):\s*)?(.*)\z", 2, 1, 3),
    Layout("untimed", rf"(?U)\A({_NAME}):\s*\z", 1),
)


def _computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row. A plain projection would be
    inlined wherever it is used, lambdas and pushed-down filters included, which
    repeats the work per array element; a generator of one row is not."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def _group(head: Column, layout: Layout, group: int | None) -> Column:
    if group is None:
        return F.lit(None).cast("string")
    return F.nullif(tx.strip(F.regexp_extract(head, layout.pattern, group)), F.lit(""))


def _with_layout(df: DataFrame, lines: str, layout: Layout, wanted: Column) -> DataFrame:
    """Add ``_turns_<layout>``: the turns this layout finds where ``wanted``."""

    def marked(line, i):
        head = F.when(tx.strip(line).rlike(layout.pattern), tx.strip(line))
        return F.struct(i.alias("i"), line.alias("line"), head.alias("head"))

    def header(m):
        return F.struct(m["i"].alias("i"), _group(m["head"], layout, layout.speaker).alias("speaker"),
                        _group(m["head"], layout, layout.time).alias("time"))

    m, w, turns = f"_lines_{layout.name}", f"_work_{layout.name}", f"_turns_{layout.name}"
    df = _computed(df, m, F.when(wanted, F.transform(lines, marked)))
    heads = F.transform(F.filter(m, lambda x: x["head"].isNotNull()), header)
    # A header without a speaker continues the turn that is open; the first
    # header of the file has none to continue.
    openers = F.filter(heads, lambda h, k: h["speaker"].isNotNull() | (k == 0))
    body = F.transform(m, lambda x: F.when(x["head"].isNull(), x["line"]).otherwise(
        _group(x["head"], layout, layout.text)))
    df = _computed(df, w, F.struct(openers.alias("openers"), body.alias("body"),
                                   F.size(m).alias("n")))

    def turn(o, k):
        upto = F.coalesce(F.get(F.col(f"{w}.openers"), k + 1)["i"], F.col(f"{w}.n"))
        text = F.array_join(F.slice(F.col(f"{w}.body"), o["i"] + 1, upto - o["i"]), "\n")
        return F.struct(
            F.coalesce(o["speaker"], F.lit(UNKNOWN_SPEAKER)).alias("speaker"),
            F.when(o["time"].isNotNull(), tx.clock_to_seconds(o["time"])).alias("start_seconds"),
            tx.strip(text).alias("text"))

    found = F.filter(F.transform(f"{w}.openers", turn), lambda t: t["text"] != "")
    return _computed(df, turns, found).drop(m, w)


def parse_turns(df: DataFrame, body: str = "body", settings: Settings = DEFAULTS) -> DataFrame:
    """``df`` plus ``turns``: array of (speaker, start_seconds, text, is_sponsor).
    The first layout that yields a turn holds for the whole file; a body in no
    known layout gets an empty array."""
    keep = df.columns
    out = _computed(df, "_lines", tx.lines(F.col(body)))
    missing = F.lit(True)
    found = []
    for layout in LAYOUTS:
        out = _with_layout(out, "_lines", layout, missing)
        turns = F.col(f"_turns_{layout.name}")
        found.append(F.when(F.size(turns) > 0, turns))
        missing = missing & ~F.coalesce(F.size(turns) > 0, F.lit(False))
    out = _computed(out, "_turns", F.coalesce(*found, F.array().cast(
        "array<struct<speaker:string,start_seconds:int,text:string>>")))
    return flag_ads(out.select(*keep, "_turns"), "_turns", settings).drop("_turns")


def flag_ads(df: DataFrame, turns: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``turns`` with ``is_sponsor``.

    An opening phrase starts an advertisement; later turns of the same speaker
    stay in it while they hold a following phrase. Each turn becomes one letter
    (o/f/x, upper case where the speaker changes) and one regular expression
    over that word finds every follower that hangs on an opener.
    """

    def letter(t, i):
        low = F.lower(t["text"])
        kind = (F.when(tx.contains_any(low, settings.ad_openers), F.lit("o"))
                .when(tx.contains_any(low, settings.ad_followers), F.lit("f"))
                .otherwise(F.lit("x")))
        same = t["speaker"] == F.get(F.col(turns), i - 1)["speaker"]
        return F.when(F.coalesce((i > 0) & same, F.lit(False)), kind).otherwise(F.upper(kind))

    word = F.array_join(F.transform(turns, letter), "")
    hanging = F.regexp_replace(word, r"(?:(?<=[oO])|\G(?!\A))f", "s")
    flagged = F.zip_with(turns, F.split(hanging, ""), lambda t, mark: F.struct(
        t["speaker"].alias("speaker"), t["start_seconds"].alias("start_seconds"),
        t["text"].alias("text"), mark.isin("o", "O", "s").alias("is_sponsor")))
    return _computed(df, "turns", F.slice(flagged, 1, F.size(turns)))


def explode_turns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("turns").alias("turn_no", "t")).select(
        *keys, "turn_no", "t.*")
