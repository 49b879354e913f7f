"""English stems by the published suffix rules of Porter (1980), as SQL expressions.

A rule looks at the longest suffix of its step that the word ends in; only if what is left
before the suffix meets the rule's condition is the suffix replaced. Conditions are about
the measure m, the number of vowel-consonant sequences, and are regular expressions here.
The expressions use what Spark and other SQL engines share, so one rule table serves both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A leading y is a consonant, a y after a vowel too; any other y is a vowel.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
M1 = f"^({_C})?{_V}{_C}"            # m > 0
M_IS_1 = f"^({_C})?{_V}{_C}({_V})?$"  # m = 1
M2 = f"^({_C})?{_V}{_C}{_V}{_C}"    # m > 1
VOWEL = f"^({_C})?[aeiouy]"         # holds a vowel
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # ends consonant, vowel, consonant, with m = 1
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# The published rules, suffix and what replaces it, step by step.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


class Dialect:
    """How an engine writes the two tests that differ."""

    def __init__(self, ends: str, match: str):
        self.ends_name, self.match_name = ends, match

    def ends(self, suffix: str, word: str = "w") -> str:
        return f"{self.ends_name}({word}, '{suffix}')"

    def match(self, text: str, pattern: str) -> str:
        return f"{self.match_name}({text}, '{pattern}')"


SPARK, DUCK = Dialect("endswith", "regexp_like"), Dialect("ends_with", "regexp_matches")


def _before(suffix: str | int) -> str:
    n = suffix if isinstance(suffix, int) else len(suffix)
    return f"left(w, length(w) - {n})"


def _longest_first(rules):
    return sorted(rules, key=lambda r: -len(r[0]))


def _replaced(d: Dialect, rules, condition: str) -> str:
    """One step: the longest suffix decides, whether or not its condition holds."""
    when = [f"WHEN {d.ends(old)} THEN CASE WHEN {d.match(_before(old), condition)} THEN concat({_before(old)}, '{new}') ELSE w END"
            for old, new in _longest_first(rules)]
    return f"CASE {' '.join(when)} ELSE w END"


def steps(d: Dialect) -> list[str]:
    """Expressions over a column ``w``, each to be applied to the result of the one before.
    Words of one or two letters are never changed: no step touches them."""
    has_vowel = lambda suffix: f"{d.ends(suffix)} AND {d.match(_before(suffix), VOWEL)}"
    cut = f"CASE WHEN {has_vowel('ed')} THEN {_before('ed')} ELSE {_before('ing')} END"
    left = _before(1)  # what stands before the mark
    mended = (f"CASE WHEN {d.ends('at/')} OR {d.ends('bl/')} OR {d.ends('iz/')} THEN concat({left}, 'e') "
              f"WHEN {d.match(left, DOUBLE)} THEN {_before(2)} WHEN {d.match(left, SHORT)} THEN concat({left}, 'e') ELSE {left} END")
    fourth = [f"WHEN {d.ends(old)} THEN CASE WHEN {d.match(_before(old), M2)}"
              + (f" AND ({d.ends('sion')} OR {d.ends('tion')})" if old == "ion" else "") + f" THEN {_before(old)} ELSE w END"
              for old, _ in _longest_first([(s, "") for s in STEP_4])]
    return [
        # A leading y is marked as the consonant it is; the last step takes the mark away.
        "CASE WHEN left(w, 1) = 'y' THEN concat('Y', substring(w, 2)) ELSE w END",
        f"CASE WHEN {d.ends('sses')} OR {d.ends('ies')} THEN {_before(2)} WHEN {d.ends('ss')} THEN w WHEN {d.ends('s')} THEN {_before(1)} ELSE w END",
        # Suffix cut off (marked by a slash), then mended.
        f"CASE WHEN {d.ends('eed')} THEN CASE WHEN {d.match(_before('eed'), M1)} THEN {_before(1)} ELSE w END "
        f"WHEN {has_vowel('ed')} OR {has_vowel('ing')} THEN concat({cut}, '/') ELSE w END",
        f"CASE WHEN {d.ends('/')} THEN {mended} ELSE w END",
        f"CASE WHEN {has_vowel('y')} THEN concat({_before(1)}, 'i') ELSE w END",
        _replaced(d, STEP_2, M1),
        _replaced(d, STEP_3, M1),
        f"CASE {' '.join(fourth)} ELSE w END",
        f"CASE WHEN {d.ends('e')} AND ({d.match(_before(1), M2)} OR ({d.match(_before(1), M_IS_1)} AND NOT {d.match(_before(1), SHORT)})) "
        f"THEN {_before(1)} ELSE w END",
        f"CASE WHEN {d.ends('ll')} AND {d.match(_before(1), M2)} THEN {_before(1)} ELSE w END",
        "CASE WHEN left(w, 1) = 'Y' THEN concat('y', substring(w, 2)) ELSE w END",
    ]


def with_stems(words: DataFrame, word: str = "term", stem: str = "stem") -> DataFrame:
    """``words`` with the stem of each. Meant for distinct words: join the result back."""
    others = [c for c in words.columns if c != stem]
    # Numbers, letters outside a-z and words of one or two letters are their own stems.
    plain = F.regexp_like(word, F.lit("^[a-z]{3,}$"))
    out = words.withColumn("w", F.col(word))
    for step in steps(SPARK):
        out = out.withColumn("w", F.expr(step))
    return out.select(*others, F.when(plain, F.col("w")).otherwise(F.col(word)).alias(stem))


def stems_sql(words: str, word: str = "term") -> str:
    """The same over a table expression, in the SQL of the checks: ``word, stem``."""
    inner = f"(SELECT {word}, {word} AS w FROM {words})"
    for step in steps(DUCK):
        inner = f"(SELECT {word}, {step} AS w FROM {inner})"
    return f"(SELECT {word}, CASE WHEN regexp_matches({word}, '^[a-z]{{3,}}$') THEN w ELSE {word} END AS stem FROM {inner})"
