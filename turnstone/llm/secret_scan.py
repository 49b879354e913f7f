"""Secret scan: fixed patterns, and passwords by their guess cost.

Values that stand in a credential context (a key such as ``password``, ``pin`` or
``login``, also at the end of a longer name, and a separator) are priced by a dynamic
program: the cheapest way to cut the value into dictionary words, dates, repeats,
keyboard walks and brute-force spans, in log10 guesses. A value that costs enough is a
secret. Values may be in any script. A value in quotes ends at its quote, and keys
inside it are looked for too; a bare one ends at white space, at a quote that closes
what it stands in, or at a delimiter before the next key.

A repeat goes on with a period: a block said before, once or more often, and any part of
it. Words, walks and repeats have any length and stand anywhere. Repeats come from the
value's maximal runs (fewer than it has characters), found from suffix ranks; words from
a walk over the dictionary's prefixes.

Cases. Null text is empty: no span. Long texts are read whole. A long value is priced by
growing prefixes, until no segment that is still open could bring it under the
threshold, else to its end. Repeated rows are scanned each. Empty table: empty result.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import pieces, utf8

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of 16 or more
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_LENGTH = 8
# What a value is made of: no white space, no control characters, in any script.
SEEN = r"[^\x00-\x20\x7F-\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Keys that announce a credential, then a separator and a value without spaces.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|(?<![A-Za-z0-9])pin|secret|credentials?|login|auth|token|api[_-]?key|"""
    rf"""access[_-]?key|private[_-]?key)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(["']?+)(?={SEEN}{{6}})""", re.I | re.A)
QUOTED = {q: re.compile(rf"((?:\\{SEEN}|(?!{q}){SEEN})*){q}") for q in "\"'"}
# A delimiter ends a bare value only before the next key, so passwords may hold it.
NEXT_KEY = (r"""(?:[,;&|?]|[}\])]["'`]?[,;&|{\[(<])["'`{}\[\]()<>,;&|]{0,8}[\x20\t]{0,8}"""
            r"""["']?[a-z_][\w.-]{0,63}["']?[\x20\t]{0,8}[:=]""")
BARE = re.compile(rf"""(?:(?!["'`](?:[\s,;:&}}\])>]|$)|{NEXT_KEY}){SEEN})*""", re.I | re.A)
CLOSERS = "\"'`,;)]}>"

# Common words of passwords, most common first.
WORDS = (
    "password pass admin user root login welcome secret qwerty monkey dragon master letmein test guest hello love "
    "money sunshine princess football baseball shadow summer winter spring autumn monday friday january december "
    "change default system server access token key private public service account company office house music "
    "computer internet example sample demo temp super secure star tiger eagle blue green black white red gold "
    "silver happy angel baby the and you for with from this that one two three four five six seven eight nine ten"
).split()
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LOOK_ALIKE = str.maketrans("@4310$57!", "aaeiossti")
WORD_LETTERS = (3, 64)  # of the words counted for a dictionary
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:(?:19|20)?\d\d)")


@dataclass(frozen=True)
class Prices:
    """log10 guesses of one character of brute force, and the least that counts as a secret."""

    threshold: float = 9.0
    least_length: int = 6


def _neighbours() -> set[str]:
    out = set()
    for row in ROWS:
        for a, b in zip(row, row[1:]):
            out |= {a + b, b + a}
    columns = [c for c in zip(*(r[:10].ljust(10) for r in ROWS))]
    for column in columns:
        for a, b in zip(column, column[1:]):
            if " " not in a + b:
                out |= {a + b, b + a}
    return out


NEIGHBOURS = _neighbours()


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


class Lexicon(dict):
    """Ranks of words, and every prefix that some word goes on from."""

    def __init__(self, ranks: dict[str, int]):
        super().__init__(ranks)
        self.prefixes = {w[:k] for w in ranks for k in range(1, len(w))}
        self.longest = max(map(len, ranks), default=0)


@dataclass
class Stretch:
    """Segments [j, i) of one kind with first <= j, i <= end and i - j >= least; such a
    one costs price + log10(i - j)."""

    first: int
    end: int
    least: int
    price: float
    starts: list = field(default_factory=list)  # (j, cost up to j) that may still be best

    def cheapest(self, i: int, best: list[float]) -> float:
        """The least cost up to i, called for each i in turn. A start that is dearer than a later one is out for
        good, and so is one that a former one beats, as the logarithm flattens."""
        j = i - self.least
        while self.starts and self.starts[-1][1] >= best[j]:
            self.starts.pop()
        self.starts.append((j, best[j]))
        kept, low = [], math.inf
        for j, cost in self.starts:
            here = cost + math.log10(i - j)
            if here < low:
                low = here
                kept.append((j, cost))
        self.starts = kept
        return low + self.price


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: numbers that order the substrings of 2**k characters from each place; the last
    orders the suffixes. A substring that the end cuts off comes before those it begins."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    out, width = [rank], 1
    while width < len(rank) and rank.max() < len(rank) - 1:
        after = np.concatenate([rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64)])[:len(rank)]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        out.append(rank)
        width *= 2
    return out


def _common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many characters agree from the places a and b on (a < b)."""
    n, got = len(ranks[0]), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        fits = b + got + (1 << k) <= n
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        got += (fits & (ranks[k][x] == ranks[k][y])).astype(np.int64) << k
    return got


def periodic_runs(value: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of every maximal stretch at least two of its least periods long.
    The root of a run is the longest Lyndon word from one of its places, under the order of
    characters or its reverse; such a word ends where the next smaller suffix begins."""
    n = len(value)
    if n < 2:
        return []
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    forward, places = _ranks(codes), np.arange(n)
    backward = _ranks(codes[::-1])
    found = set()
    for order in (forward[-1], _ranks(-codes)[-1]):
        smaller, waiting = np.full(n, n), []
        for i, r in enumerate(order.tolist()):
            while waiting and waiting[-1][1] > r:
                smaller[waiting.pop()[0]] = i
            waiting.append((i, r))
        at, to = places[smaller < n], smaller[smaller < n]
        right = _common(forward, at, to)
        left = np.zeros(len(at), np.int64)
        inner = at > 0
        left[inner] = _common(backward, n - to[inner], n - at[inner])
        period = to - at
        good = left + right >= period
        found.update(zip((at - left)[good].tolist(), (to + right)[good].tolist(), period[good].tolist()))
    return sorted(found)


STEP = math.log10(2)  # each segment pays for its place among the kinds
SHORTEST = 3  # of words, walks and runs of one character


def _plain_lower(value: str) -> str:
    return "".join(d if len(d := c.lower()) == 1 else c for c in value)


def _stretches(value: str, low: str) -> list[Stretch]:
    out, n = [], len(value)
    for s, e, p in periodic_runs(value):
        out.append(Stretch(s + p, e, p, math.log10(p + 1) + STEP))
        if p == 1 and e - s >= SHORTEST:  # the character and a count
            out.append(Stretch(s, e, SHORTEST, math.log10(_alphabet(value[s])) + STEP))
    start = 0
    for i in range(1, n + 1):
        if i == n or low[i - 1:i + 1] not in NEIGHBOURS:
            if i - start >= SHORTEST:  # start key, length, turns
                out.append(Stretch(start, i, SHORTEST, math.log10(47 * 4) + STEP))
            start = i
    return sorted(out, key=lambda x: x.first + x.least)


def _date_price(length: int) -> float:
    return math.log10(365 * 120 if length >= 6 else 12 * 120 if length > 4 else 120) + STEP


def _costs(value: str, words: Lexicon) -> list[float]:
    """log10 guesses of the cheapest segmentation of every prefix."""
    n, low = len(value), _plain_lower(value)
    plain = low.translate(LOOK_ALIKE)
    best = [0.0] + [math.inf] * n
    coming, active = _stretches(value, low), []
    coming.reverse()
    for i in range(1, n + 1):
        j = i - 1
        for text, change in ((low, 0.0), (plain, 1.3)):
            k = j + 1
            while k <= n:
                part = text[j:k]
                rank = words.get(part) if k - j >= SHORTEST else None
                if rank is not None:
                    extra = change or (0.0 if value[j:k] == part else 1.0)
                    best[k] = min(best[k], best[j] + math.log10(rank + 1) + extra + STEP)
                if part not in words.prefixes:
                    break
                k += 1
        if value[j].isdigit():
            for k in range(j + 4, min(n, j + 10) + 1):
                if DATE.fullmatch(value, j, k):
                    best[k] = min(best[k], best[j] + _date_price(k - j))
        cost = min(best[i], best[j] + math.log10(_alphabet(value[j])) + 0.1)
        while coming and coming[-1].first + coming[-1].least <= i:
            active.append(coming.pop())
        if active:
            active = [x for x in active if x.end >= i]
            for x in active:
                cost = min(cost, x.cheapest(i, best))
        best[i] = cost
    return best


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses the cheapest segmentation needs; a further log10(2)
    per segment pays for its place among the kinds."""
    return _costs(value, ranks if isinstance(ranks, Lexicon) else Lexicon(ranks))[-1]


def _open_from(value: str, m: int, words: Lexicon) -> int:
    """The first place from which a segment may reach over place ``m``."""
    low = _plain_lower(value[:m + 1])
    walk = m
    while walk > 0 and (walk == m or low[walk - 1:walk + 1] in NEIGHBOURS or value[walk - 1] == value[walk]):
        walk -= 1
    here, few, many = value[:m], 0, m  # the longest end of the prefix that it also holds earlier
    while few < many:
        k = (few + many + 1) // 2
        if here.find(here[m - k:]) < m - k:
            few = k
        else:
            many = k - 1
    return max(0, min(walk, m - few, m - words.longest, m - 10))


def is_costly(value: str, words: Lexicon, threshold: float) -> bool:
    """Whether ``guess_cost`` is at least ``threshold``. All segmentations of the whole value cut it
    at a place from which a segment reaches over the end of a prefix, or right there: if all of
    these cost the threshold already, so does the value."""
    m = 32
    while m < len(value):
        best = _costs(value[:m], words)
        if min(best[_open_from(value, m, words):]) >= threshold:
            return True
        m *= 2
    return guess_cost(value, words) >= threshold


ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT_HINTS = (b"pass", b"pwd", b"pin", b"secret", b"credential", b"login", b"auth", b"token", b"key")


def base_spans(text: str, low: bytes) -> list[tuple[str, int, int]]:
    """``low`` is the text's bytes in lower case; a text without any of the keys
    is spared the pattern."""
    out = []
    if any(h in low for h in ASSIGN_HINTS):
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def guess_spans(text: str, low: bytes, ranks: dict[str, int], prices: Prices) -> list[tuple[str, int, int]]:
    """Spans of credential-context values that are costly to guess."""
    out = []
    if not any(h in low for h in CONTEXT_HINTS):
        return out
    words = ranks if isinstance(ranks, Lexicon) else Lexicon(ranks)
    at = 0
    while m := CONTEXT.search(text, at):
        start = m.end()
        closed = QUOTED[m[1]].match(text, start) if m[1] else None
        if closed:  # keys inside the quotes, such as those of a query string, come next
            value, at = closed[1], start
        else:
            at = BARE.match(text, start).end()
            value = text[start:at].rstrip(CLOSERS + ".")
        if len(value) >= prices.least_length and is_costly(value, words, prices.threshold):
            out.append(("guess", start, start + len(value)))
    return out


def written_spans(spans: list[tuple[str, int, int]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def frequent_words(docs: DataFrame, n: int = 5000, text: str = "text") -> list[str]:
    """The ``n`` most frequent words of the corpus (3 to 64 letters, of any script), most
    common first: the dictionary that makes plain prose cheap to guess. Counts all rows;
    the list is a parameter of bounded size."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[\x00-\x60\x7B-\x7F]+")).alias("w"))
    counted = words.where(F.length("w").between(*WORD_LETTERS)).groupBy("w").count()
    return [r.w for r in counted.orderBy(F.desc("count"), "w").limit(n).collect()]


def scan(docs: DataFrame, words: list[str] = WORDS, prices: Prices = Prices(),
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; map-only.
    ``words`` is the dictionary, most common first."""
    ranks = Lexicon({w: i + 1 for i, w in reversed(list(enumerate(words)))})

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for raw in utf8(batch.column(1)):
                t, low = raw.decode(), raw.lower()
                base = base_spans(t, low)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
                rows.append((*n, digest, written_spans(base + guess_spans(t, low, ranks, prices))))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(step, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
