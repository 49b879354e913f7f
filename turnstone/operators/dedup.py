"""Transcripts that share a source id: copies, and borrowed metadata.

In path order a transcript that reads like one already kept is a copy. An id whose
distinct texts fit a bound is settled in one task, against an index of the texts
kept. A hotter id is first cut, under the rule of shingles, into parts that share no
rare shingle and so hold no alike pair across; each is settled in one task likewise. A
part (or id) still too large goes in rounds: each settles its next few undecided
transcripts and compares all the others with the ones kept, over many tasks; what
travels to them is only the handful of texts just kept.
"""

from __future__ import annotations

import difflib
import heapq
import math
from collections import Counter, defaultdict
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.operators.bounds import merged
from turnstone.operators.tables import fresh_path, stored
from turnstone.session import ensure_checkpoint_dir
from turnstone.settings import DEFAULTS, Settings

KEEP, DUPLICATE, BORROWED = "keep", "duplicate", "borrowed"
AT_ONCE_ROWS, AT_ONCE_BYTES = 1_024, 8 << 20  # distinct texts of an id that one task settles
PER_ROUND = (32, 64, 128, 256)  # texts of a hotter part settled per round; the last one repeats
PART_ROWS = 5_000
HEADS = "video_id string, part long, source_path string, head string"


class BySequence:
    """Matching-block similarity above ``ratio``."""

    def __init__(self, ratio: float):
        self.ratio = ratio

    def alike(self, a: str, b: str) -> bool:
        """``SequenceMatcher(None, a, b, autojunk=False).ratio() > self.ratio``. What lies
        before and after a block is matched apart, so the stretches are taken by size, until
        the characters matched or those that still can be decide."""
        above = lambda m: (2.0 * m / total if total else 1.0) > self.ratio
        total, found, left, open_ = len(a) + len(b), 0, 0, []
        blocks, stretches = LongestBlocks(a, b), [(0, len(a), 0, len(b))]
        while True:
            for alo, ahi, blo, bhi in stretches:
                if most := min(ahi - alo, bhi - blo):
                    left += most
                    heapq.heappush(open_, (-most, alo, ahi, blo, bhi))
            if above(found) or not open_ or not above(found + left):
                return above(found)
            most, alo, ahi, blo, bhi = heapq.heappop(open_)
            i, j, k = blocks.find(alo, ahi, blo, bhi)
            found, left = found + k, left + most
            stretches = [(alo, i, blo, j), (i + k, ahi, j + k, bhi)] if k else []

    def kept(self) -> SequenceIndex:
        return SequenceIndex(self)


class LongestBlocks:
    """``SequenceMatcher.find_longest_match`` of two texts for stretches of any length: the
    size by bisection over hashes of all runs of one length. A block found is compared
    character by character; should hashes have collided, the plain search decides."""

    SMALL = 1 << 14  # pairs of characters below which the plain search is quicker

    def __init__(self, a: str, b: str):
        self.a, self.b, n = a, b, max(len(a), len(b))
        self.powers = np.cumprod(np.full(n + 1, 0x9E3779B97F4A7C15, np.uint64))
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((_codes(t) + np.uint64(1)) * self.powers[:len(t)])]) for t in (a, b)]

    def runs(self, which: int, lo: int, hi: int, k: int) -> np.ndarray:
        """A hash of every run of ``k`` characters of the stretch, whatever its place."""
        s, at = self.sums[which], len(self.powers) - 1
        return (s[lo + k:hi + 1] - s[lo:hi + 1 - k]) * self.powers[at - hi + k:at - lo + 1][::-1]

    def find(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """Start in both texts and size of the longest block, the first in a, then in b."""
        if (ahi - alo) * (bhi - blo) > self.SMALL:
            size, over, place = 0, min(ahi - alo, bhi - blo) + 1, (alo, blo)
            while over - size > 1:
                k = (size + over) // 2
                own, other = self.runs(0, alo, ahi, k), self.runs(1, blo, bhi, k)
                hits = np.isin(own, other)
                if hits.any():
                    i = int(hits.argmax())
                    size, place = k, (alo + i, blo + int((other == own[i]).argmax()))
                else:
                    over = k
            i, j = place
            if self.a[i:i + size] == self.b[j:j + size]:
                return i, j, size
        i, j, k = difflib.SequenceMatcher(None, self.a[alo:ahi], self.b[blo:bhi], autojunk=False).find_longest_match()
        return alo + i, blo + j, k


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class SequenceIndex:
    """Kept texts with counts of their characters and character runs, so that one
    array operation rules out the texts that cannot be alike.

    Of texts of T characters together with M matched in each, the shared
    characters are at least M and the shared runs of q characters at least
    ``(2q - 1) M - (q - 1) (T + 1)``: an unmatched character spoils at most q runs of its
    own text and q - 1 that straddle its place in the other. Counts go to hashed
    cells, which can only raise what is shared, so no alike pair is lost.
    """

    RUNS, CELLS = (1, 3, 4), 2048

    def __init__(self, rule: BySequence):
        self.rule, self.texts = rule, []
        self.cells = np.zeros((16, len(self.RUNS), self.CELLS), np.int32)
        self.sizes = np.zeros(16, np.int64)

    def counts(self, text: str) -> np.ndarray:
        codes = _codes(text)
        out = np.zeros((len(self.RUNS), self.CELLS), np.int32)
        for at, q in enumerate(self.RUNS):
            n = len(codes) - q + 1
            if n > 0:
                key = np.zeros(n, np.uint64)
                for i in range(q):
                    key = key * np.uint64(1_000_003) + codes[i:i + n]
                key *= np.uint64(0x9E3779B97F4A7C15)
                out[at] = np.bincount((key >> np.uint64(53)).astype(np.int64), minlength=self.CELLS)
        return out

    def holds(self, text: str) -> bool:
        """Is ``text`` alike to a kept one?"""
        n = len(self.texts)
        both = self.sizes[:n] + len(text)
        matched = self.rule.ratio * both / 2
        near = np.flatnonzero(np.minimum(self.sizes[:n], len(text)) >= matched - 1e-6)
        if not len(near):
            return False
        own = self.counts(text)
        for at, q in enumerate(self.RUNS):
            shared = np.minimum(self.cells[near, at], own[at]).sum(1)
            near = near[shared >= (2 * q - 1) * matched[near] - (q - 1) * (both[near] + 1) - 1e-6]
        return any(self.rule.alike(text, self.texts[i]) for i in near)

    def add(self, text: str) -> None:
        n = len(self.texts)
        if n == len(self.sizes):
            self.cells = np.concatenate([self.cells, np.zeros_like(self.cells)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.cells[n], self.sizes[n] = self.counts(text), len(text)
        self.texts.append(text)


class ByShingles:
    """Jaccard overlap of word ``n``-grams at or above ``threshold``. Texts of fewer
    than ``n`` words are like their equals only."""

    def __init__(self, threshold: float, n: int = 3):
        self.threshold, self.n = threshold, n

    def shingles(self, text: str) -> set:
        w = text.split()
        return set(zip(*(w[i:] for i in range(self.n)), strict=False))

    def kept(self) -> ShingleIndex:
        return ShingleIndex(self)


class ShingleIndex:
    """Kept texts as posting lists of their shingles: the overlap with all of them is
    counted at once, and a text that shares nothing is never met."""

    def __init__(self, rule: ByShingles):
        self.rule, self.sizes, self.at, self.last = rule, [], defaultdict(list), ("", set())

    def _of(self, text: str) -> set:
        if self.last[0] != text:
            self.last = (text, self.rule.shingles(text))
        return self.last[1]

    def holds(self, text: str) -> bool:
        own = self._of(text)
        shared = Counter(chain.from_iterable(self.at[g] for g in own if g in self.at))
        return any(n >= self.rule.threshold * (len(own) + self.sizes[i] - n) for i, n in shared.items())

    def add(self, text: str) -> None:
        own = self._of(text)
        for g in own:
            self.at[g].append(len(self.sizes))
        self.sizes.append(len(own))


def decide_copies(files: DataFrame, settings: Settings = DEFAULTS,
                  same: BySequence | ByShingles | None = None) -> DataFrame:
    """``source_path, decision`` (keep or duplicate) for every file whose
    ``video_id`` another file also has. Null texts count as empty."""
    same = same or BySequence(settings.same_text_ratio)
    ensure_checkpoint_dir(files.sparkSession)
    body = F.coalesce("body", F.lit(""))
    head = F.substring(body, 1, settings.compare_chars) if settings.compare_chars else body
    heads = files.select("source_path", "video_id", head.alias("head"))
    # Equal heads share their first one's fate or are its copies: settled by hash.
    keyed = heads.where("video_id is not null").withColumn("h", F.sha2("head", 256))
    texts = keyed.groupBy("video_id", "h").agg(
        F.min("source_path").alias("first_path"), F.count("*").alias("n"), F.first(F.octet_length("head")).alias("b"))
    ids = texts.groupBy("video_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("texts"), F.sum("b").alias("b")).where("n > 1").select(
        "video_id", "texts", _at_once("texts", "b").alias("at_once"))
    of_text = texts.select("video_id", "h", "first_path").join(merged(ids), "video_id")  # no text under a hot id moves here
    marked = keyed.join(merged(of_text), ["video_id", "h"])
    marked = stored(marked.select("video_id", "source_path", "texts", "at_once", (F.col("source_path") == F.col("first_path")).alias("first"),
                                  F.when(F.col("source_path") == F.col("first_path"), F.col("head")).alias("head")), "marked")
    # One text under the id: its first file stays.
    settled = marked.where("not first or texts = 1").select("source_path", F.col("first").alias("kept"))
    several = marked.where("first and texts > 1").select("video_id", F.lit(0).cast("long").alias("part"), "source_path", "head", "at_once")
    small, hot = several.where("at_once"), several.where("not at_once").drop("at_once")
    if not hot.isEmpty():
        if isinstance(same, ByShingles):
            hot = _parted(hot, same)
            settled = settled.unionByName(hot.where("alone").select("source_path", F.lit(True).alias("kept")))
            small, hot = small.unionByName(hot.where("at_once").drop("alone")), hot.where("not alone and not at_once").drop("alone", "at_once")
        settled = settled.unionByName(_in_rounds(hot, same))
    judged = small.drop("at_once").groupBy("video_id", "part").applyInPandas(_greedy(same), f"{HEADS}, kept boolean")
    return settled.unionByName(judged.select("source_path", "kept")).select(
        "source_path", F.when(F.col("kept"), F.lit(KEEP)).otherwise(F.lit(DUPLICATE)).alias("decision"))


def _at_once(rows: str, size: str) -> F.Column:
    return (F.col(rows) <= AT_ONCE_ROWS) & (F.col(size) <= AT_ONCE_BYTES)


def _parted(hot: DataFrame, same: ByShingles) -> DataFrame:
    """``hot`` in parts that can be settled apart, since no two texts of different parts
    are alike: ``part``, is the text ``alone`` in it, may one task settle it ``at_once``.

    Of texts alike at a threshold t each has at least t of its shingles in the other, so
    their rarest common one is among the rarest (1 - t) and one more of either. Texts
    that share one of these are linked, and a part is what links connect. Shingles are
    hashed: a collision can only link more.
    """
    hot = stored(hot.withColumn("_node", F.xxhash64("video_id", "source_path", "head")), "hot")
    tokens = stored(hot.select("video_id", "_node", "head").mapInArrow(
        _hashed_shingles(same), "node long, size int, few int, token long"), "tokens")
    common = tokens.join(merged(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")), "token")
    mine = Window.partitionBy("node")
    rarest = common.withColumn("_nth", F.row_number().over(mine.orderBy("n", "token")) + F.col("size") - F.count("*").over(mine))
    rarest = stored(rarest.where("_nth <= few").select("node", "token"), "rarest")
    first = rarest.groupBy("token").agg(F.min("node").alias("b"))
    links = rarest.join(merged(first), "token").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    parts = connected(links).select(F.col("a").alias("_node"), F.col("b").alias("_part"))
    placed = hot.join(merged(parts), "_node", "left").withColumn("part", F.coalesce("_part", "_node")).drop("_part", "_node")
    sizes = placed.groupBy("video_id", "part").agg(F.count("*").alias("_rows"), F.sum(F.octet_length("head")).alias("_bytes")).select(
        "video_id", "part", (F.col("_rows") == 1).alias("alone"), ((F.col("_rows") > 1) & _at_once("_rows", "_bytes")).alias("at_once"))
    return stored(placed.join(merged(sizes), ["video_id", "part"]), "parted")


def _hashed_shingles(same: ByShingles):
    def hashes(words: list[str], key: str) -> np.ndarray:
        codes = pd.util.hash_array(np.array([key, *words], dtype=object))
        n = len(words) - same.n + 1
        out = np.full(n, codes[0])
        for i in range(same.n):
            out = (out ^ codes[1 + i:1 + i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def per_batch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some, out = batch.slice(at, 256).to_pydict(), []
                for key, node, head in zip(some["video_id"], some["_node"], some["head"]):
                    if not (n := len(same.shingles(head))):
                        continue
                    own = hashes(head.split(), key).view(np.int64)
                    few = n - math.ceil(same.threshold * n - 1e-9) + 1
                    out.append((np.full(len(own), node), np.full(len(own), len(own), np.int32), np.full(len(own), few, np.int32), own))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "size", "few", "token"])

    return per_batch


def connected(links: DataFrame) -> DataFrame:
    """``a, b`` for every linked node a but the smallest of its component, b. Large and
    small stars in turn: first larger neighbours, then all others, move to the smallest
    one, until nothing moves. Only links are shuffled, never a component."""
    way = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"))
    links = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        if state == seen:
            return links
        seen = state
        both = links.unionByName(links.select(*way("b", "a")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = stored(both.join(merged(least), "a").where("b > a").select(*way("b", "m")).distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(merged(least), "a").where("b <> m").select(*way("b", "m")).unionByName(least.select(*way("a", "m")))
        links = stored(small.distinct(), "links")


def _in_rounds(undecided: DataFrame, same) -> DataFrame:
    """``source_path, kept`` of every row. What a round settles is written, so that the
    plan does not grow with the rounds."""
    spark = undecided.sparkSession
    path, key = fresh_path(spark, "settled"), ["video_id", "part", "source_path"]
    undecided = stored(undecided, "undecided")
    undecided.select("source_path", F.lit(False).alias("kept")).limit(0).write.parquet(path)
    for take in chain(PER_ROUND, repeat(PER_ROUND[-1])):
        if undecided.isEmpty():
            return spark.read.schema("source_path string, kept boolean").parquet(path)
        w = Window.partitionBy("video_id", "part").orderBy("source_path")
        batch = undecided.withColumn("_rn", F.row_number().over(w)).where(
            F.col("_rn") <= take).drop("_rn")
        judged = stored(batch.groupBy("video_id", "part").applyInPandas(_greedy(same), f"{HEADS}, kept boolean"), "judged")
        rest = undecided.join(merged(judged.select(key)), key, "left_anti")
        compared = stored(_compare(rest, judged.where("kept").drop("kept"), same), "compared")
        judged.select("source_path", "kept").unionByName(
            compared.where("copy").select("source_path", F.lit(False).alias("kept"))).write.mode("append").parquet(path)
        undecided = compared.where(~F.col("copy")).drop("copy")


def _greedy(same):
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source_path")
        index, flags = same.kept(), []
        for head in group["head"]:
            fresh = not index.holds(head)
            flags.append(fresh)
            if fresh:
                index.add(head)
        return group.assign(kept=flags)[["video_id", "part", "source_path", "head", "kept"]]

    return settle


def _compare(rest: DataFrame, kept: DataFrame, same) -> DataFrame:
    """``rest`` with ``copy``: alike to a text kept this round? Rows of one part
    spread over pieces of bounded size, and the kept texts go to each piece."""
    key = ["video_id", "part"]
    sizes = rest.groupBy(*key).agg(
        F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_pieces"))
    left = rest.join(merged(sizes), key).withColumn(
        "_piece", F.pmod(F.xxhash64("source_path"), F.col("_pieces")).cast("int")).drop("_pieces")
    right = kept.join(merged(sizes), key).select(
        *key, "head", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        index = same.kept()
        for head in b["head"]:
            index.add(head)
        return a.assign(copy=pd.Series(map(index.holds, a["head"]), index=a.index, dtype=bool))[
            [*key, "source_path", "head", "copy"]]

    return left.groupBy(*key, "_piece").cogroup(
        right.groupBy(*key, "_piece")).applyInPandas(meet, f"{HEADS}, copy boolean")


def metadata_owners(members: DataFrame) -> DataFrame:
    """``video_id, owner_path``: the one file whose guest the first file's title
    names, unless another file's guest contains that guest. Ids without a clear
    owner are absent."""
    first = members.groupBy("video_id").agg(
        F.lower(F.min_by("title", "source_path")).alias("_title"))
    named = members.join(merged(first), "video_id").where(
        F.contains("_title", F.lower("guest"))).groupBy("video_id").agg(
        F.count("*").alias("_n"), F.min("source_path").alias("owner_path"),
        F.lower(F.min("guest")).alias("_owner")).where("_n = 1").drop("_n")
    clashes = members.join(merged(named), "video_id").where(
        (F.col("source_path") != F.col("owner_path")) & F.contains(F.lower("guest"), F.col("_owner")))
    return named.join(merged(clashes.select("video_id").distinct()), "video_id", "left_anti").select(
        "video_id", "owner_path")


def decide(files: DataFrame, settings: Settings = DEFAULTS,
           same: BySequence | ByShingles | None = None) -> DataFrame:
    """Every file with ``decision``: keep, duplicate or borrowed."""
    copies = stored(decide_copies(files, settings, same), "copies")  # read twice below
    kept = files.join(merged(copies.where(F.col("decision") == KEEP)), "source_path", "left_semi").select(
        "source_path", "video_id", "title", "guest")
    several = kept.groupBy("video_id").agg(F.count("*").alias("n")).where("n > 1")
    rivals = kept.join(merged(several), "video_id", "left_semi")
    borrowed = rivals.join(merged(metadata_owners(rivals)), "video_id", "left").where(
        F.col("owner_path").isNull() | (F.col("owner_path") != F.col("source_path"))).select(
        "source_path", F.lit(BORROWED).alias("_borrowed"))
    return (files.join(merged(copies), "source_path", "left").join(merged(borrowed), "source_path", "left")
            .withColumn("decision", F.coalesce("_borrowed", "decision", F.lit(KEEP)))
            .drop("_borrowed"))


def folder(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -2)


def drop_borrowed(decided: DataFrame) -> DataFrame:
    """Borrowed rows keep guest, text and hash, and lose what belongs elsewhere."""
    lost = F.col("decision") == BORROWED
    blank = {
        "video_id": F.concat(F.lit("slug:"), folder(F.col("source_path"))),
        "title": F.lit("Untitled episode"), "youtube_url": F.lit(""),
        "publish_date": F.lit(None).cast("date"), "duration_seconds": F.lit(None).cast("double"),
        "description": F.lit(None).cast("string"), "keywords": F.array().cast("array<string>"),
    }
    return decided.withColumns({
        name: F.when(lost, value).otherwise(F.col(name))
        for name, value in blank.items() if name in decided.columns})


def first_per_id(files: DataFrame) -> DataFrame:
    """``files`` with ``collides``: an earlier path already took this id."""
    first = files.groupBy("video_id").agg(F.min("source_path").alias("_first"))
    return files.join(merged(first), "video_id").withColumn(
        "collides", F.col("source_path") != F.col("_first")).drop("_first")
