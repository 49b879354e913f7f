"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of parts. Each merge rank has a bucket of
list positions; a bitmap of two levels says which buckets are filled, and
find-first-set walks it to the lowest rank. A position whose pair has changed
since it was queued is stale and skipped. A merge queues at most two positions,
so a pre-token of n bytes costs about n queue steps, however long it is.

Cases. Null and empty texts have no ids. Very long texts and pre-tokens are
encoded whole; only short pre-tokens are remembered. Repeated rows are encoded
each. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import pieces, utf8

REMEMBER_LENGTH = 40  # longest cut or pre-token whose ids are remembered
REMEMBER_PIECES = 500_000  # in each of two generations
REMEMBER_CUTS = 200_000  # of several pre-tokens
BOUNDARY = re.compile(r"(?= \S)").split


BITS = [1 << k for k in range(256)]


def merge_by_rank(ids: list[int], queued: list[int], find) -> list[int]:
    """Merges neighbouring ids, lowest rank first and leftmost among equals, until no
    pair has a rank (``find`` gives a pair's rank, the merged id, or -1). ``queued``
    has the rank of the pair that starts at each position, -1 for none; a position
    taken from another rank's bucket is stale.

    The queue: ``buckets`` holds the position of a rank, or several in heap order; a
    word of ``words`` says which of 256 neighbouring ranks have a bucket, ``top``
    which words are filled. The lowest set bit of ``top``, then of its word, is the
    next rank."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    buckets: dict[int, int | list[int]] = {}
    words: dict[int, int] = {}
    top, i = 0, -1
    for rank in queued:
        i += 1
        if rank < 0:
            continue
        if rank in buckets:
            held = buckets[rank]
            if type(held) is int:
                buckets[rank] = [held, i]
            else:
                held.append(i)
        else:
            buckets[rank] = i
            high = rank >> 8
            if high in words:
                words[high] |= BITS[rank & 255]
            else:
                words[high] = BITS[rank & 255]
                top |= BITS[high]
    while top:
        high = (top & -top).bit_length() - 1
        word = words[high]
        rank = high << 8 | (word & -word).bit_length() - 1
        i = buckets[rank]
        if type(i) is list:
            held, i = i, heapq.heappop(i)
        else:
            held = None
        if not held:
            del buckets[rank]
            word &= word - 1
            if word:
                words[high] = word
            else:
                del words[high]
                top &= top - 1
        if queued[i] != rank:
            continue  # stale: the pair it was queued for is gone
        j = after[i]
        ids[i] = rank
        ids[j] = queued[i] = queued[j] = -1
        after[i] = k = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            queued[i] = find(rank << 20 | ids[k], -1)
        if h >= 0:
            queued[h] = find(ids[h] << 20 | rank, -1)
        for at in (i, h) if h >= 0 else (i,):
            new = queued[at]
            if new < 0:
                continue
            if new in buckets:
                held = buckets[new]
                if type(held) is int:
                    buckets[new] = [held, at] if held < at else [at, held]
                else:
                    heapq.heappush(held, at)
            else:
                buckets[new] = at
                high = new >> 8
                if high in words:
                    words[high] |= BITS[new & 255]
                else:
                    words[high] = BITS[new & 255]
                    top |= BITS[high]
    return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.packed = {r: r.to_bytes(4, "little") for r in self.tokens}
        self.split = regex.compile(pattern).findall
        self.bytes_of = [self.ranks[bytes([b])] for b in range(256)]
        # Which two ids may merge, and into what: every way to cut a token in two. Ids are under 2^20.
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        a = self.bytes_of
        self.byte_pairs = [[self.pairs.get(x << 20 | y, -1) for y in a] for x in a]
        self.fresh: dict[str, bytes] = {}
        self.stale: dict[str, bytes] = {}
        self.cuts: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rows = self.byte_pairs
        queued = [rows[x][y] for x, y in zip(piece, piece[1:])]
        queued.append(-1)
        return merge_by_rank(list(map(self.bytes_of.__getitem__, piece)), queued, self.pairs.get)

    def encode(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers.

        No match of the pattern reaches over the start of a space that a visible
        character follows, so the text is cut there and whole cuts are remembered."""
        fresh, cuts, out = self.fresh, self.cuts, []
        for cut in BOUNDARY(text):
            got = fresh.get(cut)
            if got is None:
                got = cuts.get(cut)
                if got is None:
                    got = self.cut(cut)
            out.append(got)
        return b"".join(out)

    def cut(self, cut: str) -> bytes:
        found = self.split(cut)
        got = b"".join(map(self.piece, found))
        if len(found) > 1 and len(cut) <= REMEMBER_LENGTH:
            if len(self.cuts) >= REMEMBER_CUTS:
                self.cuts.clear()
            self.cuts[cut] = got
        return got

    def piece(self, piece: str) -> bytes:
        """Remembered in two generations: what is still in use moves to the new one."""
        got = self.fresh.get(piece)
        if got is not None:
            return got
        got = self.stale.get(piece)
        if got is None:
            got = b"".join(map(self.packed.__getitem__, self.merge(piece.encode())))
        if len(piece) <= REMEMBER_LENGTH:
            if len(self.fresh) >= REMEMBER_PIECES:
                self.stale = dict(self.fresh)
                self.fresh.clear()
            self.fresh[piece] = got
        return got

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def _codec(ranks_file: bytes, pattern: str) -> Codec:
    """Built once per worker process."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks_file, pattern)
        gc.freeze()  # the tables stay; collections need not walk them
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens. The driver
    reads the rank file, whose size the vocabulary bounds, and broadcasts it.
    Map-only: no shuffle, and a task holds one batch of texts."""
    file = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value, pattern)
        for batch in pieces(batches):
            ids = [codec.encode(t.decode()) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=["doc_id", "ids", "n_tokens"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(step, f"doc_id {narrow.schema[0].dataType.simpleString()}, ids binary, n_tokens long")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) to rows with ids."""
    file = encoded.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value, pattern)
        for batch in pieces(batches):
            texts = [codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.binary()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(step, f"{fields}, decoded binary")
