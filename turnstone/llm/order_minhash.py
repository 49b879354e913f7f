"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of words (A-Z lower-cased, ASCII punctuation between them
dropped). Each of 48 sketches samples the two smallest occurrence-labelled
3-word shingles under its own hash and keeps them in text order, so a sketch agrees
for texts that share shingles in the same order. Two texts of different classes are
candidates if they agree on one sketch, whatever else is in the corpus. Candidates
are near if an alignment needs edits of at most 0.2 of the longer one's words.
Classes are the connected components of near texts.

The README has the share of pairs found at each edit similarity.

Cases. Null and empty texts, and texts without words, are near only their exact
copies. Texts under three words have one shingle, all their words. Long texts are
sketched and aligned whole. Equal texts are one node; all rows of it share its
class; of a class the row with the smallest id stays, one row even if it repeats.
Null ids rank first. Empty table: empty result. Extra columns are not read, or
passed by (``drop_near_copies``).
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm.common import Scratch, first_per_task, light_pieces, pieces, utf8, written
from turnstone.llm.components import components
from turnstone.operators.bounds import fits

WORDS = 3
SKETCHES = 48
KEEP = 2
SIMILARITY = 0.8
BITS, WIDE = 1024, 1024  # bits set and buckets counted by a text's words, to tell texts apart before they travel
REMEMBER = 200_000
FEW_EDITS = 16  # the first band an alignment tries
WORTH = 0.9  # a round of pairs of labels is followed by another if it leaves less than this of the rows

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_known: dict[bytes, int] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def word_ids(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; the frequent ones are remembered per worker."""
    out = []
    for w in words:
        h = _known.get(w)
        if h is None:
            if len(_known) >= REMEMBER:
                _known.clear()
            h = _known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def node_digest(text: bytes, words: list[bytes]) -> bytes:
    """Equal for texts of the same words; of the text itself where it has none."""
    return hashlib.sha256(b" ".join(words) if words else b"\0" + text).digest()[:16]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(texts: list[np.ndarray]) -> np.ndarray:
    """One row of ``SKETCHES`` values for each non-empty sequence of word ids."""
    with np.errstate(over="ignore"):
        padded = [np.concatenate([t, np.zeros(WORDS - len(t), np.uint64)]) if len(t) < WORDS else t for t in texts]
        lengths = np.array([len(t) for t in padded])
        flat = np.concatenate(padded)
        ends = np.cumsum(lengths)
        n_shingles = lengths - WORDS + 1
        shingle = np.zeros(len(flat) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            shingle = shingle * np.uint64(0x9E3779B97F4A7C15) + flat[k:len(flat) - WORDS + 1 + k]
        inside = np.ones(len(flat), bool)
        for k in range(1, WORDS):
            inside[ends - k] = False
        shingle = mix(shingle[inside[:len(shingle)]])
        row = np.repeat(np.arange(len(texts)), n_shingles)
        first = np.cumsum(n_shingles) - n_shingles
        # The occurrence label: how often the shingle has come before in its text.
        own = shingle ^ mix(row.astype(np.uint64) + np.uint64(1))
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        runs = np.diff(np.concatenate([starts, [len(ordered)]]))
        seen = np.empty(len(own), np.uint64)
        seen[order] = (np.arange(len(own)) - np.repeat(starts, runs)).astype(np.uint64)
        labelled = mix(shingle + seen * np.uint64(0xD6E8FEB86659FD93))
        out = np.empty((len(texts), SKETCHES), np.uint64)
        last = np.uint64(2**64 - 1)
        for s in range(SKETCHES):
            value = mix(labelled ^ np.uint64((s + 1) * 0xA0761D6478BD642F % 2**64))
            picked = np.full((len(texts), KEEP), len(shingle))  # past the end: fewer shingles than KEEP
            for k in range(KEEP):
                least = np.minimum.reduceat(value, first)
                at = np.flatnonzero((value == least[row]) & (value != last))
                picked[row[at], k] = at
                value[at] = last
            picked.sort(axis=1)
            kept = np.concatenate([shingle, [np.uint64(1)]])[picked]
            mixed = np.full(len(texts), s + 1, np.uint64)
            for k in range(KEEP):
                mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + kept[:, k])
            out[:, s] = mixed
        return out


def word_bits(words: np.ndarray) -> np.ndarray:
    """``BITS`` bits, one set by each word: a bit that one text has and another has not is a
    word without a partner, so two texts with d such bits are at least d edits apart."""
    out = np.zeros(BITS, bool)
    out[(words % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(out).view(np.int64)


SIGNS = [f"w{i}" for i in range(BITS // 64)]


def _signed(bits: DataFrame, name: str) -> DataFrame:
    """The nodes' word counts and bits as plain columns under ``name``."""
    return bits.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(w).alias(f"{name}_{w}") for w in SIGNS])


def _apart(a: str, b: str) -> Column:
    """The least number of edits that two signed nodes can be apart."""
    only = lambda x, y: reduce(operator.add, [F.bit_count(F.col(f"{x}_{w}").bitwiseAND(F.bitwise_not(f"{y}_{w}"))) for w in SIGNS])
    return F.greatest(only(a, b), only(b, a), F.abs(F.col(f"{a}_n") - F.col(f"{b}_n")))


def _edits(longer: Column, similarity: float) -> Column:
    return F.floor((1 - similarity) * longer + 1e-9)


def _possible(pairs: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their words' bits and lengths do not tell apart."""
    met = pairs.join(_signed(bits, "b"), "b").join(_signed(bits, "a"), "a")
    return met.where(_apart("a", "b") <= _edits(F.greatest("a_n", "b_n"), similarity)).select("a", "b")


def word_counts(words: np.ndarray) -> np.ndarray:
    """How many words fall into each of ``WIDE`` buckets, 255 at most. What one text has more
    of than another in a bucket is as many words without a partner."""
    return np.minimum(np.bincount((words % np.uint64(WIDE)).astype(np.int64), minlength=WIDE), 255).astype(np.uint8)


def fewest_edits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, how many edits two texts with these counts are apart at least."""
    more = left.astype(np.int16) - right
    return np.maximum(np.maximum(more, 0).sum(axis=1, dtype=np.int64), np.maximum(-more, 0).sum(axis=1, dtype=np.int64))


def _least_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (a, b, left, right): the pairs with that number."""
    for batch in pieces(batches, 4096):
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("left", "right"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(fewest_edits(left, right), pa.int32())],
                                             names=["a", "b", "d"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in light_pieces(batches, 1):
        texts = utf8(batch.column(1))
        words = [words_of(t) for t in texts]
        ids = [word_ids(w) for w in words]
        full = [i for i, x in enumerate(ids) if len(x)]
        found: list = [None] * len(ids)
        if full:
            for i, values in zip(full, sketch([ids[i] for i in full]).view(np.int64).tolist()):
                found[i] = values
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([node_digest(t, w) for t, w in zip(texts, words)], pa.binary()),
             pa.array([len(w) for w in words], pa.int32()), pa.array(found, pa.list_(pa.int64())),
             pa.array([word_counts(x).tobytes() for x in ids], pa.binary()),
             *[pa.array(w) for w in np.stack([word_bits(x) for x in ids]).T]],
            names=["doc_id", "digest", "n", "sketches", "wide", *SIGNS])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words joined by spaces: unlike their hashes, these can be compressed. Of a task's equal
    texts the first, dropped here, as a second function would be a second worker per task."""

    def worded() -> Iterator[pa.RecordBatch]:
        for batch in light_pieces(batches, 0):
            texts = utf8(batch.column(0))
            words = [words_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_digest(t, w) for t, w in zip(texts, words)], pa.binary()),
                 pa.array([b" ".join(w) for w in words], pa.binary())], names=["digest", "words"])

    yield from first_per_task("digest")(worded())


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences if it is at most ``limit``, from alignments
    inside the band of diagonals that such a distance can reach."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return None
    same = np.flatnonzero(a != b[:len(a)])
    head = int(same[0]) if len(same) else len(a)
    a, b = a[head:], b[head:]
    if len(a):
        same = np.flatnonzero(a[::-1] != b[len(b) - len(a):][::-1])
        tail = int(same[0]) if len(same) else len(a)
        a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a):
        return len(b) if len(b) <= limit else None
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if len(b) - int(np.minimum(ca[ia], cb[ib]).sum()) > limit:
        return None  # words without a partner alone cost more
    band = min(FEW_EDITS, limit)
    while True:  # a narrow band first; it settles distances it can hold
        found = _banded(b, a, band)
        if found is not None or band == limit:
            return found
        band = min(4 * band, limit)


def _banded(long: np.ndarray, short: np.ndarray, band: int) -> int | None:
    """Edit distance if it is at most ``band``, from the cells within ``band`` diagonals of the
    main one. A column of them is one integer: its bits say where the distance goes up or down
    by one from a row to the next, so a column costs a few operations on integers as wide as
    the band. The distance is followed down the lowest diagonal, then along the last row."""
    n, m = len(long), len(short)
    if n - m > band:
        return None
    band = min(band, n)
    width = 2 * band + 2
    full, lowest = (1 << width) - 1, 1 << (width - 1)
    places: dict[int, int] = {}
    for i, word in enumerate(long.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    up, down, distance = (full << (width - band - 1)) & full, 0, band
    row = 1 << (width - 2)
    most = 2 * band + m - n  # it can still come down by one a column along the last row
    for j, word in enumerate(short.tolist()):
        at, shift = places.get(word, 0), j - band - 1
        same = (at >> shift if shift >= 0 else at << -shift) & full
        level = ((((same & up) + up) ^ up) | same | down) & full
        right, left = down | (~(level | up) & full), level & up
        if j < n - band:
            distance += not level & lowest
            if distance > most:
                return None
        else:
            distance += bool(right & row) - bool(left & row)
            row >>= 1
        level >>= 1
        up, down = left | (~(level | right) & full), level & right
    return distance if distance <= band else None


def limit_of(longer: int, similarity: float) -> int:
    """The edits that texts of this similarity may need at most."""
    return int((1 - similarity) * longer + 1e-9)


def _compared(measure):
    """For mapInArrow over (a, b, left, right, ...): the pairs for which ``measure`` gives a
    number, with that number. A text that comes again in the next row is hashed once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [(None, None), (None, None)]

        def ids(side: int, text) -> np.ndarray:
            held = text.as_buffer()
            if last[side][0] is None or not held.equals(last[side][0]):
                last[side] = (held, word_ids(held.to_pybytes().split()))
            return last[side][1]

        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            found = [measure(ids(0, left[i]), ids(1, right[i])) for i in range(batch.num_rows)]
            kept = pa.array([f is not None for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(kept), batch.column("b").filter(kept), pa.array([f for f in found if f is not None], pa.int32())],
                names=["a", "b", "d"])

    return step


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` is a written table. Where its nodes are few, the other texts do not travel."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = texts.join(F.broadcast(nodes), "node", "left_semi") if fits(nodes) else texts
    left = texts.select(F.col("node").alias("a"), F.col("words").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("right"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose texts are near, with their edit distance ``d``."""

    def distance(a: np.ndarray, b: np.ndarray) -> int | None:
        return edits_within(a, b, limit_of(max(len(a), len(b)), similarity))

    pairs = scratch.written(pairs, "possible")
    return scratch.written(_with_texts(pairs, texts).mapInArrow(_compared(distance), "a long, b long, d int"), "near")


def _leading_pairs(keys: DataFrame) -> DataFrame:
    """For each node the first node of a bucket that most of its buckets name:
    one pair per node, so a group of copies costs its size and no more."""
    heads = keys.groupBy("v").agg(F.min("node").alias("head"))
    votes = keys.join(heads, "v").where("node <> head").groupBy("node", "head").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", -F.col("head"))).alias("best"))
    return best.select((-F.col("best.col2")).alias("a"), F.col("node").alias("b"))


def _mixed(keys: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The keys of buckets that hold two labels or more, with the node's label now. Labels
    only merge, so a bucket that drops out has nothing left to compare."""
    named = keys.select("node", "v").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = scratch.written(named, "named")
    open_ = named.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
    return scratch.written(named.join(open_, "v", "left_semi"), "mixed")


def _label_pairs(mixed: DataFrame, scratch: Scratch) -> DataFrame:
    """One pair of nodes for any two labels that meet in two buckets or more, the pair
    most of these buckets name: a bucket puts forward the first node of each of its
    labels, against that of its smallest label."""
    fronts = scratch.written(mixed.groupBy("v", "label").agg(F.min("node").alias("node")), "fronts")
    heads = fronts.groupBy("v").agg(F.min(F.struct("label", "node")).alias("head"))
    pairs = fronts.join(heads, "v").where(F.col("label") != F.col("head.label")).groupBy(
        F.col("head.label").alias("la"), F.col("label").alias("lb"), F.col("head.node").alias("a"), F.col("node").alias("b")).agg(
        F.count("*").alias("votes"))
    best = pairs.groupBy("la", "lb").agg(F.sum("votes").alias("met"), F.max(F.struct("votes", "a", "b")).alias("best"))
    return best.where("met > 1").select("best.a", "best.b")


def _crossing_pairs(mixed: DataFrame, anchors: DataFrame, bits: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs of differently labelled nodes that agree on a sketch and may be near.

    In each bucket the nodes outside its largest label meet all others of another label, but
    not one by one. A node hangs from its anchor at a known edit distance (its own anchor at
    0), so a stray first meets the anchors: if stray and anchor are d edits apart at least,
    a node at distance e from the anchor is d - e away at least, by the triangle inequality.
    The first d comes from a few bits of the words, inside the join; for what is left it comes
    from more of them. Only nodes for which d - e is within the limit are paired, so a large group
    costs a stray one comparison, and no near pair is lost."""
    placed = mixed.join(anchors, "node", "left").select(
        "v", "node", "label", F.coalesce("anchor", "node").alias("anchor"), F.coalesce("d", F.lit(0)).alias("d"))
    rows = scratch.written(placed.join(bits.select("node", "n"), "node"), "placed")
    sizes = rows.groupBy("v", "label").agg(F.count("*").alias("c"))
    most = sizes.groupBy("v").agg(F.max(F.struct("c", "label")).alias("most")).select("v", F.col("most.label").alias("most"))
    few = scratch.written(rows.join(most, "v").where("label <> most").select(
        "v", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx")), "strays")
    spots = rows.groupBy("v", "label", "anchor").agg(F.max("d").alias("far"), F.min("n").alias("short"), F.max("n").alias("long"))
    longer = F.greatest("nx", "long")
    fits = (F.col("short") * similarity <= F.col("nx") + 1e-9) & (F.col("nx") * similarity <= F.col("long") + 1e-9)
    met = few.join(_signed(bits, "x"), "x").join(spots.join(_signed(bits, "anchor"), "anchor"), "v").where(
        (F.col("lx") != F.col("label")) & fits & (_apart("x", "anchor") - F.col("far") <= _edits(longer, similarity)))
    met = scratch.written(met.groupBy("x", "anchor").agg(F.max("far").alias("far"), F.max(longer).alias("longer")), "met")
    wide = bits.select("node", F.col("wide").alias("words"))
    bounds = _with_texts(met.where("x <> anchor").select(F.col("anchor").alias("a"), F.col("x").alias("b")), wide).mapInArrow(
        _least_edits, "a long, b long, d int")
    # A stray may be the anchor of nodes under another label; then it is 0 edits away.
    near = met.join(bounds.select(F.col("a").alias("anchor"), F.col("b").alias("x"), F.col("d").alias("least")), ["x", "anchor"], "left")
    near = scratch.written(near.withColumn("least", F.coalesce("least", F.lit(0))).where(
        F.col("least") - F.col("far") <= _edits(F.col("longer"), similarity)).select("x", "anchor", "least"), "open")
    found = few.join(near, "x").join(rows, ["v", "anchor"]).where(
        (F.col("lx") != F.col("label")) & (F.least("nx", "n") >= F.greatest("nx", "n") * similarity - 1e-9)
        & (F.col("least") - F.col("d") <= _edits(F.greatest("nx", "n"), similarity)))
    return found.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def classes(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class),
    class_size, kept, digest (of its words)."""
    scratch = Scratch(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    sketched = narrow.mapInArrow(_sketched, f"doc_id {kind}, digest binary, n int, sketches array<long>, wide binary, "
                                 + ", ".join(f"{w} long" for w in SIGNS))
    sketched = scratch.written(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")
    rows = written(sketched.select("doc_id", "row", "digest"), "rows")
    nodes = scratch.written(rows.groupBy("digest").agg(
        F.min("row").alias("node"), F.min(F.struct("doc_id", "row")).alias("low"), F.count("*").alias("copies")), "nodes")
    one = sketched.select(F.col("row").alias("node"), "sketches").join(nodes.select("node"), "node")
    flat = scratch.written(one.where("sketches is not null").select("node", F.explode("sketches").alias("v")), "buckets")
    shared = flat.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
    keys = scratch.written(flat.join(shared, "v"), "keys")
    live = scratch.written(keys.select("node").distinct().join(nodes.select("node", "digest"), "node"), "live")
    bits = scratch.written(sketched.select(F.col("row").alias("node"), "n", "wide", *SIGNS).join(live.select("node"), "node"), "bits")
    scratch.drop("sketches", "buckets")

    once = docs.select(F.col(text).alias("text")).mapInArrow(_worded, "digest binary, words binary").join(live, "digest")
    once = once.repartition("digest").mapInArrow(first_per_task("digest"), once.schema)
    texts = scratch.written(once.select("node", "words"), "texts")

    # Large groups first, at a pair per node, then a pair per two labels while that settles
    # much; what is left apart is compared pair by pair, so when this ends changes no class.
    links = verify(_possible(_leading_pairs(keys), bits, similarity), texts, similarity, scratch)
    anchors = links.select(F.col("b").alias("node"), F.col("a").alias("anchor"), "d")
    labels = components(links.select("a", "b"))
    mixed = _mixed(keys, labels, scratch)
    scratch.drop("keys")
    before, left = None, mixed.count()
    while left and (before is None or left < WORTH * before):
        more = verify(_possible(_label_pairs(mixed, scratch), bits, similarity), texts, similarity, scratch)
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components(links.select("a", "b"))
        mixed = _mixed(mixed, labels, scratch)
        before, left = left, mixed.count()
    crossed = verify(_crossing_pairs(mixed, anchors, bits, similarity, scratch), texts, similarity, scratch)
    labels = components(links.union(crossed).select("a", "b"))

    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = named.groupBy("label").agg(F.min("low").alias("first"), F.sum("copies").alias("class_size"))
    of_digest = written(named.select("digest", "label").join(groups, "label").select("digest", "first", "class_size"), "classes")
    scratch.drop()
    return rows.join(of_digest, "digest").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "digest")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each class, all their columns."""
    keep = written(classes(docs, similarity, doc_id, text).where("kept").select("digest"), "kept")
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values())
    at = list(names).index(text)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light_pieces(batches, at):
            found = [node_digest(t, words_of(t)) for t in utf8(batch.column(at))]
            yield batch.append_column("digest", pa.array(found, pa.binary()))

    schema = T.StructType([*plain.schema.fields, T.StructField("digest", T.BinaryType())])
    left = plain.mapInArrow(digested, schema).join(keep, "digest", "left_semi")
    order = Window.partitionBy("digest").orderBy(F.col(names[doc_id]).asc_nulls_first())
    top = left.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return top.select(*[F.col(v).alias(k) for k, v in names.items()])
