"""Keyword search on a stored index of positional posting lists.

Chunks are dealt into slices of bounded size by a hash of their id. In a slice chunks are
numbered by length, and every stem has blocks of up to ``BLOCK`` postings: chunk numbers as
differences, counts, lengths, and word positions as differences, in as few bytes as they
need. Beside its packed columns a block has its first and last chunk number, which let a
reader skip it, and the pairs of count and length that no other posting of the block beats,
which give the best score it can hold under any corpus average. The table lies in folders
by hashed stem, so a search reads only the folders of its stems.

A search brings the blocks of its stems together per slice and answers all queries there.
A query walks the blocks of its rarest stem, the most promising first; it skips a block
without partner blocks of every other stem, and stops where the best score still possible
is below its k-th. Chunks left are looked up in the other stems' blocks, of which only those
that can hold one of them are unpacked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.functions import stem
from turnstone.functions import search as fx
from turnstone.functions import text as tx
from turnstone.operators.bounds import broadcast_if_small
from turnstone.operators.tables import fresh_path, stored
from turnstone.operators.vector import with_filters
from turnstone.settings import DEFAULTS, Settings

BLOCK = 64         # postings of a block
SLICE = 8_192      # chunks of a slice, about
ORDER = ("length", "chunk_id", "same")  # of a slice's chunks; rows alike in all three have the same postings
BUCKETS = 64       # folders of the block table
DIGITS = 9
NEAR = 16          # a span of up to so many words counts as one whole hit
BLOCKS = ("segment string, slice int, term string, n int, lo int, hi int, best_tf array<int>, best_length array<int>, "
          "docs binary, counts binary, lengths binary, positions binary, term_bucket int")
DOCS = "segment string, slice int, doc int, chunk_id {kind}, episode_id {episode}, length int"


@dataclass(frozen=True)
class Index:
    """``blocks`` as above; ``docs`` with every chunk that can be found: its slice, number,
    id, episode and length. A chunk taken out of ``docs`` is not found any more; ``whole``
    says that none has been."""

    blocks: DataFrame
    docs: DataFrame
    whole: bool = True


def bucket(term="term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


# --- packed columns -------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the top bit set on all but a number's last byte: the bytes, and
    where each number starts, with the end behind."""
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << 7 * k)
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(start[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[start[:-1][has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, start


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """One packed value per stretch ``values[cuts[i]:cuts[i + 1]]``."""
    out, start = pack(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(start[cuts].astype(np.int32)), pa.py_buffer(out)])


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    last = raw < 128
    number = np.cumsum(last) - last  # which number each byte belongs to
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - first[number])
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, first)


# --- building -------------------------------------------------------------------------

def build(chunks: DataFrame, root: str, segment: str = "all") -> Index:
    """Writes the postings of ``chunks(chunk_id, episode_id, text[, is_sponsor])`` as one
    segment of the index under ``root``. Advertisements are left out."""
    spark = chunks.sparkSession
    kept = chunks.where(~F.col("is_sponsor")) if "is_sponsor" in chunks.columns else chunks
    n = kept.count()
    slices = max(1, -(-n // SLICE), min(spark.sparkContext.defaultParallelism, n // 512))
    bags = kept.select("chunk_id", "episode_id", F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int").alias("slice"),
                       tx.tokens(F.col("text")).alias("words"))
    bags = bags.withColumn("length", F.coalesce(F.size(F.filter("words", lambda w: ~w.isin(tx.STOP_WORDS))), F.lit(0)))
    # Words hold letters and digits only, so one text of them loses nothing and travels light.
    bags = bags.withColumn("words", F.array_join("words", " "))
    bags = stored(bags.withColumn("same", F.xxhash64("words")), "bags")  # read for the numbers, the words, the postings
    docs_path, blocks_path = f"{root}/docs/segment={segment}", f"{root}/blocks/segment={segment}"
    number = Window.partitionBy("slice").orderBy(*ORDER)
    bags.withColumn("doc", F.row_number().over(number) - 1).select(
        "slice", "doc", "chunk_id", "episode_id", "length").write.mode("overwrite").parquet(docs_path)

    said = bags.select("slice", F.explode(F.split("words", " ")).alias("term"))
    said = stored(said.where((F.col("term") != "") & ~F.col("term").isin(tx.STOP_WORDS)).distinct(), "said")
    stems = broadcast_if_small(stored(stem.with_stems(said.select("term").distinct()), "stems"))
    known = said.join(stems, "term").select("slice", "term", "stem")
    # Words meet once per slice; a posting is never a row.
    packed = bags.select("slice", *ORDER, "words").groupBy("slice").cogroup(known.groupBy("slice")).applyInArrow(
        _packed, "slice int, term string, n int, lo int, hi int, best_tf array<int>, best_length array<int>, "
                 "docs binary, counts binary, lengths binary, positions binary")
    files = min(64, max(1, slices // 16))  # of a folder, so that a stem found everywhere is not one huge file
    (packed.withColumn("term_bucket", bucket()).repartition("term_bucket", F.pmod(F.col("slice"), F.lit(files)))
     .sortWithinPartitions("term_bucket", "term", "slice").write.mode("overwrite").partitionBy("term_bucket").parquet(blocks_path))
    return read(spark, root)


def read(spark: SparkSession, root: str) -> Index:
    return Index(spark.read.schema(BLOCKS).option("basePath", f"{root}/blocks").parquet(f"{root}/blocks"),
                 spark.read.option("basePath", f"{root}/docs").parquet(f"{root}/docs"))


def _packed(bags: pa.Table, known: pa.Table) -> pa.Table:
    """Blocks of one slice: its words as numbers, ordered by stem, chunk and place."""
    order = pc.sort_indices(bags, sort_keys=[(c, "ascending") for c in ORDER], null_placement="at_start")
    bags = bags.take(order).combine_chunks()
    lists = pc.split_pattern(_whole(bags.column("words")), " ")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    stems = _whole(known.column("stem")).dictionary_encode()
    at = pc.index_in(words.dictionary, value_set=_whole(known.column("term")))  # stop words have none
    of_word = np.append(stems.indices.to_numpy(zero_copy_only=False), -1).astype(np.int64)[
        pc.fill_null(at, len(stems)).to_numpy(zero_copy_only=False)]
    code = of_word[words.indices.to_numpy(zero_copy_only=False)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(code >= 0)
    kept = kept[np.argsort(code[kept], kind="stable")]  # chunks and places are ascending already
    code, doc, place = code[kept], doc[kept], place[kept]
    # A posting is a stem in a chunk, with its places.
    starts = np.flatnonzero(_changes(code) | _changes(doc))
    ends, counts = np.append(starts[1:], len(code)), np.diff(np.append(starts, len(code)))
    steps = np.diff(place, prepend=0)
    steps[starts] = place[starts]
    code, doc = code[starts], doc[starts]
    length = bags.column("length").to_numpy().astype(np.int64)[doc]
    n = len(code)
    runs = np.flatnonzero(_changes(code))
    nth = np.arange(n) - np.repeat(runs, np.diff(np.append(runs, n)))
    first = np.flatnonzero(nth % BLOCK == 0)
    cuts = np.append(first, n)
    block = np.repeat(np.arange(len(first)), np.diff(cuts))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = 0
    tf, size, best = _unbeaten(block, counts, length)
    pairs = pa.array(np.searchsorted(best, np.arange(len(cuts))), pa.int32())
    number = bags.column("slice")[0].as_py() if len(sizes) else 0
    return pa.table([
        pa.array(np.full(len(first), number), pa.int32()), stems.dictionary.take(pa.array(code[first])), pa.array(np.diff(cuts), pa.int32()),
        pa.array(doc[first], pa.int32()), pa.array(doc[cuts[1:] - 1], pa.int32()),
        pa.ListArray.from_arrays(pairs, pa.array(tf, pa.int32())), pa.ListArray.from_arrays(pairs, pa.array(size, pa.int32())),
        _binary(gaps, cuts), _binary(counts, cuts), _binary(length, cuts), _binary(steps, np.append(0, ends)[cuts])], names=[
        "slice", "term", "n", "lo", "hi", "best_tf", "best_length", "docs", "counts", "lengths", "positions"])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.diff(values, prepend=-1) != 0


def _unbeaten(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per block the (count, length) pairs that no posting beats by a higher count in a
    shorter chunk, and the block of each pair."""
    order = np.lexsort((-tf, length, block))
    tf, length, block = tf[order], length[order], block[order]
    lifted = tf + block * (int(tf.max(initial=0)) + 1)  # so that a block's first posting tops all before
    best = lifted > np.concatenate([[-1], np.maximum.accumulate(lifted)[:-1]])
    return tf[best], length[best], block[best]


# --- searching ------------------------------------------------------------------------

@dataclass
class Lists:
    """A stem's blocks in one slice, by chunk number; unpacked when first needed."""

    lo: np.ndarray
    hi: np.ndarray
    bound: np.ndarray
    packed: list[tuple[bytes, bytes, bytes, bytes]]
    opened: dict[int, tuple] = field(default_factory=dict)

    def open(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.opened:
            docs, counts, lengths, _ = self.packed[i]
            self.opened[i] = (self.lo[i] + np.cumsum(unpack(docs)), unpack(counts), unpack(lengths))
        return self.opened[i]

    def positions(self, doc: int) -> np.ndarray:
        i = int(np.searchsorted(self.hi, doc))
        docs, counts, _ = self.open(i)
        steps, at = unpack(self.packed[i][3]), int(np.searchsorted(docs, doc))
        start = int(counts[:at].sum())
        return np.cumsum(steps[start:start + int(counts[at])])

    def meet(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ascending ``docs`` the stem has, and how often: a search for each
        chunk's block, then inside the blocks found."""
        block = np.searchsorted(self.hi, docs)
        inside = block < len(self.hi)
        inside[inside] = self.lo[block[inside]] <= docs[inside]
        found, counts = np.zeros(len(docs), bool), np.zeros(len(docs), np.int64)
        for i in np.unique(block[inside]):
            here = np.flatnonzero(inside & (block == i))
            own, tf, _ = self.open(int(i))
            at = np.minimum(np.searchsorted(own, docs[here]), len(own) - 1)
            hit = own[at] == docs[here]
            found[here[hit]], counts[here[hit]] = True, tf[at[hit]]
        return found, counts


def covers(positions: list[np.ndarray]) -> np.ndarray:
    """Lengths of the smallest spans that hold every stem: for each end the latest start
    that leaves none out, and for each start its first end."""
    ends = np.unique(np.concatenate(positions))
    last = [np.searchsorted(p, ends, side="right") - 1 for p in positions]
    whole = np.all([i >= 0 for i in last], axis=0)
    start = np.min([p[np.maximum(i, 0)] for p, i in zip(positions, last)], axis=0)[whole]
    start, first = np.unique(start, return_index=True)
    return ends[whole][first] - start + 1


def closeness(positions: list[np.ndarray]) -> float:
    """Cover density: every smallest span counts, a long one by how far it is over ``NEAR``."""
    return float(np.minimum(1.0, NEAR / covers(positions)).sum())


class Scorer:
    """BM25 under the statistics of the whole index, with an optional share for closeness."""

    def __init__(self, n: int, mean_length: float, settings: Settings):
        self.n, self.mean = n, mean_length or 1.0
        self.k1, self.b, self.close = settings.bm25_k1, settings.bm25_b, settings.closeness_weight

    def idf(self, df: int) -> float:
        """Chunks replaced since their segment was written still count in ``df``."""
        return float(np.log(1 + (max(self.n, df) - df + 0.5) / (df + 0.5)))

    def weight(self, tf, length):
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def raised(self, score, near):
        """Closeness in (0, 1) lifts a score by up to ``closeness_weight`` of it."""
        return score * (1 + self.close * near / (1 + near))


HITS = ["query_id", "chunk_id", "score", "closeness", "n_covers", "shortest", "scored"]


def _slice_hits(lists: dict[str, Lists], ids: list, alive: np.ndarray, queries, scorer: Scorer, k: int, spans: bool):
    """Rows of ``HITS`` for every query; with ``k`` 0 every match, else the best ``k``."""
    for query_id, terms, floor in queries:
        if any(t not in lists for t, _ in terms):
            continue
        mine = [lists[t] for t, _ in terms]
        weights = [w for _, w in terms]
        best, scored = _query_hits(mine, weights, alive, scorer, k, floor)
        rows = sorted(best, key=lambda r: (-r[0], ids[r[1]]))
        for score, doc in rows[:k] if k else rows:
            near = covers([m.positions(doc) for m in mine]) if spans else np.empty(0)
            yield (query_id, ids[doc], score, float(np.minimum(1.0, NEAR / near).sum()) if spans else None,
                   len(near), int(near.min()) if spans else None, scored)


def _query_hits(mine: list[Lists], weights: list[float], alive: np.ndarray, scorer: Scorer, k: int, least: float = -np.inf):
    rare, others = mine[0], mine[1:]
    top = weights[0] * rare.bound
    for other, weight in zip(others, weights[1:]):
        # The best that any block of the other stem, over the same chunk numbers, can add.
        a, b = np.searchsorted(other.hi, rare.lo), np.searchsorted(other.lo, rare.hi, side="right")
        top = top + np.array([weight * other.bound[x:y].max() if x < y else -np.inf for x, y in zip(a, b)])
    top = scorer.raised(top, np.inf) if scorer.close else top
    found, floor, scored = [], least, 0
    scores = np.empty(0)
    for i in np.argsort(-top, kind="stable"):
        if top[i] == -np.inf or top[i] < floor - 10.0**-DIGITS:
            break
        docs, tf, length = rare.open(int(i))
        keep = alive[docs]
        docs, length, parts = docs[keep], length[keep], [tf[keep]]
        for other in others:
            if not len(docs):
                break
            hit, counts = other.meet(docs)
            docs, length, parts = docs[hit], length[hit], [p[hit] for p in parts] + [counts[hit]]
        if not len(docs):
            continue
        scored += len(docs)
        score = sum(w * scorer.weight(p, length) for w, p in zip(weights, parts))
        if scorer.close:
            near = np.array([closeness([m.positions(int(d)) for m in mine]) for d in docs])
            score = scorer.raised(score, near)
        score = np.round(score, DIGITS)
        found.append((score, docs))
        if k:
            scores = np.concatenate([scores, score])
            if len(scores) >= k:
                scores = np.partition(scores, len(scores) - k)[len(scores) - k:]
                floor = max(least, scores[0])
    return [(float(s), int(d)) for score, docs in found for s, d in zip(score, docs) if s >= floor or not k], scored


def _open_lists(table: pa.Table, scorer: Scorer) -> dict[str, Lists]:
    table = table.sort_by([("term", "ascending"), ("lo", "ascending")]).combine_chunks()
    terms = table.column("term").to_pylist()
    lo, hi = (table.column(c).to_numpy() for c in ("lo", "hi"))
    bound = np.array([scorer.weight(np.array(tf), np.array(size)).max() for tf, size in zip(
        table.column("best_tf").to_pylist(), table.column("best_length").to_pylist())])
    packed = list(zip(*(table.column(c).to_pylist() for c in ("docs", "counts", "lengths", "positions"))))
    out, start = {}, 0
    for i in range(1, len(terms) + 1):
        if i == len(terms) or terms[i] != terms[start]:
            out[terms[start]] = Lists(lo[start:i], hi[start:i], bound[start:i], packed[start:i])
            start = i
    return out


def query_stems(queries: DataFrame) -> DataFrame:
    """``query_id, term``: the distinct stems of each query. One of stop words only has no
    rows and so matches nothing."""
    said = queries.select("query_id", F.explode(F.array_distinct(tx.terms(F.col("query")))).alias("word"))
    return stem.with_stems(said, "word").select("query_id", F.col("stem").alias("term")).distinct()


def wanted_blocks(index: Index, terms: list[tuple[str, int]]) -> DataFrame:
    """The blocks of the given stems (with their folders): nothing else is read. The stems
    are those of one query block, so their number is bounded."""
    few = index.blocks.sparkSession.createDataFrame([(t,) for t, _ in terms], "term string")
    return index.blocks.where(F.col("term_bucket").isin(sorted({b for _, b in terms}))).join(F.broadcast(few), "term", "left_semi")


def search(queries: DataFrame, index: Index, k: int = 0, settings: Settings = DEFAULTS, spans: bool = False) -> DataFrame:
    """Chunks that hold all stems of a query: ``query_id, chunk_id, score, closeness,
    n_covers, shortest, scored``. With ``k`` each slice gives its best ``k`` (``scored`` says
    for how many chunks it computed a score), else every match comes back. Queries go in
    blocks of bounded size, each written before the next is fetched."""
    spark = queries.sparkSession
    asked = stored(query_stems(queries).withColumn("bucket", bucket()), "asked")
    seen = index.docs.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    scorer = Scorer(seen.n, seen.mean, settings)
    kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "chunk_id": index.docs.schema["chunk_id"].dataType.simpleString()}
    out = (f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double, closeness double, n_covers int, "
           "shortest int, scored int")
    schema = spark.createDataFrame([], out).schema
    parts = max(1, -(-asked.count() // (8 * settings.query_rows)))
    path = fresh_path(spark, "hits")
    for part in range(parts):
        rows = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).collect()
        blocks = wanted_blocks(index, sorted({(r.term, r.bucket) for r in rows}))
        df = {r.term: r.df for r in blocks.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        said: dict = {}
        for r in rows:
            said.setdefault(r.query_id, []).append((df.get(r.term, 0), r.term))
        # Rarest stem first; one that no chunk has ends its query here.
        alone = {terms[0][1] for terms in said.values() if len(terms) == 1 and df.get(terms[0][1])}
        floors = _floors(blocks, alone, df, scorer, k) if k and index.whole and alone and not scorer.close else {}
        shared = spark.sparkContext.broadcast([
            (q, [(t, scorer.idf(n)) for n, t in sorted(terms)], floors.get(terms[0][1], -np.inf) if len(terms) == 1 else -np.inf)
            for q, terms in said.items() if min(terms)[0]])
        docs = index.docs.select("segment", "slice", "doc", "chunk_id")
        hits = blocks.groupBy("segment", "slice").cogroup(docs.groupBy("segment", "slice")).applyInArrow(
            _answers(shared, scorer, k, spans, schema), schema)
        hits.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _floors(blocks: DataFrame, terms: set[str], df: dict[str, int], scorer: Scorer, k: int) -> dict[str, float]:
    """For queries of one stem: a score that ``k`` chunks reach for certain, since every pair
    a block puts forward is one chunk's. Known before any block is unpacked, in all slices."""
    pair = F.explode(F.arrays_zip("best_tf", "best_length")).alias("p")
    tf, length = F.col("p.best_tf").cast("double"), F.col("p.best_length")
    weight = tf * (scorer.k1 + 1) / (tf + scorer.k1 * (1 - scorer.b + scorer.b * length / scorer.mean))
    few = blocks.where(F.col("term").isin(sorted(terms))).select("term", pair).select("term", weight.alias("w"))
    kth = few.withColumn("_nth", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("w")))).where(F.col("_nth") <= k)
    rows = kth.where(F.col("_nth") == k).select("term", "w").collect()  # a row per query term at most
    return {r.term: scorer.idf(df[r.term]) * r.w - 2 * 10.0**-DIGITS for r in rows}


def _answers(shared, scorer, k, spans, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def answer(blocks: pa.Table, docs: pa.Table) -> pa.Table:
        if not blocks.num_rows or not docs.num_rows:
            return arrow.empty_table()
        number = docs.column("doc").to_numpy()
        size = max(int(number.max()), int(blocks.column("hi").to_numpy().max())) + 1
        alive, ids = np.zeros(size, bool), [None] * size
        alive[number] = True
        for i, c in zip(number.tolist(), docs.column("chunk_id").to_pylist()):
            ids[i] = c
        rows = list(_slice_hits(_open_lists(blocks, scorer), ids, alive, shared.value, scorer, k, spans))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow) if rows else arrow.empty_table()

    return answer


def ranked(queries: DataFrame, index: Index, episodes: DataFrame | None = None, pool: int | None = None,
           settings: Settings = DEFAULTS) -> DataFrame:
    """The best ``pool`` matches per query: ``query_id, chunk_id, score, rank``. With
    ``episodes`` the query filters apply before the cut."""
    pool = pool or settings.pool
    if episodes is None:
        found = search(queries, index, pool, settings)
    else:
        found = _filtered(search(queries, index, 0, settings), queries, index, episodes, settings)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return found.select("query_id", "chunk_id", "score").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= pool)


def _filtered(found, queries, index, episodes, settings) -> DataFrame:
    """The matches are the small side: they find their episodes."""
    limits = with_filters(queries).select("query_id", "guest", "since", "until")
    placed = index.docs.select("chunk_id", "episode_id").join(broadcast_if_small(found, settings), "chunk_id")
    described = broadcast_if_small(stored(placed, "placed"), settings).join(
        episodes.select("episode_id", F.col("guest").alias("_guest"), F.col("publish_date").alias("_date")), "episode_id")
    keep = fx.passes_filter(F.col("_guest"), F.col("_date"), F.nullif(tx.strip(F.col("guest")), F.lit("")), F.col("since"), F.col("until"))
    return described.join(limits, "query_id").where(keep)
