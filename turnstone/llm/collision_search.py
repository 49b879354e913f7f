"""Nearest neighbours by collision counting over single projections.

Every vector is projected on ``PROJECTIONS`` random directions. The index holds the vectors
in blocks of bounded size; within a block each projection is one sorted array. A query opens
a window around its own value in every array. Virtual rehashing widens all windows together:
at search radius r a window reaches ``WIDTH`` times r to both sides, and only the two new
flanks are counted. A vector met in at least ``threshold`` windows is verified, that is, its
distance is computed on the original vectors. The search of a block ends when the k-th best
distance is within the radius: a vector within r of the query lies in a window with the
probability that a normal value stays under ``WIDTH``, and ``threshold`` is the count which
it misses with probability ``MISS`` at most. No limit on candidates ends a search.

Blocks, and not one array over all vectors, because a block's search is one task's work: the
index is made without a shuffle, and the best distances so far narrow the later blocks.

Queries travel to the index in blocks of bounded bytes, one at a time; every task keeps k
rows for each query, which are written before the next query block is sent.

Defined results: vectors that are null, empty, zero or hold a null, NaN or infinite
component take no part, on either side. A query meets vectors of its own dimension only.
Rows that repeat are rows of their own; a row with the query's own id is never its
neighbour. A null id asks nothing and can be found. Equal distances go to the smaller id,
null first. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstone.llm.common import remove, shared_path, written
from turnstone.llm.vectors import finite, struct

PROJECTIONS = 128
WIDTH = 1.5      # half a window, in search radii
MISS = 0.05      # chance that a vector within the radius stays under the threshold
GROWTH = 1.25    # of the radius from one round to the next
BLOCK = 8_192    # vectors of an index block; positions fit 16 bits
SEEDS = 256      # vectors of a task's first block that are verified at once, for a first radius
QUERY_BYTES = 8 << 20  # of query vectors sent at once


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Random rotations of the space, stacked: each row one direction, scaled so that the
    projection of a difference of length s is about normal with deviation s."""
    draw = np.random.default_rng(dim)
    turns = [np.linalg.qr(draw.standard_normal((dim, dim)))[0] for _ in range(-(-projections // dim))]
    return np.vstack(turns)[:projections] * sqrt(dim)


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The most windows that a vector within the radius is in with probability 1 - miss."""
    p = erf(width / sqrt(2))
    below, count = 0.0, 0
    while count < projections:
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            break
        count += 1
    return max(1, count)


INDEX = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()),
                   ("wide", pa.bool_()), ("orders", pa.binary())])


def index(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index table, one row per block: ids, vectors, and for each projection the
    positions of the block's vectors in ascending order. Map-only; written."""
    wide = "double" in embeddings.schema[vector_col].dataType.simpleString()
    source = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))

    def build(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False) if not batch.column("id").null_count else np.array(
                batch.column("id").to_pylist(), dtype=object)
            for rows, matrix in finite(batch.column("v")):
                some = matrix.any(axis=1)
                queue = waiting.setdefault(matrix.shape[1], [])
                queue.append((ids[rows[some]].astype(object), matrix[some]))
                while sum(len(i) for i, _ in queue) >= BLOCK:
                    yield _flush(queue, wide, BLOCK)
        for queue in waiting.values():
            if sum(len(i) for i, _ in queue):
                yield _flush(queue, wide, BLOCK)

    return written(source.mapInArrow(build, struct(INDEX)), "collision-index")


def _flush(queue: list, wide: bool, size: int) -> pa.RecordBatch:
    ids, matrix = np.concatenate([i for i, _ in queue]), np.vstack([m for _, m in queue])
    queue[:] = [(ids[size:], matrix[size:])] if len(ids) > size else []
    ids, matrix = ids[:size], matrix[:size]
    with np.errstate(all="ignore"):
        orders = np.argsort(directions(matrix.shape[1]) @ matrix.T, axis=1, kind="stable").astype(np.uint16)
    kept = matrix if wide else matrix.astype(np.float32)
    values = [matrix.shape[1], len(ids), ids.tolist(), kept.tobytes(), wide, orders.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, INDEX)], schema=INDEX)


class Best:
    """The k nearest of one query so far, by distance and then id."""

    __slots__ = ("k", "far", "ids")

    def __init__(self, k: int):
        self.k, self.far, self.ids = k, np.empty(0), np.empty(0, np.int64)

    def limit(self) -> float:
        return self.far[self.k - 1] if len(self.far) >= self.k else np.inf

    def offer(self, far: np.ndarray, ids: np.ndarray) -> None:
        near = far <= self.limit()
        if near.any():
            far, ids = np.concatenate([self.far, far[near]]), np.concatenate([self.ids, ids[near]])
            first = np.lexsort((ids, far))[: self.k]
            self.far, self.ids = far[first], ids[first]


NULL_ID = np.iinfo(np.int64).min  # stands for a null id inside a task; sorts first


class Block:
    """One index block, opened: vectors, sorted projections and the order they are in."""

    def __init__(self, row: dict, axes: np.ndarray):
        n, dim = row["n"], row["dim"]
        self.ids = np.array([NULL_ID if i is None else i for i in row["ids"]], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.float64 if row["wide"] else np.float32).reshape(n, dim).astype(np.float64)
        self.orders = np.frombuffer(row["orders"], np.uint16).reshape(len(axes), n)
        with np.errstate(all="ignore"):
            self.sorted = np.take_along_axis(axes @ self.vectors.T, self.orders.astype(np.int64), axis=1)
        self.plain = not np.isfinite(self.sorted).all()  # projections overflow: every vector is verified

    def verify(self, query: np.ndarray, own: int, at: np.ndarray, best: Best) -> None:
        at = at[self.ids[at] != own]
        with np.errstate(all="ignore"):
            far = np.sqrt(((self.vectors[at] - query) ** 2).sum(axis=1))
        best.offer(far, self.ids[at])

    def search(self, query: np.ndarray, value: np.ndarray, own: int, best: Best, need: int) -> int:
        """Offers ``best`` what this block has; returns how many vectors were verified."""
        n = len(self.ids)
        if self.plain or not np.isfinite(value).all() or n <= SEEDS:
            self.verify(query, own, np.arange(n), best)
            return n
        met = np.zeros(n, np.int64)
        done = np.zeros(n, bool)
        if best.limit() == np.inf:
            done[:max(SEEDS, 2 * best.k)] = True
            self.verify(query, own, np.flatnonzero(done), best)
            if best.limit() == np.inf:
                self.verify(query, own, np.flatnonzero(~done), best)
                return n
        slack = 1e-9 * max(1e-300, np.abs(self.sorted).max())  # equal vectors may differ in the last digit of a projection
        radius = best.limit() / 2
        left = right = [int(i) for i in map(np.searchsorted, self.sorted, value)]
        while True:
            half = WIDTH * radius + slack
            lo = [a.searchsorted(v - half, "left") for a, v in zip(self.sorted, value)]
            hi = [a.searchsorted(v + half, "right") for a, v in zip(self.sorted, value)]
            flanks = [o[a:b] for o, a, b in zip(self.orders, lo, left)] + [o[a:b] for o, a, b in zip(self.orders, right, hi)]
            met += np.bincount(np.concatenate(flanks), minlength=n)
            left, right = lo, hi
            new = (met >= need) & ~done
            if new.any():
                done |= new
                self.verify(query, own, np.flatnonzero(new), best)
            if best.limit() <= radius:
                return int(done.sum())
            radius = min(radius * GROWTH, best.limit())


FOUND = pa.schema([("query_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("verified", pa.int64())])


def search(embeddings: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row where ``queries`` holds, its ``k``
    nearest among all other rows. See the module's text for odd rows."""
    spark = embeddings.sparkSession
    indexed = index(embeddings, id_col, vector_col)
    asked = written(embeddings.where(queries & F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("query_no"), F.col(id_col).cast("long").alias("query_id"),
        F.col(vector_col).alias("v")), "queries")
    found = candidates(indexed, asked, k)
    order = Window.partitionBy("query_no").orderBy("score", F.col("vec_id").asc_nulls_first())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("query_no", "query_id"), "query_no").select("query_id", "rank", "vec_id", "score")


def candidates(indexed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_no, vec_id, score, verified``: the ``k`` best of each index task for each
    query. One query block at a time is fetched, broadcast, searched and written."""
    spark = indexed.sparkSession
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    parts = max(1, -(-size.n * max(1, size.dim or 0) * 8 // QUERY_BYTES))
    path = shared_path(spark, "found")
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("query_no"), F.lit(parts)) == part).toArrow()
        shared = spark.sparkContext.broadcast(_opened(block))
        indexed.mapInArrow(lambda rows, shared=shared: _answers(rows, shared.value, k), struct(FOUND)).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(struct(FOUND)).parquet(path)


def _opened(block: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The queries by dimension: numbers, ids, vectors."""
    if not block.num_rows:
        return []
    whole = block.combine_chunks().to_batches()[0]
    no, ids = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("query_no", "query_id"))
    out = []
    for rows, matrix in finite(whole.column("v")):
        some = matrix.any(axis=1)
        out.append((no[rows[some]], ids[rows[some]], matrix[some]))
    return out


def _answers(batches, queries, k):
    best = {m.shape[1]: [Best(k) for _ in no] for no, _, m in queries}
    looked = {m.shape[1]: np.zeros(len(no), np.int64) for no, _, m in queries}
    by_dim = {m.shape[1]: (no, ids, m, directions(m.shape[1])) for no, ids, m in queries}
    need = threshold()
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["dim"] not in by_dim:
                continue
            _, ids, matrix, axes = by_dim[row["dim"]]
            block = Block(row, axes)
            with np.errstate(all="ignore"):
                values = matrix @ axes.T
            for i, one in enumerate(best[row["dim"]]):
                looked[row["dim"]][i] += block.search(matrix[i], values[i], ids[i], one, need)
    for dim, kept in best.items():
        no = by_dim[dim][0]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(no, [len(b.ids) for b in kept]), pa.int64()),
            pa.array([None if i == NULL_ID else int(i) for b in kept for i in b.ids], pa.int64()),
            pa.array(np.concatenate([np.empty(0), *(b.far for b in kept)]), pa.float64()),
            pa.array(np.repeat(looked[dim], [len(b.ids) for b in kept]), pa.int64())], schema=FOUND)
