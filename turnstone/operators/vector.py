"""Nearest chunks by cosine similarity for a whole table of queries.

The query vectors travel to the chunks, never the other way round. Each task
keeps the best ``k`` per query while it streams its chunk batches, so a task
emits at most ``k`` rows per query however many chunks it reads, and the only
shuffle carries those.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import text as tx
from turnstone.settings import DEFAULTS, Settings

SUB_BATCH = 2048
PARTS = 64  # of a query's candidates, ranked apart before they meet
DIGITS = 9  # similarities are compared at this precision, ties go to the lower id


class QueryBlock:
    """Unit query vectors and their filters as arrays."""

    def __init__(self, ids, vectors, guests, since, until):
        self.ids = list(ids)
        self.q = _unit(vectors)
        self.guests, self.since, self.until = list(guests), list(since), list(until)
        self.filtered = any(x is not None for x in (*self.guests, *self.since, *self.until))

    @classmethod
    def from_arrow(cls, t) -> QueryBlock:
        col = {n: t.column(n).to_pylist() for n in ("query_id", "guest", "since", "until")}
        return cls(col["query_id"], _matrix(t.column("vector")), col["guest"], col["since"],
                   col["until"])

    def allowed(self, guest: pa.Array, day: np.ndarray) -> np.ndarray:
        """Boolean (rows, queries): may this query return this row? Guests are
        compared once per distinct value in the batch."""
        codes = guest.dictionary_encode()
        names = codes.dictionary.to_pylist()
        by_name = np.array([[g is None or g in name for g in self.guests] for name in names],
                           dtype=bool).reshape(len(names), len(self.guests))
        code = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ok = np.where((code >= 0)[:, None], by_name[code] if names else False,
                      np.array([g is None for g in self.guests])[None, :])
        for j, (a, b) in enumerate(zip(self.since, self.until, strict=True)):
            if a is not None:
                ok[:, j] &= day >= a
            if b is not None:
                ok[:, j] &= day <= b  # an undated row is NaN and fails both
        return ok


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == 0:
        return np.zeros((0, 0))
    if values.size % len(flat):
        raise ValueError("vectors differ in dimension")
    return values.reshape(len(flat), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class TopK:
    """Best ``k`` (similarity, id) per query over everything offered so far."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.sims = [np.empty(0)] * n_queries
        self.ids = [np.empty(0, dtype=object)] * n_queries
        self.floor = np.full(n_queries, -np.inf)

    def offer(self, j: int, sims: np.ndarray, ids: np.ndarray) -> None:
        near = sims >= self.floor[j]
        if not near.any():
            return
        s = np.concatenate([self.sims[j], sims[near]])
        i = np.concatenate([self.ids[j], ids[near]])
        if len(s) > self.k:
            cut = np.partition(s, len(s) - self.k)[len(s) - self.k]
            above, level = np.flatnonzero(s > cut), np.flatnonzero(s == cut)
            level = level[np.argsort(i[level], kind="stable")][: self.k - len(above)]
            keep = np.concatenate([above, level])
            s, i = s[keep], i[keep]
            self.floor[j] = cut
        self.sims[j], self.ids[j] = s, i

    def offer_batch(self, ids: np.ndarray, scores: np.ndarray, ok: np.ndarray | None,
                    columns: np.ndarray | None = None) -> None:
        """Cuts the whole matrix at the floors and at the batch's own k-th best, and
        goes into the queries that have rows left only."""
        floor = self.floor if columns is None else self.floor[columns]
        good = scores >= floor
        if ok is not None:
            good &= ok
        if scores.shape[0] > self.k:
            cut = np.partition(np.where(good, scores, -np.inf), -self.k, axis=0)[-self.k]
            good &= scores >= cut
        for pos in np.flatnonzero(good.any(axis=0)):
            rows = good[:, pos]
            self.offer(int(pos) if columns is None else int(columns[pos]), scores[rows, pos], ids[rows])

    def table(self, query_ids, schema: pa.Schema) -> pa.RecordBatch:
        q = [qid for qid, s in zip(query_ids, self.sims, strict=True) for _ in s]
        ids = [x for i in self.ids for x in i.tolist()]
        sims = np.concatenate([np.empty(0), *self.sims])
        return pa.RecordBatch.from_arrays(
            [pa.array(q, schema.field(0).type), pa.array(ids, schema.field(1).type),
             pa.array(sims, pa.float64())], schema=schema)


def _scan(batches, block: QueryBlock, k: int, best: TopK | None = None) -> TopK:
    best = best or TopK(len(block.ids), k)
    for batch in batches:
        for start in range(0, batch.num_rows, SUB_BATCH):
            part = batch.slice(start, SUB_BATCH)
            m = _unit(_matrix(part.column("embedding")))
            if m.shape[1] != block.q.shape[1]:
                raise ValueError("query and chunk vectors differ in dimension")
            ids = np.array(part.column("chunk_id").to_pylist(), dtype=object)
            ok = None
            if block.filtered:
                day = part.column("day").cast(pa.float64()).fill_null(np.nan)
                ok = block.allowed(_array(part.column("guest_key")),
                                   day.to_numpy(zero_copy_only=False))
            if "list_no" in part.schema.names:
                _offer_probed(best, block, m, ids, ok, part)
            else:
                best.offer_batch(ids, np.round(m @ block.q.T, DIGITS), ok)
    return best


def _offer_probed(best, block, m, ids, ok, part) -> None:
    """Score a row only against the queries that probe its list."""
    lists = part.column("list_no").to_numpy(zero_copy_only=False)
    for number in np.unique(lists):
        asking = block.by_list.get(int(number))
        if asking is None:
            continue
        rows = lists == number
        scores = np.round(m[rows] @ block.q[asking].T, DIGITS)
        best.offer_batch(ids[rows], scores, None if ok is None else ok[rows][:, asking], asking)


def _array(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def searchable(chunks: DataFrame) -> DataFrame:
    """Advertisements and chunks without a vector are never candidates."""
    kept = chunks.where(F.col("embedding").isNotNull())
    return kept.where(~F.col("is_sponsor")) if "is_sponsor" in chunks.columns else kept


def with_filters(queries: DataFrame) -> DataFrame:
    """The filter columns, as nulls where the table has none."""
    for name, kind in (("guest", "string"), ("since", "date"), ("until", "date")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None).cast(kind))
    return queries


def days(c) -> F.Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def _packed_queries(queries: DataFrame) -> DataFrame:
    q = with_filters(queries)
    guest = F.nullif(F.lower(tx.strip(F.col("guest"))), F.lit(""))
    return q.where(F.col("vector").isNotNull()).select(
        "query_id", "vector", guest.alias("guest"), days("since").alias("since"),
        days("until").alias("until"))


def _candidates(chunks: DataFrame, filtered: bool, extra=()) -> DataFrame:
    cols = ["chunk_id", "embedding", *extra]
    if filtered:
        cols += [F.lower("guest").alias("guest_key"), days("publish_date").alias("day")]
    return searchable(chunks).select(*cols)


def _arrow_schema(out: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(out)


def nearest(queries: DataFrame, chunks: DataFrame, k: int | None = None,
            settings: Settings = DEFAULTS, filtered: bool | None = None) -> DataFrame:
    """Exact ``k`` best chunks per query: ``query_id, chunk_id, similarity, rank``.

    ``chunks`` needs ``guest`` and ``publish_date`` when any query is filtered; a
    filter narrows the candidates before the cut. Queries are shipped to every
    task in blocks of bounded size; more than one block means one scan of the
    chunks each, with nothing replicated or shuffled but the best rows.
    """
    k = k or settings.pool
    packed = _packed_queries(queries)
    if filtered is None:
        filtered = {"guest", "publish_date"} <= set(chunks.columns)
    if not filtered:
        none = [F.lit(None).cast(t).alias(n)
                for n, t in (("guest", "string"), ("since", "int"), ("until", "int"))]
        packed = packed.select("query_id", "vector", *none)
    out = T.StructType([
        T.StructField("query_id", packed.schema["query_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("similarity", T.DoubleType())])
    candidates = _candidates(chunks, filtered)
    scans = [_scan_with_broadcast(candidates, QueryBlock.from_arrow(b), k, out)
             for b in _blocks(packed, settings)]
    return ranked(reduce(DataFrame.unionByName, scans), k)


def _blocks(packed: DataFrame, settings: Settings):
    """The queries as Arrow tables of about ``query_rows`` rows at most, fewer where
    vectors are long; one empty table if there are none."""
    seen = packed.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    rows = max(1, min(settings.query_rows, settings.broadcast_bytes // (16 * (seen.dim or 1))))
    n = max(1, -(-seen.n // rows))
    for i in range(n):
        yield (packed if n == 1 else packed.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toArrow()


def _scan_with_broadcast(candidates: DataFrame, block: QueryBlock, k: int,
                         out: T.StructType) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast(block)
    schema = _arrow_schema(out)

    def scan(batches):
        b = shared.value
        if b.ids:
            yield _scan(batches, b, k).table(b.ids, schema)

    return candidates.mapInArrow(scan, out)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Every scan task offers ``k`` rows per query; parts of them are cut first, so
    that ``PARTS * k`` rows of a query meet at most."""
    best = [F.desc("similarity"), F.asc("chunk_id")]
    apart = Window.partitionBy("query_id", "_part").orderBy(*best)
    some = found.withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS))).withColumn(
        "_rank", F.row_number().over(apart)).where(F.col("_rank") <= k).drop("_part", "_rank")
    w = Window.partitionBy("query_id").orderBy(*best)
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- approximate search: coarse lists -------------------------------------------------

def train_lists(chunks: DataFrame, n_lists: int, seed: int = 7) -> np.ndarray:
    """Centres of ``n_lists`` coarse lists, by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = searchable(chunks).select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n_lists, seed=seed, distanceMeasure="cosine", maxIter=10).fit(rows)
    return np.vstack(model.clusterCenters())


def assign_lists(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """``chunks`` with ``list_no``; store the table partitioned by it."""
    unit = _unit(np.asarray(centres, dtype=np.float64))
    shared = chunks.sparkSession.sparkContext.broadcast(unit)

    @F.pandas_udf("int")
    def closest(vectors):
        import pandas as pd

        m = _unit(np.stack(vectors.to_numpy()).astype(np.float64))
        return pd.Series((m @ shared.value.T).argmax(axis=1).astype("int32"))

    return searchable(chunks).withColumn("list_no", closest("embedding"))


def nearest_probed(queries: DataFrame, listed: DataFrame, centres: np.ndarray, probes: int,
                   k: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Approximate ``nearest`` over unfiltered queries: every query looks into
    its ``probes`` closest lists only. With all lists probed it is exact."""
    k = k or settings.pool
    packed = _packed_queries(queries).select(
        "query_id", "vector", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("guest", "string"), ("since", "int"), ("until", "int"))])
    out = T.StructType([
        T.StructField("query_id", packed.schema["query_id"].dataType),
        T.StructField("chunk_id", listed.schema["chunk_id"].dataType),
        T.StructField("similarity", T.DoubleType())])
    scans = []
    for head in _blocks(packed, settings):
        block = QueryBlock.from_arrow(head)
        near = np.zeros((0, 0), int)
        if block.ids:
            near = np.argsort(-(block.q @ _unit(np.asarray(centres)).T), axis=1)[:, :probes]
        block.by_list = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        rows = _candidates(listed.where(F.col("list_no").isin(sorted(block.by_list))), False, ["list_no"])
        scans.append(_scan_with_broadcast(rows, block, k, out))
    return ranked(reduce(DataFrame.unionByName, scans), k)
