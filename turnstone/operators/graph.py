"""A navigable graph over chunk vectors: built once, stored as tables, searched by joins.

Nodes are distinct vectors; copies hang from their node in a table of members, so a large
group of equal chunks is one node. A layer's graph starts from blocks of nodes that several
random directions put next to each other, and is improved by local joins: the neighbours of
a node are compared with each other (NN-descent). Edges are then pruned, so that a neighbour
stays only if it is nearer to the node than to every neighbour kept before it, and made
mutual. Layer 0 has all nodes, each further layer a hashed 1/``shrink`` of the one below,
until a layer is small enough to be scored whole as the place where a search begins.

A search is a table of scored (query, node) rows. In each round every query's best ``width``
rows that have not been followed yet meet the edge table, the nodes found there meet the
vector table, and the new rows are scored; it ends when no query has a row left to follow.
Every step is an equi-join on node or query, so neither vectors nor edges pass the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstone.operators.tables import stored
from turnstone.operators.vector import DIGITS, _matrix, _unit, ranked, searchable
from turnstone.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Shape:
    degree: int = 16      # neighbours kept when pruning; twice as many once edges are mutual
    lists: int = 32       # nearest nodes a node remembers while the graph is built
    sorts: int = 4        # random directions that nodes are first sorted by
    descents: int = 3     # rounds of local joins
    offers: int = 6       # nodes that one local join proposes to each of its members
    block: int = 1024     # nodes compared with each other after a sort
    shrink: int = 32      # a layer has this many times fewer nodes than the one below
    top: int = 256        # nodes of the top layer at most: they are sent to every task
    seed: int = 7


@dataclass(frozen=True)
class Graph:
    """``members(node, chunk_id)``, ``vectors(node, vec)``, per layer ``edges(node,
    neighbours)``, and the top layer's vectors."""

    members: DataFrame
    vectors: DataFrame
    edges: list[DataFrame]
    top: DataFrame


EDGES = "node long, other long, sim float"


def _layer(number: int, shape: Shape):
    """The nodes of a layer: fixed by the node's hash, each layer inside the one below."""
    return F.pmod(F.xxhash64("node", F.lit(shape.seed)), F.lit(shape.shrink**number)) == 0


def build(chunks: DataFrame, path: str, shape: Shape = Shape()) -> Graph:
    """Builds and writes the graph of ``chunks(chunk_id, embedding)`` under ``path``."""
    spark = chunks.sparkSession
    ensure_checkpoint_dir(spark)
    found = searchable(chunks).select("chunk_id", F.col("embedding").cast("array<float>").alias("vec"))
    distinct = found.groupBy("vec").agg(F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("node"), "vec")
    distinct.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    found.join(vectors, "vec").select("node", "chunk_id").write.mode("overwrite").parquet(f"{path}/members")
    layer, number = vectors, 0
    while (n := layer.count()) > shape.top:
        _edges(layer, n, shape).write.mode("overwrite").parquet(f"{path}/layer={number}")
        number += 1
        layer = vectors.where(_layer(number, shape))
    if n == 0 and number:  # no node of a small layer was drawn into the next
        layer = vectors.where(_layer(number - 1, shape)).orderBy("node").limit(shape.top)
    layer.write.mode("overwrite").parquet(f"{path}/top")
    spark.createDataFrame([(number,)], "layers int").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Graph:
    layers = spark.read.parquet(f"{path}/shape").first().layers
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return Graph(table("members"), table("vectors"), [table(f"layer={i}") for i in range(layers)], table("top"))


# --- building -------------------------------------------------------------------------

def _edges(nodes: DataFrame, n: int, shape: Shape) -> DataFrame:
    near, whole = None, n <= 2 * shape.block  # then one block compares everything
    for turn in range(1 if whole else shape.sorts):
        made = _sorted_blocks(nodes, n, turn, shape)
        near = made if near is None else near.unionByName(made)
    near = stored(_best(near, shape.lists), "near")
    for _ in range(0 if whole else shape.descents):
        near = stored(_best(near.unionByName(_local_joins(near, nodes, shape)), shape.lists), "near")
    kept = stored(_pruned(near, nodes, shape), "kept")
    back = kept.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim")
    both = _best(kept.unionByName(back), 2 * shape.degree)
    return both.groupBy("node").agg(F.collect_list("other").alias("neighbours"))


def _best(near: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar of each node, each once. Offers of a node are few: the number
    of sorts and neighbours bounds them, not the corpus."""
    w = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return near.groupBy("node", "other").agg(F.max("sim").alias("sim")).withColumn(
        "_nth", F.row_number().over(w)).where(F.col("_nth") <= k).drop("_nth")


def _sorted_blocks(nodes: DataFrame, n: int, turn: int, shape: Shape) -> DataFrame:
    """Nodes sorted along a random direction; each is compared with its block."""

    def place(batches):
        for batch in batches:
            m = _matrix(batch.column("vec"))
            line = np.random.default_rng((shape.seed, turn, m.shape[1])).standard_normal(m.shape[1])
            yield batch.append_column("at", pa.array(_unit(m) @ line, pa.float64()))

    def compare(batches):
        ids, rows = [], []

        def flush(size):
            node, m = np.concatenate(ids), np.vstack(rows)
            ids[:], rows[:] = ([node[size:]], [m[size:]]) if len(node) > size else ([], [])
            return _neighbours(node[:size], m[:size], shape.lists)

        for batch in batches:
            ids.append(batch.column("node").to_numpy(zero_copy_only=False))
            rows.append(_unit(_matrix(batch.column("vec"))))
            while sum(map(len, ids)) >= 2 * shape.block:
                yield flush(shape.block)
        if sum(map(len, ids)):
            yield flush(2 * shape.block)

    placed = nodes.select("node", "vec").mapInArrow(place, "node long, vec array<float>, at double")
    parts = max(1, n // (8 * shape.block))
    return placed.repartitionByRange(parts, "at", "node").sortWithinPartitions("at", "node").mapInArrow(compare, EDGES)


def _neighbours(node: np.ndarray, m: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` best partners of every row among all rows."""
    sims = (m @ m.T).astype(np.float32)
    np.fill_diagonal(sims, -np.inf)
    k = min(k, len(node) - 1)
    if k <= 0:
        return _edge_batch(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return _edge_batch(np.repeat(node, k), node[best].ravel(), np.take_along_axis(sims, best, axis=1).ravel())


def _edge_batch(node, other, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float32())],
                                      names=["node", "other", "sim"])


def _with_vectors(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per node: its neighbours with their vectors, ``lists`` times two at most."""
    far = nodes.select(F.col("node").alias("other"), "vec")
    return near.join(far, "other").groupBy("node").agg(F.collect_list(F.struct("other", "sim", "vec")).alias("around"))


def _each_around(batches):
    """Per node: its id, the ids, similarities and unit vectors around it."""
    for batch in batches:
        around = batch.column("around")
        flat = around.flatten()
        other = flat.field("other").to_numpy(zero_copy_only=False)
        sim = flat.field("sim").to_numpy(zero_copy_only=False)
        vec = _unit(_matrix(flat.field("vec"))).astype(np.float32)
        ends = np.cumsum(around.value_lengths().to_numpy(zero_copy_only=False))
        for node, start, end in zip(batch.column("node").to_pylist(), np.concatenate([[0], ends[:-1]]), ends):
            yield node, other[start:end], sim[start:end], vec[start:end]


def _local_joins(near: DataFrame, nodes: DataFrame, shape: Shape) -> DataFrame:
    """The neighbours of a node, in both directions, offered to each other."""
    back = near.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim")
    around = _with_vectors(_best(near.unionByName(back), shape.lists), nodes)

    def join(batches):
        out = []
        for _, other, _, vec in _each_around(batches):
            out.append(_neighbours(other, vec, shape.offers))
            if len(out) >= 256:
                yield from out
                out = []
        yield from out

    # Offers of one task are combined before they travel.
    return around.mapInArrow(join, EDGES)


def _pruned(near: DataFrame, nodes: DataFrame, shape: Shape) -> DataFrame:
    """Per node the neighbours that no kept one is closer to; free places go to the nearest."""
    around = _with_vectors(near, nodes)

    def prune(batches):
        for node, other, sim, vec in _each_around(batches):
            order = np.lexsort((other, -sim))
            between, kept, left = vec @ vec.T, [], []
            for i in order:
                (kept if not kept or between[i, kept].max() < sim[i] else left).append(i)
                if len(kept) == shape.degree:
                    break
            kept = (kept + left)[: shape.degree]
            yield _edge_batch(np.full(len(kept), node), other[kept], sim[kept])

    return around.mapInArrow(prune, EDGES)


# --- searching ------------------------------------------------------------------------

def search(queries: DataFrame, graph: Graph, k: int, width: int = 128, entries: int = 8, step: int = 16) -> DataFrame:
    """Approximate ``k`` best chunks per query: ``query_id, chunk_id, similarity, rank``.
    ``width`` is the breadth of the search (the larger, the more neighbours it finds), ``step``
    how many nodes of a query are followed in one round."""
    return answers(scored(queries, graph, max(width, k), entries, step), graph, k)


def answers(found: DataFrame, graph: Graph, k: int) -> DataFrame:
    """The ``k`` best chunks per query among the copies of the scored nodes."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node")
    near = found.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k).drop("_nth", "done")
    near = stored(near, "nodes")
    # Of a node's copies the first k can count, however many there are.
    first = Window.partitionBy("node").orderBy("chunk_id")
    copies = graph.members.join(near.select("node").distinct(), "node", "left_semi").withColumn(
        "_nth", F.row_number().over(first)).where(F.col("_nth") <= k).drop("_nth")
    return ranked(near.join(copies, "node").select("query_id", "chunk_id", "similarity"), k)


def scored(queries: DataFrame, graph: Graph, width: int, entries: int = 8, step: int = 16) -> DataFrame:
    """``query_id, node, similarity, done``: every node of layer 0 the search has scored."""
    ensure_checkpoint_dir(queries.sparkSession)
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    asked = stored(asked, "asked")
    state = _entered(asked, graph.top, entries if graph.edges else graph.top.count())
    for number in range(len(graph.edges) - 1, -1, -1):
        state = _walk(asked, state, graph.edges[number], graph.vectors, width if number == 0 else entries, step)
        if number:
            best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node")
            state = state.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= entries).select(
                "query_id", "node", "similarity", F.lit(False).alias("done"))
    return state


def _state(asked: DataFrame) -> str:
    return f"query_id {asked.schema['query_id'].dataType.simpleString()}, node long, similarity double, done boolean"


def _entered(asked: DataFrame, top: DataFrame, entries: int) -> DataFrame:
    """Every query's best nodes of the top layer, which its build keeps small."""
    here = top.select("node", "vec").toArrow().combine_chunks()
    shared = asked.sparkSession.sparkContext.broadcast(
        (here.column("node").to_numpy(), _unit(_matrix(here.column("vec")))))

    def enter(batches):
        node, m = shared.value
        for batch in batches:
            take = min(entries, len(node))
            if not take or not batch.num_rows:
                continue
            sims = np.round(_unit(_matrix(batch.column("vector"))) @ m.T, DIGITS)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :take]
            yield pa.RecordBatch.from_arrays([
                batch.column("query_id").take(pa.array(np.repeat(np.arange(batch.num_rows), take))), pa.array(node[best].ravel(), pa.int64()),
                pa.array(np.take_along_axis(sims, best, axis=1).ravel()), pa.array(np.zeros(best.size, bool))],
                names=["query_id", "node", "similarity", "done"])

    return asked.mapInArrow(enter, _state(asked))


def _walk(asked: DataFrame, state: DataFrame, edges: DataFrame, vectors: DataFrame, width: int, step: int) -> DataFrame:
    """Rounds until every row of every query's best ``width`` has been followed."""
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "node")
    open_ = Window.partitionBy("query_id", F.col("_nth") <= width, "done").orderBy("_nth")
    while True:
        ranks = state.withColumn("_nth", F.row_number().over(best))
        front = (F.col("_nth") <= width) & ~F.col("done") & (F.row_number().over(open_) <= step)
        beam = stored(ranks.withColumn("_front", front).drop("_nth"), "beam")
        ahead = beam.where("_front").select("query_id", "node")
        if ahead.isEmpty():
            return beam.drop("_front")
        met = ahead.join(edges, "node").select("query_id", F.explode("neighbours").alias("node")).distinct()
        new = met.join(beam.select("query_id", "node"), ["query_id", "node"], "left_anti")
        followed = beam.withColumn("done", F.col("done") | F.col("_front")).drop("_front")
        state = followed.unionByName(_scores(new, asked, vectors))


def _scores(pairs: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = np.einsum("ij,ij->i", _unit(_matrix(batch.column("vec"))), _unit(_matrix(batch.column("vector"))))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), pa.array(np.round(sims, DIGITS)),
                                              pa.array(np.zeros(len(sims), bool))], names=["query_id", "node", "similarity", "done"])

    met = pairs.join(vectors, "node").join(asked, "query_id").select("query_id", "node", "vec", "vector")
    return met.mapInArrow(score, _state(asked))
