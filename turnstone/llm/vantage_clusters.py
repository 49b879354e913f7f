"""Lloyd's clustering on an integer grid, assigned through a vantage-point tree.

Each round builds a vantage-point tree over the centroids and sends it to the tasks. A
vector searches it best first: the open node with the smallest lower bound is next, its
centroid is compared exactly in integers, and its two children get bounds by the triangle
inequality. A node is left out only if its bound is over the best distance so far, so nodes
at exactly that distance are visited and ties go to the smaller centroid number. A batch of
vectors takes its steps together, each vector along its own order.

A task sends one sum and one count per cluster; the sums meet per cluster and component.
The driver holds the centroids and the tree only: ``clusters`` times ``dim`` numbers.

Defined results: vectors that are null, of another dimension, or hold a null, NaN or infinite
component are left out. Repeated rows are rows of their own. A null id counts as empty text
when the first centroids are drawn, and stays null in the result. Equal hashes are ordered
by the vector. Fewer vectors than clusters give as many centroids as vectors; an empty table
gives no rows. A component beyond 2**21 raises, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import written
from turnstone.llm.vectors import finite, grid, struct

CLUSTERS, ROUNDS, SCALE, DIM = 16, 3, 64, 64
BOUND = 1 << 27  # of a component on the grid: 64 squares of twice that fit a long
SLACK = 1e-9     # relative; far over the rounding of a square root
STEP = 4_096     # vectors searched together


@dataclass
class Tree:
    """Node i compares centroid ``vantage[i]``. Its children are node numbers (-1: none), each
    with the least and largest distance of its centroids from the vantage."""

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)

    @classmethod
    def over(cls, centroids: np.ndarray) -> Tree:
        tree = cls(centroids)
        tree._grow(list(range(len(centroids))))
        return tree

    def _grow(self, members: list[int]) -> int:
        """The vantage is the member farthest from the others' first; the rest is halved by
        distance from it."""
        node = len(self.vantage)
        spread = ((self.centroids[members] - self.centroids[members[0]]) ** 2).sum(axis=1)
        vantage = members[int(np.argmax(spread))]
        self.vantage.append(vantage)
        self.children.append([])
        rest = np.array([m for m in members if m != vantage], dtype=int)
        far = ((self.centroids[rest] - self.centroids[vantage]) ** 2).sum(axis=1)
        order = np.argsort(far, kind="stable")
        for half in (order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2:]):
            if len(half):
                low, high = np.sqrt(far[half[0]]), np.sqrt(far[half[-1]])
                child = self._grow(rest[half].tolist())
                self.children[node].append((child, float(low), float(high)))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each vector, and how many
        distances were computed."""
        n = len(vectors)
        bound = np.full((n, len(self.vantage)), np.inf)
        bound[:, 0] = 0.0
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.centroids))
        reach, compared, rows = np.full(n, np.inf), 0, np.arange(n)
        while len(rows):
            node = bound[rows].argmin(axis=1)
            # Inclusive: a node at the best distance may hold a smaller number.
            low = bound[rows, node]
            going = np.isfinite(low) & (low <= reach[rows] * (1 + SLACK) + SLACK)
            rows, node = rows[going], node[going]
            for this in np.unique(node):
                at = rows[node == this]
                vantage = self.vantage[this]
                far = ((vectors[at] - self.centroids[vantage]) ** 2).sum(axis=1)
                compared += len(at)
                better = (far < best[at]) | ((far == best[at]) & (vantage < number[at]))
                best[at[better]], number[at[better]] = far[better], vantage
                reach[at] = np.sqrt(best[at].astype(np.float64))
                from_here, inherited = np.sqrt(far.astype(np.float64)), bound[at, this]
                for child, least, most in self.children[this]:
                    bound[at, child] = np.maximum.reduce([inherited, from_here - most, least - from_here, np.zeros(len(at))])
                bound[at, this] = np.inf
        return number, best, compared


def on_grid(embeddings: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the kept vectors as integers, written."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64()))])

    def place(batches):
        for batch in batches:
            for rows, matrix in finite(batch.column("v")):
                if matrix.shape[1] == dim:
                    whole = grid(matrix, scale, BOUND)
                    ends = pa.array(np.arange(len(rows) + 1) * dim, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(whole.ravel()))], schema=schema)

    source = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return written(source.mapInArrow(place, struct(schema)), "grid")


def first_centroids(gridded: DataFrame, clusters: int = CLUSTERS, seed: str = "1") -> np.ndarray:
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = gridded.select(drawn.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()  # ``clusters`` rows
    return np.array([r.v for r in rows], np.int64)


def _batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def step(gridded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign all vectors, replace each centroid that got any by the floor of
    their mean. Sums are exact: longs within a task, decimals between tasks."""
    tree = Tree.over(centroids)
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def sums(batches):
        n, total = np.zeros(len(tree.centroids), np.int64), np.zeros(tree.centroids.shape, np.int64)
        for _, vectors in _batches(batches):
            number, _, _ = tree.nearest(vectors)
            n += np.bincount(number, minlength=len(n))
            for c in np.unique(number):
                total[c] += vectors[number == c].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), schema.field(2).type)],
                                         schema=schema)

    per_task = gridded.select("v").mapInArrow(sums, struct(schema)).select("cluster", "n", F.posexplode("total").alias("at", "s"))
    rows = per_task.groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x dim rows
    moved = centroids.copy()
    for r in rows:
        moved[r.cluster, r["at"]] = int(r.s) // r.n
    return moved


def assign(gridded: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    tree = Tree.over(centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def settle(batches):
        for part, vectors in _batches(batches):
            number, best, _ = tree.nearest(vectors)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(best)], schema=schema)

    return gridded.mapInArrow(settle, struct(schema))


def clusters(embeddings: DataFrame, n: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = "1") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = embeddings.sparkSession
    gridded = on_grid(embeddings, dim, scale)
    centroids = first_centroids(gridded, n, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        centroids = step(gridded, centroids)
    settled = written(assign(gridded, centroids), "clusters")
    sums = settled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # ``n`` rows
    inertia = {r.cluster: int(r.s) for r in sums}
    whole = sum(inertia.values())
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    few = spark.createDataFrame([(c, fits(s), fits(whole), digest(c)) for c, s in sorted(inertia.items())],
                                "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return settled.join(F.broadcast(few), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
