"""Product-quantisation codebooks by Lloyd's rounds over cover trees.

Vectors go to an integer grid and are cut into equal parts. Each task cuts its rows into
blocks and builds, per block and part, one cover tree: nested nets of halving scale, taken
from a farthest-first order of the block, so that a net's points are over its scale apart
and every later point is within the scale of the net point it hangs from. A node carries
count, component sums and the radius that holds everything below it.

In a round a node is compared with the entries that its parent could not rule out. Where
the nearest entry plus the node's radius stays under every other one minus the radius, the
whole subtree goes to that entry by its count and sums; other nodes hand the entries still
possible to their children, and only points at the bottom are compared exactly, in integers,
ties to the lower index. The trees are built once and written; a round reads them, sends one
sum per part and entry from each task, and the driver holds the codebooks only.

Defined results: rows whose vector is null, empty or holds a null, NaN or infinite component
are left out. Vectors share one dimension, the most frequent one (of equals the largest);
rows of another are left out. The dimension must be a multiple of the parts. Repeated rows
are rows of their own; the first entries go by id, null last, then by vector. Fewer rows
than entries give shorter codebooks; an empty table gives no rows. Null labels are one
label. A component beyond 2**13 raises: squared distances must fit a long.
"""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm.common import written
from turnstone.llm.vectors import arrow, finite, grid, struct
from turnstone.operators.bounds import broadcast_if_small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4_096
BOUND = 1 << 25  # of a component on the grid
BLOCK = 2_048    # rows of a tree
LEAF = 16        # points that a node of the lowest net holds on average
SLACK = 1e-9     # relative; far over the rounding of a square root


def _length(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Tree:
    """Nodes in order of their level, root first. ``child[first[i]:first[i + 1]]`` are the
    nodes below node i; ``point[start[i]:start[i + 1]]`` its points, set at the bottom only."""

    points: np.ndarray
    centre: np.ndarray   # row number of the node's own point
    radius: np.ndarray
    count: np.ndarray
    total: np.ndarray
    first: np.ndarray
    child: np.ndarray
    start: np.ndarray
    point: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray) -> Tree:
        order, level, hangs = _farthest_first(points, max(1, -(-len(points) // LEAF)))
        depth = int(level[-1])
        # Nodes: point j is a node of every level from its own to the last.
        node_of = np.full((depth + 1, len(order)), -1)
        net = []
        for lv in range(depth + 1):
            here = np.flatnonzero(level <= lv)
            node_of[lv, here] = len(net) + np.arange(len(here))
            net.extend(here.tolist())
        net = np.array(net)
        parent = np.full(len(net), -1)
        for lv in range(1, depth + 1):
            here = np.flatnonzero(level <= lv)
            above = np.where(level[here] < lv, here, hangs[here])
            parent[node_of[lv, here]] = node_of[lv - 1, above]
        n, dim = len(net), points.shape[1]
        near = _nearest_net(points, order)
        home = node_of[depth, near]
        by_home = np.argsort(home, kind="stable")
        start = np.searchsorted(home[by_home], np.arange(n + 1))
        count, total, radius = np.zeros(n, np.int64), np.zeros((n, dim), np.int64), np.zeros(n)
        np.add.at(count, home, 1)
        np.add.at(total, home, points)
        centre = order[net]
        np.maximum.at(radius, home, _length(((points - points[centre[home]]) ** 2).sum(axis=1)))
        for lv in range(depth, 0, -1):
            here = node_of[lv][node_of[lv] >= 0]
            up = parent[here]
            np.add.at(count, up, count[here])
            np.add.at(total, up, total[here])
            step = _length(((points[centre[here]] - points[centre[up]]) ** 2).sum(axis=1))
            np.maximum.at(radius, up, step + radius[here])
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.argsort(parent[kids], kind="stable")]
        first = np.searchsorted(parent[kids], np.arange(n + 1))
        return cls(points, centre, radius * (1 + SLACK) + SLACK, count, total, first, kids, start, by_home)

    def assign(self, entries: np.ndarray, each: bool = False):
        """Counts and sums per entry, the points' entries and squared distances (with ``each``)
        and how many distances were computed."""
        n_entries = len(entries)
        count, total = np.zeros(n_entries, np.int64), np.zeros((n_entries, self.points.shape[1]), np.int64)
        code = np.zeros(len(self.points), np.int64)
        nodes, open_ = np.zeros(1, int), np.ones((1, n_entries), bool)
        compared = 0
        while len(nodes):
            far = _length(_squares(self.points[self.centre[nodes]], entries))
            compared += int(open_.sum())
            far[~open_] = np.inf
            r = self.radius[nodes]
            limit = far.min(axis=1) + r
            # An entry stays possible unless it is strictly farther for all points below.
            open_ = open_ & ((far - r[:, None]) * (1 - SLACK) - SLACK <= limit[:, None])
            settled = open_.sum(axis=1) == 1
            entry = open_[settled].argmax(axis=1)
            np.add.at(count, entry, self.count[nodes[settled]])
            np.add.at(total, entry, self.total[nodes[settled]])
            if each and settled.any():
                self._mark(code, nodes[settled], entry)
            nodes, open_ = nodes[~settled], open_[~settled]
            kids = self.first[nodes + 1] - self.first[nodes]
            bottom = kids == 0
            if bottom.any():
                at, rows = self._below(nodes[bottom])
                squares = _squares(self.points[at], entries)
                possible = open_[bottom][rows]
                compared += int(possible.sum())
                squares[~possible] = np.iinfo(np.int64).max
                mine = squares.argmin(axis=1)
                code[at] = mine
                count += np.bincount(mine, minlength=n_entries)
                np.add.at(total, mine, self.points[at])
            nodes, open_ = nodes[~bottom], open_[~bottom]
            kids = kids[~bottom]
            spans = _spans(self.first[nodes], kids)
            nodes, open_ = self.child[spans], np.repeat(open_, kids, axis=0)
        error = ((self.points - entries[code]) ** 2).sum(axis=1) if each else None
        return count, total, code, error, compared

    def _below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.start[nodes + 1] - self.start[nodes]
        return self.point[_spans(self.start[nodes], sizes)], np.repeat(np.arange(len(nodes)), sizes)

    def _mark(self, code: np.ndarray, nodes: np.ndarray, entry: np.ndarray) -> None:
        """Writes the entry of settled nodes to all points below them."""
        while len(nodes):
            at, rows = self._below(nodes)
            code[at] = entry[rows]
            kids = self.first[nodes + 1] - self.first[nodes]
            entry, nodes = np.repeat(entry, kids), self.child[_spans(self.first[nodes], kids)]


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + sizes[i] - 1, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` from all rows of ``b``; as floats where
    every term is an integer they can hold."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if 4 * a.shape[1] * int(most) ** 2 < 1 << 52:
        a, b = a.astype(np.float64), b.astype(np.float64)
    return ((a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)[None, :]).astype(np.int64)


def _farthest_first(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``most`` points at most, each the farthest from those before it; the level of each,
    that is how often the scale halves before it enters; and the point of a level above
    that each hangs from, the nearest."""
    order, gap = [0], []
    dist = ((points - points[0]) ** 2).sum(axis=1)
    while len(order) < most:
        at = int(dist.argmax())
        if dist[at] == 0:
            break
        gap.append(float(np.sqrt(dist[at])))
        order.append(at)
        dist = np.minimum(dist, ((points - points[at]) ** 2).sum(axis=1))
    order, level = np.array(order), np.zeros(len(order), int)
    if gap:
        level[1:] = np.floor(np.log2(gap[0] / np.array(gap))).astype(int) + 1
    hangs = np.zeros(len(order), int)
    for lv in np.unique(level[1:]):
        new, above = np.flatnonzero(level == lv), np.flatnonzero(level < lv)
        hangs[new] = above[_squares(points[order[new]], points[order[above]]).argmin(axis=1)]
    return order, level, hangs


def _nearest_net(points: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every point the number of the net point nearest to it."""
    out = np.empty(len(points), int)
    for at in range(0, len(points), 512):
        out[at:at + 512] = _squares(points[at:at + 512], points[order]).argmin(axis=1)
    return out


# --- the table of trees -----------------------------------------------------------------

FIELDS = ("points", "centre", "radius", "count", "total", "first", "child", "start", "point")


def _pack(trees: list[Tree]) -> bytes:
    """The arrays of a block's trees, small integers in as few bytes as they need."""
    out = io.BytesIO()
    small = lambda a: a if a.dtype.kind == "f" else a.astype(np.min_scalar_type(-int(np.abs(a).max()) - 1)) if a.size else a
    np.savez(out, **{f"{f}{i}": small(getattr(t, f)) for i, t in enumerate(trees) for f in FIELDS})
    return out.getvalue()


def _unpack(packed: bytes, parts: int) -> list[Tree]:
    held = np.load(io.BytesIO(packed))
    wide = lambda a: a if a.dtype.kind == "f" else a.astype(np.int64)
    return [Tree(**{f: wide(held[f"{f}{i}"]) for f in FIELDS}) for i in range(parts)]


def dimension(embeddings: DataFrame, vector_col: str = "embedding") -> int:
    """The most frequent dimension of the usable vectors; 0 if there are none."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64())])

    def sizes(batches):
        for batch in batches:
            for rows, matrix in finite(batch.column("v")):
                yield pa.RecordBatch.from_arrays([pa.array([matrix.shape[1]], pa.int32()), pa.array([len(rows)], pa.int64())], schema=schema)

    found = embeddings.select(F.col(vector_col).alias("v")).mapInArrow(sizes, struct(schema))
    top = found.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return top.dim if top else 0


def forest(embeddings: DataFrame, dim: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """One row per block of rows: their ids and labels, and the trees of all parts. Written."""
    if dim % parts:
        raise ValueError(f"{dim} components cannot be cut into {parts} equal parts")

    source = embeddings.select(F.col("vec_id").cast("long").alias("id"), "label", F.col("embedding").alias("v"))
    out = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(source.schema["label"].dataType)),
                        T.StructField("trees", T.BinaryType())])
    schema = arrow(out)

    def grow(ids, labels, whole):
        packed = _pack([Tree.over(p) for p in np.split(whole, parts, axis=1)])
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((ids.to_pylist(), labels.to_pylist(), packed), schema)], schema=schema)

    def plant(batches):
        ids, labels, rows = [], [], []
        for batch in batches:
            for at, matrix in finite(batch.column("v")):
                if matrix.shape[1] == dim:
                    ids.append(batch.column("id").take(pa.array(at)))
                    labels.append(batch.column("label").take(pa.array(at)))
                    rows.append(grid(matrix, scale, BOUND))
            while sum(map(len, rows)) >= BLOCK:
                i, lb, w = pa.concat_arrays(ids), pa.concat_arrays(labels), np.vstack(rows)
                yield grow(i[:BLOCK], lb[:BLOCK], w[:BLOCK])
                ids, labels, rows = [i[BLOCK:]], [lb[BLOCK:]], [w[BLOCK:]]
        if sum(map(len, rows)):
            yield grow(pa.concat_arrays(ids), pa.concat_arrays(labels), np.vstack(rows))

    return written(source.mapInArrow(plant, out), "forest")


def first_codebooks(embeddings: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """(parts, entries, components): the parts of the smallest ids' vectors."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64()))])

    def least(batches):
        """The ``entries`` smallest rows of a batch."""
        for batch in batches:
            for at, matrix in finite(batch.column("v")):
                if matrix.shape[1] != dim:
                    continue
                whole, ids = grid(matrix, scale, BOUND), batch.column("id").take(pa.array(at)).to_pylist()
                first = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, whole[i].tolist()))[:entries]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in first], pa.int64()),
                                                  pa.array(whole[first].tolist(), schema.field(1).type)], schema=schema)

    source = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    rows = source.mapInArrow(least, struct(schema)).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, dim // parts).transpose(1, 0, 2)


def step(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round over all parts: sums per part and entry, then the floor of the means."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def sums(batches):
        n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for packed in batch.column("trees"):
                for p, tree in enumerate(_unpack(packed.as_py(), len(books))):
                    count, added, _, _, _ = tree.assign(books[p])
                    n[p] += count
                    total[p] += added
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
                                          pa.array(total[part, entry].tolist(), schema.field(3).type)], schema=schema)

    per_task = trees.select("trees").mapInArrow(sums, struct(schema)).select("part", "entry", "n", F.posexplode("total").alias("at", "s"))
    rows = per_task.groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # as many as the codebooks' numbers
    moved = books.copy()
    for r in rows:
        moved[r.part, r.entry, r["at"]] = int(r.s) // r.n
    return moved


def encode(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` under the given codebooks."""
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", trees.schema["labels"].dataType.elementType),
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    schema = arrow(out)

    def settle(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                codes, error = [], 0
                for p, tree in enumerate(_unpack(batch.column("trees")[row].as_py(), len(books))):
                    _, _, code, far, _ = tree.assign(books[p], each=True)
                    codes.append(code)
                    error = error + far
                text = np.stack(codes, axis=1).astype(np.uint8).tobytes().hex()
                wide = 2 * len(books)
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids")[row].values, batch.column("labels")[row].values,
                    pa.array([text[i:i + wide] for i in range(0, len(text), wide)]), pa.array(error, pa.int64())], schema=schema)

    return trees.mapInArrow(settle, out)


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; 256 entries at most."""
    dim = dimension(embeddings)
    if not dim:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    trees = forest(embeddings, dim, parts, scale)
    books = first_codebooks(embeddings, dim, parts, entries, scale)
    for _ in range(rounds):
        books = step(trees, books)
    coded = written(encode(trees, books), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = broadcast_if_small(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
