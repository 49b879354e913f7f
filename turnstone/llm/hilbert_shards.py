"""Sharding along a Hilbert curve over several metadata dimensions.

Every dimension, number or text, is quantised at its own quantiles, the cell's index on the
Hilbert curve orders the rows, and the order is cut into runs. Rows that are
close in all dimensions share a run, so the minima and maxima of a run (in a
Parquet footer or in ``manifest``) prune filters on any of the dimensions.

Cases. Null text: size 1, crc32 0. Null in a dimension: lowest cell. Ties and
repeated rows: ordered by id and crc32; rows equal in both may swap places, each
has a slot of its own. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm.common import written

LAWS = ("rows", "bytes")


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows of ``cells``), ``bits`` per axis:
    undo the excess work of the axes, then Gray-encode the transposed bits."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        top = one << np.uint64(b)
        low = top - one
        for i in range(dims):
            up = (x[i] & top) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _cells(values: pa.Array, edges: list) -> np.ndarray:
    """How many edges lie below each value."""
    if pa.types.is_int64(values.type):
        return np.searchsorted(np.array(edges, np.int64), values.to_numpy(zero_copy_only=False), "left")
    coded = values.dictionary_encode()
    at = np.array([bisect_left(edges, t) for t in coded.dictionary.to_pylist()], np.int64)
    return at[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(len(values), np.int64)


def _indexed(dims: int, bits: int, cuts: list[list]):
    edges = [sorted(set(c)) for c in cuts]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.column_stack([_cells(batch.column(f"_d{i}"), edges[i]) for i in range(dims)])
            rest = batch.select([n for n in batch.schema.names if not n.startswith("_d")])
            yield rest.append_column("curve", pa.array(curve_index(cells, bits), pa.int64()))

    return step


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and running counts of rows and bytes before a row."""
    part, rows, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        before = size + np.cumsum(sizes) - sizes
        out = batch.append_column("part", pa.array(np.full(n, part, np.int32)))
        out = out.append_column("rows_before", pa.array(np.arange(rows, rows + n, dtype=np.int64)))
        yield out.append_column("bytes_before", pa.array(before.astype(np.int64)))
        rows, size = rows + n, size + int(sizes.sum())


def text_cuts(texts: DataFrame, column: str, parts: int) -> list[str]:
    """At most ``parts - 1`` texts that cut all rows, in the order of their texts, into about
    equal parts. Counts per distinct text are sorted by range, numbered like the curve,
    and only the texts at which a part is full reach the driver."""
    counted = texts.groupBy(F.col(column).alias("t")).agg(F.count("*").alias("size"))
    schema = "t string, size long, part int, rows_before long, bytes_before long"
    runs = written(counted.repartitionByRange("t").sortWithinPartitions("t").mapInArrow(_numbered, schema), "texts")
    offsets = _offsets(runs)
    before = F.col("bytes_off") + F.col("bytes_before")
    full = lambda c: F.floor(c * parts / F.col("all_bytes"))
    met = runs.join(F.broadcast(offsets), "part").where((full(before + F.col("size")) > full(before)) & (before + F.col("size") < F.col("all_bytes")))
    return sorted(r.t for r in met.select("t").collect())


def _offsets(runs: DataFrame) -> DataFrame:
    """Rows and bytes before each partition of a sort: one row per partition, so the window
    and the broadcast are bounded by their number."""
    parts = runs.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_off"), F.sum("n").over(whole).alias("all_rows"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_off"), F.sum("b").over(whole).alias("all_bytes"))


def assign(docs: DataFrame, dims: Sequence[Column], shards: int = 8, law: str = "rows", bits: int = 5,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row.

    ``dims`` are integer or text columns; at most 62 bits in all. A text is ranked among
    all texts of its column, so a prefix they share costs no precision. ``law``: ``rows`` cuts runs of counts at most one apart, ``bytes``
    cuts at equal shares of the bytes.

    The global order is one range shuffle of narrow rows on (curve, id, crc32),
    so a cell that holds a third of the rows is split as well. Positions are
    counted inside the sorted partitions, written once, and shifted by one offset
    per partition."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    if len(dims) * bits > 62:
        raise ValueError("too many bits")
    t = F.coalesce(F.col(text), F.lit(""))
    texts = [i for i, f in enumerate(docs.select(*dims).schema) if isinstance(f.dataType, T.StringType)]
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t).alias("text_crc32"),
        *[F.coalesce(d, F.lit("")).alias(f"_d{i}") if i in texts else F.coalesce(d.cast("long"), F.lit(-(2**62))).alias(f"_d{i}")
          for i, d in enumerate(dims)])
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [i for i in range(len(dims)) if i not in texts]
    found = keyed.agg(F.count("*"), *[F.percentile_approx(f"_d{i}", steps, 2000).alias(f"c{i}") for i in numbers]).first()
    cuts = [text_cuts(keyed, f"_d{i}", 1 << bits) if i in texts else list(found[f"c{i}"] or []) for i in range(len(dims))]
    plain = T.StructType([f for f in keyed.schema.fields if not f.name.startswith("_d")])
    indexed = keyed.mapInArrow(_indexed(len(dims), bits, cuts), T.StructType([*plain.fields, T.StructField("curve", T.LongType())]))
    order = ["curve", "doc_id", "text_crc32"]
    numbered = T.StructType([*indexed.schema.fields, T.StructField("part", T.IntegerType()),
                             T.StructField("rows_before", T.LongType()), T.StructField("bytes_before", T.LongType())])
    runs = written(indexed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, numbered), "curve")
    placed = runs.join(F.broadcast(_offsets(runs)), "part").withColumns({
        "rank": F.col("rows_off") + F.col("rows_before"), "at_byte": F.col("bytes_off") + F.col("bytes_before")})
    if law == "rows":
        shard = F.expr(f"rank * {shards} div all_rows")
        first = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
        out = placed.withColumn("shard", shard.cast("int")).withColumn("first_rank", first)
    else:
        placed = placed.withColumn("shard", F.least(F.expr(f"at_byte * {shards} div all_bytes"), F.lit(shards - 1)).cast("int"))
        firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
        out = placed.join(F.broadcast(firsts), "shard")  # one row per shard
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
                      (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def manifest(rows: DataFrame, dims: dict[str, Column], run_rows: int = 100_000) -> DataFrame:
    """Minimum and maximum of each dimension per (shard, run of slots)."""
    keyed = rows.withColumn("run", F.expr(f"slot div {run_rows}"))
    return keyed.groupBy("shard", "run").agg(
        F.count("*").alias("rows"),
        *[f(c).alias(f"{end}_{n}") for n, c in dims.items() for end, f in (("min", F.min), ("max", F.max))])


def prune(runs: DataFrame, low: dict, high: dict) -> DataFrame:
    """The runs of a manifest that can hold a row inside the box."""
    keep = F.lit(True)
    for n, v in low.items():
        keep = keep & (F.col(f"max_{n}") >= F.lit(v))
    for n, v in high.items():
        keep = keep & (F.col(f"min_{n}") <= F.lit(v))
    return runs.where(keep)


def write_shards(rows: DataFrame, path: str, shards: int = 8) -> None:
    """Writes rows (with shard and slot) as one folder per shard, in slot order."""
    (rows.repartitionByRange(max(shards, 2), "shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
