"""Exact dedup with the heavy hitters split off.

A Misra-Gries summary per task finds the digests that can be frequent. Their
exact counts and winners are verified in one pass and broadcast, so their rows
are settled where they lie; the remaining digests go through an ordinary shuffle.

Equal means identical after lower-casing A-Z. The row with the largest id stays.
Cases. Null text counts as empty; all empty texts are one group. Null ids rank
lowest. Rows repeated under one id: exactly one stays. Empty table: empty
result. Extra columns are passed by (``drop_copies``) or not read (``groups``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.llm.common import pieces, text_digest, utf8, written

CAPACITY = 1023  # counters of a summary; digests over 1/512 of the rows are always found


def _digested(text: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at = batch.schema.get_field_index(text)
            found = pa.array([text_digest(t) for t in utf8(batch.column(at))], pa.binary())
            yield batch.append_column("digest", found)

    return step


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the SHA-256 of the normalised text as ``digest``."""
    schema = T.StructType([*docs.schema.fields, T.StructField("digest", T.BinaryType())])
    return docs.mapInArrow(_digested(text), schema)


def merge_counts(into: Counter, more: Counter, capacity: int) -> Counter:
    """Adds counters and, past the capacity, takes the size of the first counter
    that no longer fits off all of them: the mergeable Misra-Gries summary."""
    into.update(more)
    if len(into) <= capacity:
        return into
    cut = sorted(into.values(), reverse=True)[capacity]
    return Counter({k: v - cut for k, v in into.items() if v > cut})


def _summarised(capacity: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for batch in batches:
            kept = merge_counts(kept, Counter(batch.column(0).to_pylist()), capacity)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["digest", "lower"])

    return step


def candidates(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most ``capacity + 1`` digests, every one over 2/(capacity+1) of all rows
    among them. A task's counter misses at most rows/(capacity+1) of its own, so
    the sum over tasks of a digest that frequent is at least rows/(capacity+1); and
    as the sums add up to at most the rows, no more than ``capacity + 1`` reach it."""
    found = digests.select("digest").mapInArrow(_summarised(capacity), "digest binary, lower long")
    sums = found.groupBy("digest").agg(F.sum("lower").alias("lower"))
    n = digests.count()
    return sums.where(F.col("lower") * (capacity + 1) >= F.lit(n)).select("digest")


def heavy_winners(digests: DataFrame, by: list[str], capacity: int = CAPACITY) -> DataFrame:
    """digest, winner (struct of ``by``, largest), group_size of the frequent ones."""
    few = F.broadcast(candidates(digests, capacity))
    return digests.join(few, "digest").groupBy("digest").agg(
        F.max(F.struct(*by)).alias("winner"), F.count("*").alias("group_size"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(with_digest(narrow).select("doc_id", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    by = ["doc_id", "row"]
    heavy = written(heavy_winners(rows, by, capacity), "heavy")
    split = rows.join(F.broadcast(heavy), "digest", "left")
    settled = split.where("group_size is not null")
    rest = split.where("group_size is null").select("doc_id", "digest", "row")
    won = rest.groupBy("digest").agg(F.max(F.struct(*by)).alias("winner"), F.count("*").alias("group_size"))
    both = settled.unionByName(rest.join(won, "digest"))
    return both.select(
        "doc_id", F.col("winner.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, all their columns. Losing rows of heavy digests are
    dropped before the shuffle; the rank filter drops a task's other copies there too."""
    rows = with_digest(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "digest")
    heavy = written(heavy_winners(written(rows, "digests"), ["doc_id"], capacity), "heavy")
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # no name can clash with the ones added here
    plain = docs.toDF(*names.values())
    split = with_digest(plain, names[text]).join(F.broadcast(heavy), "digest", "left")
    left = split.where(F.col("winner").isNull() | F.col(names[doc_id]).eqNullSafe(F.col("winner.doc_id")))
    order = Window.partitionBy("digest").orderBy(F.col(names[doc_id]).desc_nulls_last())
    top = left.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return top.select(*[F.col(v).alias(k) for k, v in names.items()])
