"""What several operators share: written tables, normal forms, small guards."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread: cuts the
    lineage, fixes row ids, and survives the loss of any executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table this run has written."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and broadcasts nothing refers to any more; by itself it
    waits until the driver's memory fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables of one run that go when they are used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.append((name, path))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names, or all."""
        for name, path in list(self.paths):
            if not names or name in names:
                remove(self.spark, path)
                self.paths.remove((name, path))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; all other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def utf8(values: pa.Array) -> list[bytes]:
    """The texts of a column as bytes; null counts as empty."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def light_pieces(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` rows whose texts take about ``size`` bytes; a
    longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > at and (held + n > size or i - at >= rows):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def text_digest(text: bytes) -> bytes:
    """SHA-256 of the text with A-Z lower-cased."""
    return hashlib.sha256(text.lower()).digest()


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod


def first_per_task(key: str):
    """For mapInArrow: of the rows of one task that share ``key``, the first.
    Keeps a key's rows at one per task at most, however many copies there are;
    a task remembers the keys of its own input split."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keep = []
            for i, k in enumerate(batch.column(key).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return step
