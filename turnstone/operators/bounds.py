"""Size checks that decide whether a side may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.settings import DEFAULTS, Settings


def _width(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(c, " ")), F.lit(0))
        return F.coalesce(F.size(c), F.lit(0)) * 8
    return F.lit(8)


def fits(df: DataFrame, settings: Settings = DEFAULTS, rows: int | None = None) -> bool:
    """True when ``df`` has at most the allowed rows and bytes: one aggregate that
    every task combines first, so no row travels to be counted."""
    rows = rows or settings.broadcast_rows
    width = F.lit(0).cast("long")
    for field in df.schema.fields:
        width = width + _width(field)
    seen = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return seen.n <= rows and seen.b <= settings.broadcast_bytes


def broadcast_if_small(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """A broadcast hint when the check allows it; otherwise the join shuffles."""
    return F.broadcast(df) if fits(df, settings) else df


def merged(df: DataFrame) -> DataFrame:
    """A hint to join ``df`` by shuffle and merge. Left alone, Spark goes by the compressed
    bytes of a Parquet table or a shuffle, and a side of millions of keys that pack well
    passes the driver as a hash table many times that size."""
    return df.hint("merge")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A file scan with fewer partitions than the cluster has cores, split by
    ``key`` for the work ahead. A large scan is left as it is: its own splits
    keep every core busy and nothing is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
