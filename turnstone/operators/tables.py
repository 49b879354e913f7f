"""Intermediate tables, written once where the driver and all executors can read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnstone.session import ensure_checkpoint_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and reread. Cuts the lineage like a
    checkpoint, computes its last stage once, and keeps the columns apart."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
