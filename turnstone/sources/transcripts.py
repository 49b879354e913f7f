"""Transcript files: scan, front matter, typed metadata."""

from __future__ import annotations

from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.functions import text as tx
from turnstone.operators.dedup import folder

PATTERN = "episodes/*/transcript.md"
WATCH = "https://www.youtube.com/watch?v="
META = T.StructType([
    *[T.StructField(n, T.StringType()) for n in (
        "video_id", "guest", "title", "youtube_url", "description", "error")],
    T.StructField("publish_date", T.DateType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
])


def scan(spark: SparkSession, root: str, limit: int = 0) -> DataFrame:
    """``source_path, raw``: one row per transcript, optionally the first few by
    path."""
    files = spark.read.text(f"{root.rstrip('/')}/{PATTERN}", wholetext=True).select(
        F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw"))
    if limit <= 0:
        return files
    # The paths are chosen alone; the texts stay where they are read.
    chosen = files.select("source_path").orderBy("source_path").limit(limit)
    return files.join(F.broadcast(chosen), "source_path", "left_semi")  # ``limit`` paths


def split_front_matter(files: DataFrame) -> DataFrame:
    """Add ``header, body, error, content_hash``. Only the first two marks split;
    later ones belong to the body."""
    raw = tx.newlines_unified(F.col("raw"))
    parts = F.split("raw", "---", 3)
    error = (F.when(~F.col("raw").startswith("---"), F.lit("missing"))
             .when(F.size("_parts") < 3, F.lit("unterminated")))
    return (files.withColumn("raw", raw)
            .withColumn("content_hash", F.sha2("raw", 256))
            .withColumn("_parts", parts).withColumn("error", error)
            .withColumn("header", F.when(F.col("error").isNull(), F.col("_parts")[1]))
            .withColumn("body", F.when(F.col("error").isNull(), F.col("_parts")[2]))
            .drop("_parts", "raw"))


def _read_date(value) -> date | None:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    try:
        return datetime.strptime(str(value).strip(), "%Y-%m-%d").date() if isinstance(
            value, str) else None
    except ValueError:
        return None


def _read_number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _read_header(header: str) -> dict:
    """One YAML header as typed fields; defaults are set later, in Spark."""
    import yaml

    try:
        meta = yaml.safe_load(header) or {}
    except yaml.YAMLError:
        return {"error": "yaml"}
    if not isinstance(meta, dict):
        return {"error": "yaml"}
    text = {k: str(meta[k]).strip() for k in ("video_id", "guest", "title", "youtube_url",
                                             "description") if meta.get(k)}
    words = meta.get("keywords") or []
    if isinstance(words, str):
        words = [w.strip() for w in words.split(",") if w.strip()]
    if not hasattr(words, "__iter__"):
        return {"error": "yaml"}
    return {**text, "keywords": [str(w) for w in words],
            "publish_date": _read_date(meta.get("publish_date")),
            "duration_seconds": _read_number(meta.get("duration_seconds"))}


@F.pandas_udf(META)
def _metadata(headers: pd.Series) -> pd.DataFrame:
    rows = [{} if h is None else _read_header(h) for h in headers]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in META.names})


def read_files(files: DataFrame) -> DataFrame:
    """Every file with its header read, ``error`` set where it could not be. The
    header function counts as non-deterministic, so no filter on its result is
    moved below it and it runs once per file."""
    split = split_front_matter(files).withColumn("m", _metadata.asNondeterministic()("header"))
    return split.withColumn("error", F.coalesce("error", "m.error"))


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(episodes-with-bodies, ``parse_errors(source_path, error)``)."""
    return parted(read_files(files))


def parted(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_files`` rows as (episodes, errors); written out first, both read one pass."""
    given = F.nullif(F.col("m.video_id"), F.lit(""))
    good = read.where(F.col("error").isNull()).select(
        "source_path", "content_hash", "body",
        F.coalesce(given, F.concat(F.lit("slug:"), folder(F.col("source_path")))).alias("video_id"),
        F.coalesce("m.guest", F.lit("Unknown guest")).alias("guest"),
        F.coalesce("m.title", F.lit("Untitled episode")).alias("title"),
        F.coalesce(F.nullif(F.col("m.youtube_url"), F.lit("")),
                   F.when(~given.startswith("slug:"), F.concat(F.lit(WATCH), given)),
                   F.lit("")).alias("youtube_url"),
        "m.publish_date", "m.duration_seconds", "m.description",
        F.coalesce("m.keywords", F.array().cast("array<string>")).alias("keywords"))
    bad = read.where(F.col("error").isNotNull()).select("source_path", "error")
    return good, bad
