"""The training-data pipeline: documents in, encoded clean documents out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm import attention_quality, heavy_dedup, order_minhash, rank_queue_bpe, window_match
from turnstone.llm.common import written
from turnstone.llm.queries import RANKS, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on labelled documents and keeps what the classifier accepts."""
    model = attention_quality.fit(docs, table(spark, sf_dir, "labels"))
    return attention_quality.keep_good(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return heavy_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return order_minhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents the benchmark contaminates. A null or repeated id is judged text by
    text: other texts under the id of a contaminated one stay."""
    judged = window_match.judge_texts(docs, table(spark, sf_dir, "benchmark"))
    bad = written(judged.where("contaminated").select(
        F.col("doc_id").alias("_bad"), F.col("md5").alias("_md5")).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == bad["_md5"])
    return docs.join(bad, same, "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and a digest that shows they decode to it."""
    ids = rank_queue_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    return rank_queue_bpe.decode(ids, RANKS, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
