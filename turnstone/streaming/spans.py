"""The append-only span log: streaming sink and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SPANS = ("id string, session_id string, request_id string, kind string, name string, "
         "started_at string, duration_ms int, ok int, prompt_tokens int, completion_tokens int, "
         "meta string")


def stream(spark: SparkSession, inbox: str) -> DataFrame:
    return spark.readStream.schema(SPANS).json(inbox)


def append(spans: DataFrame, path: str, checkpoint: str, resend: str = "1 day") -> StreamingQuery:
    """The file sink's own log makes a retried batch appear once, and a span sent again
    within ``resend`` of its first arrival is dropped, over restarts too. The watermark
    follows arrival, not ``started_at``, so a span is never too late to be stored; its
    state holds the ids of one such period. Spans without an id are all stored. Spans
    land in daily folders so that reads by time prune."""
    key = F.coalesce("id", F.concat(F.lit("none-"), F.uuid()))
    once = (spans.withColumns({"_arrived": F.current_timestamp(), "_key": key})
            .withWatermark("_arrived", resend).dropDuplicatesWithinWatermark(["_key"]).drop("_arrived", "_key"))
    return (once.withColumn("day", F.to_date("started_at"))
            .writeStream.format("parquet").option("path", path).partitionBy("day")
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def read(spans: DataFrame, session_id: str | None = None, request_id: str | None = None,
         limit: int = 200) -> DataFrame:
    """Spans of a session and/or request in time order."""
    if session_id:
        spans = spans.where(F.col("session_id") == session_id)
    if request_id:
        spans = spans.where(F.col("request_id") == request_id)
    return spans.orderBy("started_at", "id").limit(limit)
