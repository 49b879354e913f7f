"""Keeping stored episodes, chunks and sessions in step with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Files whose (id, hash) is not stored yet. ``force`` takes them all."""
    if force:
        return files
    return files.join(stored.select("video_id", "content_hash"),
                      ["video_id", "content_hash"], "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """Stored rows of untouched keys plus all the new rows."""
    untouched = stored.join(new.select(key).distinct(), key, "left_anti")
    return untouched.unionByName(new, allowMissingColumns=True)


def prune(episodes: DataFrame, expected: DataFrame, subset: bool = False
          ) -> tuple[DataFrame, DataFrame]:
    """(kept, stale) episodes. Refuses on a subset run or an empty corpus, either
    of which would empty the store."""
    if subset:
        raise ValueError("a subset run cannot tell which episodes are stale")
    if expected.isEmpty():
        raise ValueError("no transcripts: refusing to prune everything")
    ids = expected.select("video_id").distinct()
    return (episodes.join(ids, "video_id", "left_semi"),
            episodes.join(ids, "video_id", "left_anti"))


def chunks_of(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(episodes.select("episode_id"), "episode_id", "left_semi")


def delete_sessions(sessions: DataFrame, messages: DataFrame, artifacts: DataFrame,
                    gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deleting a session takes its messages and artifacts with it."""
    ids = gone.select("session_id").distinct()
    return tuple(t.join(ids, "session_id", "left_anti") for t in (sessions, messages, artifacts))


def delete_messages(messages: DataFrame, artifacts: DataFrame, gone: DataFrame
                    ) -> tuple[DataFrame, DataFrame]:
    """Deleting a message leaves its artifacts, without the reference."""
    ids = gone.select("message_id").distinct()
    lost = ids.withColumn("_gone", F.lit(True))
    orphaned = artifacts.join(lost, "message_id", "left").withColumn(
        "message_id", F.when(F.col("_gone").isNull(), F.col("message_id"))).drop("_gone")
    return (messages.join(ids, "message_id", "left_anti"), orphaned.select(artifacts.columns))
