"""Session, message, artifact and knowledge-base listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstone.functions import citing
from turnstone.operators.bounds import broadcast_if_small
from turnstone.operators.running import numbered, spread_blocks
from turnstone.settings import DEFAULTS, Settings

TALK = ("user", "assistant")


def session_list(sessions: DataFrame, messages: DataFrame, limit: int = 50,
                 offset: int = 0) -> DataFrame:
    """Newest first with message counts. Only the requested page is counted."""
    page = sessions.orderBy(F.desc("updated_at"), F.asc("session_id")).offset(offset).limit(limit)
    few = broadcast_if_small(page.select("session_id"))  # the page's size is the caller's
    counts = messages.join(few, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("n"))
    return page.join(counts, "session_id", "left").select(
        "session_id", "title", "created_at", "updated_at",
        F.coalesce("n", F.lit(0)).alias("message_count")).orderBy(
        F.desc("updated_at"), F.asc("session_id"))


def session_detail(sessions: DataFrame, messages: DataFrame, order: str = "created_at") -> DataFrame:
    """One row per message with its place in the session, beside the session's own
    columns. Kept flat: a session has no size limit, a row does. ``order`` may have
    any orderable type."""
    placed = _numbered(messages, [F.col(c) for c in (order, "message_id")])
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    info = sessions.select("session_id", "title").join(counts, "session_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)))
    # An inner join plus the empty sessions: a session with most of the messages
    # can then be split, which an outer join on this side does not allow.
    full = placed.join(info, "session_id")
    return full.unionByName(info.where("message_count = 0"), allowMissingColumns=True)


def session_artifacts(sessions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifact part of the session detail: one row each, newest first."""
    known = artifacts.join(sessions.select("session_id"), "session_id", "left_semi").select(
        "session_id", "artifact_id", "message_id", "kind", "title", "created_at")
    return _numbered(known, [F.desc("created_at"), F.asc("artifact_id")])


def _numbered(rows: DataFrame, order) -> DataFrame:
    blocks = spread_blocks(rows, ["session_id"], order)
    return numbered(blocks, ["session_id"], order, F.col("_spread"), "position").drop("_spread")


def history_window(messages: DataFrame, n: int | None = None, order: str = "created_at",
                   settings: Settings = DEFAULTS) -> DataFrame:
    """The last ``n`` user and assistant messages of every session. The rank
    filter is applied before the shuffle too, so long sessions cost little."""
    n = settings.history_messages if n is None else n
    talk = messages.where(F.col("role").isin(*TALK))
    if n <= 0:
        return talk.limit(0).withColumn("recency", F.lit(1))
    w = Window.partitionBy("session_id").orderBy(F.desc(order), F.desc("message_id"))
    return talk.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def prompts(new_messages: DataFrame, messages: DataFrame, system: str, n: int | None = None,
            order: str = "created_at", settings: Settings = DEFAULTS) -> DataFrame:
    """Per session: system text, windowed history, new message, as an ordered
    array of (role, content). At most ``n`` rows meet per session."""
    past = history_window(messages, n, order, settings).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.col("recency")).alias("at"), "role", "content"))).alias("h"))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    history = F.transform(F.coalesce("h", F.array()), lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content")))
    return new_messages.join(past, "session_id", "left").select(
        "session_id", F.concat(F.array(said("system", F.lit(system))), history,
                               F.array(said("user", F.col("message")))).alias("prompt"))


def append_turn(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """History with finished turns merged in: the user's message, then the reply
    where there is one. ``turns(session_id, message, reply, created_at, turn_id)``."""
    each = F.array(
        F.struct(F.lit("user").alias("role"), F.col("message").alias("content"),
                 F.lit("0").alias("nth")),
        F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content"),
                 F.lit("1").alias("nth")))
    rows = turns.select("session_id", "created_at", "turn_id", F.explode(each).alias("m")).where(
        F.col("m.content").isNotNull()).select(
        "session_id", F.concat_ws(":", "turn_id", "m.nth").alias("message_id"),
        "m.role", "m.content", "created_at")
    return messages.select(rows.columns).unionByName(rows)


def session_titles(messages: DataFrame, order: str = "created_at",
                   settings: Settings = DEFAULTS) -> DataFrame:
    """A session is named by its opening message if that is the user's."""
    talk = messages.where(F.col("role").isin(*TALK))
    opening = talk.groupBy("session_id").agg(
        F.min_by(F.struct("role", "content"), F.struct(order, "message_id")).alias("m"))
    title = citing.session_title(F.col("m.content"), settings.title_chars)
    return opening.select("session_id", F.when(
        F.col("m.role") == "user", title).otherwise(F.lit("New chat")).alias("title"))


def artifact_list(artifacts: DataFrame, session_id=None, limit: int = 50) -> DataFrame:
    if session_id is not None:
        artifacts = artifacts.where(F.col("session_id") == session_id)
    return artifacts.select("artifact_id", "session_id", "kind", "title", "created_at").orderBy(
        F.desc("created_at"), F.asc("artifact_id")).limit(limit)


def artifact(artifacts: DataFrame, artifact_id) -> DataFrame:
    return artifacts.where(F.col("artifact_id") == artifact_id)


def kb_status(episodes: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: table sizes, readiness and how the last run ended."""
    e = episodes.agg(F.count("*").alias("episodes"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded_chunks"))
    r = runs.agg(F.max_by(F.struct("status", "finished_at"), "started_at").alias("last"))
    return e.select(
        "episodes", c.select("chunks").scalar().alias("chunks"),
        c.select("embedded_chunks").scalar().alias("embedded_chunks"),
        r.select("last.status").scalar().alias("last_run_status"),
        r.select("last.finished_at").scalar().alias("last_run_finished_at"),
    ).withColumn("ready", F.col("embedded_chunks") > 0)
