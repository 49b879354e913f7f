"""Registered round trips through the store and the JSON sources, and what they are
compared with: the same rows straight from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from turnstone.operators import checks, html_clean, sessions
from turnstone.plans.catalog import quality
from turnstone.plans.catalog import tables as t
from turnstone.session import ensure_checkpoint_dir
from turnstone.sources import evaluation
from turnstone.sources.store import RUNS, Store

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _fresh(spark, name):
    """A new folder beside the checkpoints, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- the store ----------------------------------------------------------------------

def _stored(spark, sf):
    """Two runs: the first writes every document as an episode of one chunk, the
    second replaces those whose number is a multiple of three."""
    store = Store(spark, _fresh(spark, "store"))
    docs = t.load(spark, sf, "documents")
    i, blank = t.s(F.col("doc_id")), F.lit(None)
    chunks = docs.select(
        t.text_of("c", i).alias("chunk_id"), i.alias("episode_id"), F.lit(0).alias("ordinal"), F.col("source").alias("speaker"),
        blank.cast("int").alias("start_seconds"), blank.cast("int").alias("end_seconds"), "text",
        F.length("text").alias("token_count"), F.lit(False).alias("is_sponsor"), F.array("lang").alias("terms"),
        blank.cast("array<float>").alias("embedding"), "doc_id")
    episodes = docs.select(
        i.alias("episode_id"), t.text_of("v", i).alias("video_id"), F.col("source").alias("guest"), F.lit("t").alias("title"),
        F.lit("").alias("youtube_url"), blank.cast("date").alias("publish_date"), blank.cast("double").alias("duration_seconds"),
        blank.cast("string").alias("description"), F.array("lang").alias("keywords"), t.text_of("/c/", i).alias("source_path"),
        F.sha2("text", 256).alias("content_hash"), F.lit("2024-01-01").cast("timestamp").alias("ingested_at"), "doc_id")
    again = F.col("doc_id") % 3 == 0
    first = store.write_chunks(chunks, "one")
    store.commit(episodes.withColumn("run_id", F.lit("one")), "one", 0)
    second = store.write_chunks(chunks.where(again).withColumn("text", F.upper(F.get("terms", F.lit(0)))), "two")
    store.commit(episodes.withColumn("run_id", F.when(again, F.lit("two")).otherwise(F.lit("one"))), "two", 1)
    for run, n, error in (("one", first, None), ("two", second, "e" * 5000)):
        store.log_run(spark.createDataFrame([(run, "ok", "root", n, n, 0, n, error, None, None)], RUNS))
    return store


@query("store_chunks", """
SELECT 'c' || doc_id AS chunk_id, CAST(doc_id AS VARCHAR) AS episode_id, md5(CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE text END) AS text,
       CASE WHEN doc_id % 3 = 0 THEN 'two' ELSE 'one' END AS run_id, source AS guest
FROM documents""")
def store_chunks(spark, sf):
    """Live chunks beside their episodes, after a run has replaced some."""
    store = _stored(spark, sf)
    return store.chunks().join(store.episodes().select("episode_id", "guest"), "episode_id").select(
        "chunk_id", "episode_id", F.md5("text").alias("text"), "run_id", "guest")


@query("run_log", """
SELECT 'one' AS run_id, 'ok' AS status, count(*) AS chunks_written, 0 AS error_length FROM documents
UNION ALL SELECT 'two', 'ok', count(*), 5000 FROM documents WHERE doc_id % 3 = 0""")
def run_log(spark, sf):
    return _stored(spark, sf).runs().select(
        "run_id", "status", "chunks_written", F.coalesce(F.length("error"), F.lit(0)).alias("error_length"))


# --- JSON sources and sink ----------------------------------------------------------

@query("golden_source", """
SELECT 'q' || item_id AS query_id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'in' ELSE 'out' END AS category,
       item_id % 2 = 0 AS expect_grounded, CASE WHEN item_id % 3 = 0 THEN 'Guest ' || item_id END AS expect_guest FROM benchmark""")
def golden_source(spark, sf):
    i, path = F.col("item_id"), _fresh(spark, "golden")
    t.load(spark, sf, "benchmark").select(
        t.text_of("q", t.s(i)).alias("query_id"), F.col("text").alias("query"),
        F.when(i % 2 == 0, "in").otherwise("out").alias("category"), (i % 2 == 0).alias("expect_grounded"),
        F.when(i % 3 == 0, t.text_of("Guest ", t.s(i))).alias("expect_guest")).write.json(path)
    return evaluation.golden(spark, path)


@query("turn_log_source", """
SELECT 's' || conv_id AS scenario, turn AS turn_no, role AS category, CASE WHEN turn % 2 = 1 THEN 'search' END AS tool, text AS content
FROM conversations""")
def turn_log_source(spark, sf):
    path, turn = _fresh(spark, "turns"), F.col("turn")
    calls = F.when(turn % 2 == 1, F.array(F.struct(F.lit("search").alias("tool"), F.lit(True).alias("ok"))))
    t.load(spark, sf, "conversations").select(
        t.text_of("s", t.s(F.col("conv_id"))).alias("scenario"), F.col("role").alias("category"), turn.alias("turn_no"),
        calls.alias("tool_calls"), F.col("text").alias("content")).write.json(path)
    return evaluation.turn_log(spark, path).select(
        "scenario", "turn_no", "category", F.get("tool_calls", F.lit(0))["tool"].alias("tool"), "content")


@query("request_log_source", """
SELECT '/' || event_type AS name, count(*) AS n, round(sum(round(value)), 3) AS ms, count(*) FILTER (event_type = 'error') AS failures,
       epoch_us(max(ts)) // 1000000 AS last FROM events GROUP BY event_type""")
def request_log_source(spark, sf):
    """The log, written and read, and a summary of it through the JSON sink."""
    path, sink = _fresh(spark, "log"), _fresh(spark, "summary")
    t.load(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("GET").alias("type"), F.concat(F.lit("/"), "event_type").alias("name"),
        F.round("value").alias("ms"), (F.col("event_type") == "error").alias("failed")).write.json(path)
    evaluation.write_summary(evaluation.request_log(spark, path).groupBy("name").agg(
        F.count("*").alias("n"), F.round(F.sum("ms"), 3).alias("ms"), F.count_if("failed").alias("failures"),
        F.unix_timestamp(F.max("ts")).alias("last")), sink)
    return spark.read.schema("name string, n long, ms double, failures long, last long").json(sink)


# --- reports, markup, sessions ------------------------------------------------------

WIDTH = max(map(len, checks.NAMES.values()))


@query("check_report", f"""
WITH c AS (SELECT lang AS name, count(*) AS n, min(doc_id) AS first,
                  CASE WHEN count(*) % 3 = 0 THEN 'pass' WHEN count(*) % 3 = 1 THEN 'warn' ELSE 'fail' END AS status
           FROM documents GROUP BY lang),
o AS (SELECT *, row_number() OVER (ORDER BY name) AS no FROM c)
SELECT no, 0 AS sub, upper(status) || '  ' || rpad(name, {WIDTH}, ' ') || '  ' || n || ' rows' AS line FROM o
UNION ALL SELECT no, 1, repeat(' ', {WIDTH + 6}) || '  e.g. doc ' || first FROM o
UNION ALL SELECT 1048576, 0, count(*) || ' checks: ' || count(*) FILTER (status = 'pass') || ' passed, '
  || count(*) FILTER (status = 'warn') || ' warnings, ' || count(*) FILTER (status = 'fail') || ' failed' FROM o""")
def check_report(spark, sf):
    """A check per language, so that all three marks and the total can occur."""
    n = F.col("n")
    rows = t.load(spark, sf, "documents").groupBy(F.col("lang").alias("name")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"))
    rows = rows.withColumn("no", F.lit(1))
    less = rows.select(F.col("name").alias("_other"))  # a row per language: a handful
    placed = rows.join(F.broadcast(less), F.col("_other") <= F.col("name")).groupBy("name", "n", "first").agg(
        F.count("*").alias("no"))
    return checks.report(placed.select(
        "no", "name", F.when(n % 3 == 0, "pass").when(n % 3 == 1, "warn").otherwise("fail").alias("status"),
        t.text_of(t.s(n), " rows").alias("detail"), F.array(t.text_of("doc ", t.s(F.col("first")))).alias("examples")))


@query("html_clean_invariants", r"""
SELECT page_id, TRUE AS no_script, TRUE AS no_event, TRUE AS no_script_url, TRUE AS no_frame, TRUE AS stable, TRUE AS sizes FROM pages""")
def html_clean_invariants(spark, sf):
    """Whatever the page: nothing dangerous is left, cleaning twice changes nothing,
    and the report's sizes are those of the texts."""
    pages = quality._pages(spark, sf).select("page_id", F.lit("html").alias("kind"), F.col("raw").alias("content"))
    once = html_clean.sanitize(pages).select("page_id", F.lit("html").alias("kind"), "content", F.col("sanitizer_report").alias("r"))
    once = once.join(pages.select("page_id", F.length("content").alias("was")), "page_id")
    twice = html_clean.sanitize(once.select("page_id", "kind", "content")).select("page_id", F.col("content").alias("again"))
    c = F.lower("content")
    return once.join(twice, "page_id").select(
        "page_id", (~F.contains(c, F.lit("<script"))).alias("no_script"),
        (~F.regexp_like(c, F.lit(r"<[^>]*\son\w+\s*="))).alias("no_event"),
        (~F.regexp_like(c, F.lit(r"<[^>]*(href|src)\s*=\s*[\"']?\s*javascript:"))).alias("no_script_url"),
        (~F.regexp_like(c, F.lit("<(iframe|object|embed|form)"))).alias("no_frame"),
        (F.col("again") == F.col("content")).alias("stable"),
        ((F.col("r.original_bytes") == F.col("was")) & (F.col("r.sanitized_bytes") == F.length("content"))).alias("sizes"))


def _timed(spark, sf):
    return t.load(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role",
        F.timestamp_seconds(F.col("turn") * 61).alias("created_at"))


@query("session_detail_timed", """
SELECT conv_id AS session_id, 'Chat ' || conv_id AS title, turn AS message_id, role, turn * 61 AS seconds,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS message_count
FROM conversations""")
def session_detail_timed(spark, sf):
    m = _timed(spark, sf)
    s = m.select("session_id").distinct().withColumn("title", t.text_of("Chat ", t.s(F.col("session_id"))))
    return sessions.session_detail(s, m).select(
        "session_id", "title", "message_id", "role", F.unix_timestamp("created_at").alias("seconds"), "position", "message_count")


@query("session_artifacts", """
WITH a AS (SELECT page_id, page_id % 40 AS session_id, page_id % 7 AS day FROM pages)
SELECT session_id, page_id AS artifact_id, row_number() OVER (PARTITION BY session_id ORDER BY day DESC, page_id) AS position
FROM a WHERE session_id IN (SELECT conv_id FROM conversations)""")
def session_artifacts(spark, sf):
    """The artifact part of the session detail, newest first."""
    p = F.col("page_id")
    artifacts = t.load(spark, sf, "pages").select(
        (p % 40).alias("session_id"), p.alias("artifact_id"), F.lit(None).cast("long").alias("message_id"), F.lit("html").alias("kind"),
        F.col("url").alias("title"), F.timestamp_seconds((p % 7) * 86400).alias("created_at"))
    known = _timed(spark, sf).select("session_id").distinct()
    return sessions.session_artifacts(known, artifacts).select("session_id", "artifact_id", "position")
