"""Registered session, citation and turn-audit queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import citing
from turnstone.operators import citing_turns, sessions
from turnstone.plans.catalog import tables as t
from turnstone.streaming import spans

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _messages(spark, sf):
    return t.load(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role",
        F.col("text").alias("content"), F.col("turn").alias("created_at"))


def _sessions(spark, sf):
    c = F.col("conv_id")
    return t.load(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).select(
        c.alias("session_id"), t.text_of("Chat ", t.s(c)).alias("title"), (c * 10).alias("created_at"),
        (c * 10 + F.col("last") * 25).alias("updated_at"))


SESSIONS_SQL = """
sessions AS (SELECT conv_id AS session_id, 'Chat ' || conv_id AS title, conv_id * 10 AS created_at,
                    conv_id * 10 + max(turn) * 25 AS updated_at, count(*) AS message_count
             FROM conversations GROUP BY conv_id)"""


@query("session_list", t.with_sql(SESSIONS_SQL) + """
SELECT * FROM sessions ORDER BY updated_at DESC, session_id LIMIT 50 OFFSET 10""")
def session_list(spark, sf):
    return sessions.session_list(_sessions(spark, sf), _messages(spark, sf), 50, 10)


@query("session_detail", t.with_sql(SESSIONS_SQL) + """
SELECT session_id, title, message_count, turn AS message_id, role, text AS content, turn AS created_at,
       row_number() OVER (PARTITION BY session_id ORDER BY turn) AS position
FROM sessions JOIN conversations ON conv_id = session_id""")
def session_detail(spark, sf):
    return sessions.session_detail(_sessions(spark, sf), _messages(spark, sf))


@query("history_window", """
SELECT conv_id AS session_id, turn AS message_id, role, text AS content,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency
FROM conversations WHERE role IN ('user', 'assistant') QUALIFY recency <= 3""")
def history_window(spark, sf):
    return sessions.history_window(_messages(spark, sf), 3).drop("created_at")


@query("prompt_assembly", """
WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency
           FROM conversations WHERE role IN ('user', 'assistant') QUALIFY recency <= 4),
w AS (SELECT conv_id, string_agg(role || '>' || text, chr(10) ORDER BY turn) AS past FROM h GROUP BY conv_id)
SELECT c.conv_id AS session_id, concat_ws(chr(10), 'system>Be brief.', past, 'user>Next ' || c.conv_id) AS prompt
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w USING (conv_id)""")
def prompt_assembly(spark, sf):
    new = _sessions(spark, sf).select("session_id", t.text_of("Next ", t.s(F.col("session_id"))).alias("message"))
    made = sessions.prompts(new, _messages(spark, sf), "Be brief.", 4)
    return made.select("session_id", F.array_join(F.transform("prompt", lambda m: F.concat_ws(
        ">", m["role"], m["content"])), "\n").alias("prompt"))


@query("session_title", """
WITH o AS (SELECT conv_id, role, replace(trim(text, ' ' || chr(10) || chr(9)), chr(10), ' ') AS flat FROM conversations
           WHERE role IN ('user', 'assistant')
           QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1)
SELECT conv_id AS session_id, CASE WHEN role <> 'user' THEN 'New chat' WHEN length(flat) > 60 THEN left(flat, 60) || '...'
       ELSE flat END AS title FROM o""")
def session_title(spark, sf):
    return sessions.session_titles(_messages(spark, sf))


@query("append_turn", """
SELECT conv_id AS session_id, CAST(turn AS VARCHAR) AS message_id, role, text AS content FROM conversations
UNION ALL SELECT DISTINCT conv_id, 'n' || conv_id || ':0', 'user', 'Next ' || conv_id FROM conversations
UNION ALL SELECT DISTINCT conv_id, 'n' || conv_id || ':1', 'assistant', 'Reply' FROM conversations WHERE conv_id % 2 = 0""")
def append_turn(spark, sf):
    c = F.col("session_id")
    new = _sessions(spark, sf).select(
        c, t.text_of("Next ", t.s(c)).alias("message"), F.when(c % 2 == 0, F.lit("Reply")).alias("reply"),
        F.lit(1000).cast("bigint").alias("created_at"), t.text_of("n", t.s(c)).alias("turn_id"))
    old = _messages(spark, sf).withColumn("message_id", t.s(F.col("message_id")))
    return sessions.append_turn(old, new).drop("created_at")


@query("artifact_list", """
SELECT page_id AS artifact_id, page_id % 100 AS session_id, 'html' AS kind, url AS title, page_id * 7919 % 1009 AS created_at
FROM pages ORDER BY created_at DESC, artifact_id LIMIT 50""")
def artifact_list(spark, sf):
    p = F.col("page_id")
    return sessions.artifact_list(t.load(spark, sf, "pages").select(
        p.alias("artifact_id"), (p % 100).alias("session_id"), F.lit("html").alias("kind"),
        F.col("url").alias("title"), (p * 7919 % 1009).alias("created_at")))


@query("trace_list", """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS session_id, event_type AS name,
       CAST(floor(value) AS INTEGER) AS duration_ms, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok
FROM events ORDER BY ts, event_id LIMIT 200""")
def trace_list(spark, sf):
    e = t.load(spark, sf, "events").select(
        F.col("event_id").alias("id"), t.s(F.col("user_id")).alias("session_id"), F.lit("r").alias("request_id"),
        F.col("ts").alias("started_at"), F.col("event_type").alias("name"),
        F.floor("value").cast("int").alias("duration_ms"), (F.col("event_type") != "error").cast("int").alias("ok"))
    return spans.read(e, limit=200).select(t.s(F.col("id")).alias("id"), "session_id", "name", "duration_ms", "ok")


@query("kb_status", """
SELECT (SELECT count(*) FROM documents) AS episodes, (SELECT count(*) FROM documents) AS chunks,
       (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) AS embedded_chunks,
       (SELECT count(*) FROM documents JOIN embeddings ON vec_id = doc_id) > 0 AS ready,
       max_by(event_type, ts) AS last_run_status, CAST(max(ts) AS VARCHAR) AS last_run_finished_at FROM events""")
def kb_status(spark, sf):
    runs = t.load(spark, sf, "events").select(
        F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"))
    return sessions.kb_status(t.episodes(spark, sf), t.chunks(spark, sf), runs).withColumn(
        "last_run_finished_at", t.s(F.col("last_run_finished_at")))


# A message opens in one of five ways, by rule.
def _spoken():
    n, text = F.col("conv_id") + F.col("turn"), F.col("text")
    return (F.when(n % 5 == 0, t.text_of("Thanks ", text)).when(n % 5 == 1, F.lit("  How are you?! "))
            .when(n % 5 == 2, t.text_of("How are you going to build ", text))
            .when(n % 5 == 3, F.substring(text, 1, 3)).otherwise(t.text_of(text, " as a CheckList")))


@query("trivial_messages", """
SELECT conv_id, turn, (conv_id + turn) % 5 IN (0, 1, 3) AS is_trivial FROM conversations""")
def trivial_messages(spark, sf):
    return t.load(spark, sf, "conversations").select("conv_id", "turn", citing.is_trivial(_spoken()).alias("is_trivial"))


@query("document_requests", f"""
SELECT conv_id, turn, regexp_matches(lower(CASE (conv_id + turn) % 5 WHEN 1 THEN '' WHEN 3 THEN left(text, 3)
  WHEN 4 THEN text || ' checklist' ELSE text END), '{"|".join(citing.DOCUMENT_PHRASES)}') AS wants_document
FROM conversations""")
def document_requests(spark, sf):
    return t.load(spark, sf, "conversations").select(
        "conv_id", "turn", citing.asks_for_document(_spoken()).alias("wants_document"))


@query("cited_numbers", """
WITH d AS (SELECT doc_id, CAST(doc_id % 9 AS INTEGER) AS a, CAST(doc_id % 50 AS INTEGER) AS b, CAST(doc_id % 70 AS INTEGER) AS w FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([a, 7], CASE WHEN w <= 50 THEN range(b, b + w + 1) ELSE [] END,
       range(3, 6)))), ',') AS numbers FROM d""")
def cited_numbers(spark, sf):
    d = F.col("doc_id")
    said = t.text_of(F.col("text"), " [", t.s(d % 9), ", 7] [", t.s(d % 50), "-", t.s(d % 50 + d % 70),
                     "] [3–5][9-8] [2019-2023] [x](y)")
    return t.load(spark, sf, "documents").select("doc_id", F.array_join(
        F.transform(citing.cited_numbers(said), lambda n: n.cast("string")), ",").alias("numbers"))


# Events as searches: a user's turn has one search a day, which returns that day's events.
HITS_SQL = """
hits AS (SELECT user_id AS turn_id, CAST(dayofmonth(ts) AS INTEGER) AS search_no, event_id AS rank,
                CAST(floor(value) AS INTEGER) % 40 AS chunk_id FROM events),
firsts AS (SELECT turn_id, chunk_id, min(row(search_no, rank)) AS seen_at FROM hits GROUP BY ALL),
numbered AS (SELECT turn_id, chunk_id, row_number() OVER (PARTITION BY turn_id ORDER BY seen_at, chunk_id) AS n FROM firsts)"""


def _turn_hits(spark, sf):
    return t.load(spark, sf, "events").select(
        F.col("user_id").alias("turn_id"), F.dayofmonth("ts").alias("search_no"), F.col("event_id").alias("rank"),
        (F.floor("value").cast("int") % 40).alias("chunk_id"))


@query("passage_numbers", t.with_sql(HITS_SQL) + "SELECT * FROM numbered")
def passage_numbers(spark, sf):
    return citing_turns.number_passages(_turn_hits(spark, sf))


@query("turn_citations", t.with_sql(HITS_SQL) + """
SELECT turn_id, n, chunk_id FROM numbered WHERE turn_id % 10 <> 0 AND n IN (1, 3, 4, 5, 12 + turn_id % 5)
UNION ALL SELECT DISTINCT user_id, 1, 99 FROM events WHERE user_id % 10 = 0""")
def turn_citations(spark, sf):
    """Replies cite four fixed numbers and one by rule; some turns bring evidence of their own."""
    turns = t.load(spark, sf, "events").select(F.col("user_id").alias("turn_id")).distinct()
    reply = turns.select("turn_id", F.lit("As said [1, 3-4].").alias("text"))
    document = turns.select("turn_id", t.text_of("See [5] and [", t.s(12 + F.col("turn_id") % 5), "]").alias("text"))
    own = turns.where(F.col("turn_id") % 10 == 0).select("turn_id", F.lit(1).cast("bigint").alias("n"), F.lit(99).alias("chunk_id"))
    return citing_turns.cited_passages(_turn_hits(spark, sf), reply.unionByName(document), own)


@query("guard_audit", """
WITH e AS (
  SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('click', 'error') THEN 'document' ELSE 'search' END AS kind,
         event_type <> 'error' AND value > 60 AS ok, event_type = 'view' AND value > 150 AS grounded
  FROM events),
p AS (
  SELECT user_id, count(*) AS calls, min(seq) FILTER (kind = 'search' AND ok) AS s1, bool_or(grounded) FILTER (kind = 'search' AND ok) AS g,
         min(seq) FILTER (kind = 'document') AS d1, count(*) FILTER (kind = 'document') AS dc, count(*) FILTER (kind = 'document' AND ok) AS docs
  FROM e GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM events),
x AS (SELECT u.user_id, coalesce(calls, 0) AS calls, s1, coalesce(g, FALSE) AS g, d1, coalesce(dc, 0) AS dc, coalesce(docs, 0) AS docs,
             u.user_id % 7 = 0 AS triv, u.user_id % 3 = 1 AND u.user_id % 7 <> 0 AS wants, u.user_id % 4 = 2 AS refused
      FROM u LEFT JOIN p USING (user_id))
SELECT user_id AS turn_id, NOT triv AND s1 IS NULL AND docs = 0 AS answered_without_search,
       NOT triv AND d1 IS NOT NULL AND (s1 IS NULL OR d1 < s1) AS document_before_search, dc > 1 AS second_document,
       s1 IS NOT NULL AND NOT g AND NOT refused AS ungrounded_not_refused,
       wants AND docs = 0 AND (s1 IS NULL OR g) AS document_missing, triv AND calls > 0 AS tools_on_trivial
FROM x""")
def guard_audit(spark, sf):
    e = t.load(spark, sf, "events")
    kind, v = F.col("event_type"), F.col("value")
    events = e.select(
        F.col("user_id").alias("turn_id"), F.col("event_id").alias("seq"),
        F.when(kind.isin("click", "error"), F.lit("document")).otherwise(F.lit("search")).alias("kind"),
        ((kind != "error") & (v > 60)).alias("ok"), ((kind == "view") & (v > 150)).alias("grounded"))
    u = F.col("turn_id")
    turns = e.select(F.col("user_id").alias("turn_id")).distinct().select(
        u, F.when(u % 7 == 0, F.lit("Hello!")).when(u % 3 == 1, F.lit("Write a report on growth"))
        .otherwise(F.lit("What is growth about?")).alias("message"),
        F.when(u % 4 == 2, F.lit("The talks do not cover this.")).otherwise(F.lit("Growth is good.")).alias("reply"))
    return citing_turns.audit(events, turns)


@query("tool_call_text", """
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'search' WHEN 1 THEN 'create' WHEN 2 THEN 'search' WHEN 3 THEN 'create' END AS tool,
  CASE doc_id % 6 WHEN 0 THEN '{"query":"' || lang || '"}' WHEN 1 THEN '{"k":1}' WHEN 2 THEN '{}' WHEN 3 THEN '{}' END AS args
FROM documents""")
def tool_call_text(spark, sf):
    d, lang = F.col("doc_id"), F.col("lang")
    call = (F.when(d % 6 == 0, t.text_of('\n```json\n{"name": "search", "arguments": {"query": "', lang, '"}}\n```'))
            .when(d % 6 == 1, F.lit('\n```\n{"tool": "create", "parameters": "{\\"k\\":1}"}\n``` done'))
            .when(d % 6 == 2, F.lit(' {"name": "unknown"} then {"name": "search", "arguments": "nothing"}'))
            .when(d % 6 == 3, F.lit(' {"name": "create"}'))
            .when(d % 6 == 4, F.lit(' {"name": "search", oops}')).otherwise(F.lit(" {no call}")))
    found = citing.tool_call_in_text(t.text_of(F.col("text"), call), ["search", "create"])
    return t.load(spark, sf, "documents").select("doc_id", found.alias("c")).select("doc_id", "c.tool", "c.args")
