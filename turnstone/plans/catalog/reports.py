"""Registered checks, evaluation and load-report queries and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from turnstone.functions import text as tx
from turnstone.operators import checks, evaluate, hybrid, load_report
from turnstone.plans.catalog import search as cs
from turnstone.plans.catalog import tables as t
from turnstone.settings import Settings

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# --- knowledge-base checks: a store with one defect per check -----------------------

TODAY = date(2024, 6, 1)


def _broken(spark, sf):
    """Every 97th episode lost its chunk, every 89th chunk its episode, every 83rd
    chunk its ordinal, and every 71st vector a component."""
    e, c = t.episodes(spark, sf), t.chunks(spark, sf)
    i = F.col("episode_id")
    c = c.where(i % 97 != 5).withColumn(
        "ordinal", F.when(i % 83 == 7, F.lit(2)).otherwise(F.col("ordinal"))).withColumn(
        "embedding", F.when(F.col("chunk_id") % 71 == 9, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")))
    return e.where(i % 89 != 6).withColumn(
        "publish_date", F.when(i % 101 == 8, F.lit("2031-01-01").cast("date")).otherwise(F.col("publish_date"))), c


def _bad_sql(no, key, offenders, what, warn=False):
    name = checks.NAMES[key].replace("'", "''")
    return f"""SELECT {no} AS no, '{name}' AS name, CASE WHEN count(*) = 0 THEN 'pass' ELSE '{'warn' if warn else 'fail'}' END AS status,
  CASE WHEN count(*) = 0 THEN 'ok' ELSE count(*) || ' {what}' END AS detail, count(*) AS n_bad,
  coalesce(array_to_string(list_sort(list(example))[:5], '; '), '') AS examples FROM ({offenders})"""


CHECKS_SQL = t.with_sql(t.CHUNKS_SQL.replace("chunks AS", "chunks0 AS"), t.EPISODES_SQL.replace("episodes AS", "episodes0 AS"), f"""
chunks AS (SELECT * REPLACE (CASE WHEN chunk_id % 71 = 9 THEN embedding[:63] ELSE embedding END AS embedding),
    CASE WHEN episode_id % 83 = 7 THEN 2 ELSE 0 END AS ordinal, {t.terms_sql('text')} AS ts FROM chunks0 WHERE episode_id % 97 <> 5),
episodes AS (SELECT * REPLACE (CASE WHEN episode_id % 101 = 8 THEN DATE '2031-01-01' ELSE publish_date END AS publish_date)
    FROM episodes0 WHERE episode_id % 89 <> 6),
expected AS (SELECT video_id FROM episodes0 WHERE episode_id % 79 <> 3)""") + "\nUNION ALL\n".join([
    _bad_sql(1, "match", """SELECT video_id AS example FROM episodes WHERE video_id NOT IN (SELECT video_id FROM expected)
        UNION ALL SELECT video_id FROM expected WHERE video_id NOT IN (SELECT video_id FROM episodes)""", "stale or missing"),
    _bad_sql(2, "shared", "SELECT 'doc-' || doc_id AS example FROM documents WHERE doc_id % 53 = 4", "copies or borrowed metadata", True),
    _bad_sql(3, "chunks", "SELECT video_id AS example FROM episodes WHERE episode_id NOT IN (SELECT episode_id FROM chunks)", "without chunks"),
    _bad_sql(4, "ordinals", """SELECT video_id AS example FROM episodes JOIN chunks USING (episode_id) GROUP BY video_id
        HAVING max(ordinal) + 1 <> count(*) OR min(ordinal) <> 0""", "with gaps"),
    _bad_sql(5, "orphans", "SELECT CAST(chunk_id AS VARCHAR) AS example FROM chunks WHERE episode_id NOT IN (SELECT episode_id FROM episodes)", "without an episode"),
    _bad_sql(6, "vectors", "SELECT CAST(chunk_id AS VARCHAR) AS example FROM chunks WHERE embedding IS NULL AND NOT is_sponsor", "not embedded"),
    _bad_sql(7, "dimension", "SELECT CAST(chunk_id AS VARCHAR) AS example FROM chunks WHERE len(embedding) <> 64", "vectors not 64-dimensional"),
    _bad_sql(8, "range", """SELECT video_id || ' (' || publish_date || ')' AS example FROM episodes
        WHERE publish_date < DATE '2019-01-01' OR publish_date > DATE '2024-06-01'""", "dated outside 2019-01-01..2024-06-01"),
    _bad_sql(9, "dated", "SELECT video_id AS example FROM episodes WHERE publish_date IS NULL", "without a date", True),
    _bad_sql(10, "indexes", "SELECT CAST(chunk_id AS VARCHAR) AS example FROM chunks WHERE NOT is_sponsor AND len(ts) > 0 AND chunk_id % 61 = 0", "missing from or extra in a search table"),
    _bad_sql(11, "terms", "SELECT CAST(chunk_id AS VARCHAR) AS example FROM chunks WHERE NOT is_sponsor AND len(ts) = 0", "without terms"),
])


@query("kb_checks", CHECKS_SQL)
def kb_checks(spark, sf):
    e, c = _broken(spark, sf)
    expected = t.episodes(spark, sf).where(F.col("episode_id") % 79 != 3).select("video_id")
    decided = t.load(spark, sf, "documents").select(
        t.text_of("/c/doc-", t.s(F.col("doc_id")), "/transcript.md").alias("source_path"),
        F.when(F.col("doc_id") % 53 == 4, F.lit("duplicate")).otherwise(F.lit("keep")).alias("decision"))
    content = c.where(~F.col("is_sponsor"))
    terms = content.where((F.col("chunk_id") % 61 != 0) & (F.size(tx.terms(F.col("text"))) > 0)).select("chunk_id")
    vectors = content.where(F.col("embedding").isNotNull()).select("chunk_id")
    parts = [
        checks.episodes_match(e, expected), checks.shared_ids(decided, e), checks.have_chunks(e, c),
        checks.ordinals_contiguous(e, c), checks.no_orphans(e, c), checks.no_missing_vectors(c),
        checks.dimension(c, cs.DIM), checks.dates_in_range(e, checks.EARLIEST, TODAY), checks.dates_present(e),
        checks.indexes_usable(c, terms, vectors), checks.searchable_text(c)]
    return t.union([p.withColumn("no", F.lit(i)) for i, p in enumerate(parts, 1)]).withColumn(
        "examples", F.array_join("examples", "; "))


@query("kb_checks_clean", t.with_sql(t.CHUNKS_SQL, t.EPISODES_SQL) + f"""
SELECT 13 AS n_checks, 2 + CAST(EXISTS (SELECT 1 FROM chunks WHERE embedding IS NULL AND NOT is_sponsor) AS INTEGER)
  + CAST(EXISTS (SELECT 1 FROM episodes WHERE publish_date > DATE '2024-06-01') AS INTEGER)
  + CAST(EXISTS (SELECT 1 FROM chunks WHERE NOT is_sponsor AND len({t.terms_sql('text')}) = 0) AS INTEGER) AS not_passed""")
def kb_checks_clean(spark, sf):
    """All thirteen checks over the unbroken tables: undated episodes and the
    shared-id note stand out, and what the tables themselves lack."""
    e, c = t.episodes(spark, sf), t.chunks(spark, sf)
    rows = checks.run_all(e, c, TODAY, expected=e.select("video_id"), settings=Settings(dim=cs.DIM))
    return rows.agg(F.count("*").cast("int").alias("n_checks"), F.count_if(F.col("status") != "pass").alias("not_passed"))


@query("sample_reachable", t.with_sql(t.CHUNKS_SQL) + f"""
, asked AS (SELECT * FROM chunks WHERE embedding IS NOT NULL AND NOT is_sponsor ORDER BY md5(CAST(chunk_id AS VARCHAR)), chunk_id LIMIT 20),
near AS (
  SELECT a.chunk_id AS query_id, c.chunk_id, row_number() OVER (PARTITION BY a.chunk_id
     ORDER BY round(list_cosine_similarity(a.embedding, c.embedding), 9) DESC, c.chunk_id) AS rank
  FROM asked a JOIN chunks c ON c.embedding IS NOT NULL AND NOT c.is_sponsor QUALIFY rank <= 3),
firsts AS (SELECT chunk_id, text, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 12), ' ') AS phrase FROM asked)
SELECT f.chunk_id, EXISTS (SELECT 1 FROM near n WHERE n.query_id = f.chunk_id AND n.chunk_id = f.chunk_id) AS by_vector,
       list_has_all({t.terms_sql('text')}, {t.terms_sql('phrase')}) AS by_text FROM firsts f""")
def sample_reachable(spark, sf):
    c = t.chunks(spark, sf)
    v = checks.found_by_vector(c).withColumnRenamed("found", "by_vector")
    return v.join(checks.found_by_text(c).withColumnRenamed("found", "by_text"), "chunk_id")


# --- retrieval evaluation -----------------------------------------------------------

GOLDEN_SQL = """
golden AS (
  SELECT item_id AS query_id, CASE WHEN coalesce(quality, item_id % 2) = 1 THEN 'in_domain' ELSE 'out_of_domain' END AS category,
         coalesce(quality, item_id % 2) = 1 AS expect_grounded,
         CASE WHEN item_id % 3 = 0 THEN 'GUEST src' || (item_id % 20) END AS expect_guest
  FROM benchmark LEFT JOIN labels ON doc_id = item_id),
guests AS (SELECT query_id, list(guest ORDER BY rank) AS gs FROM hits h JOIN episodes e ON e.episode_id = h.chunk_id
           WHERE rank <= 5 GROUP BY query_id),
scored AS (
  SELECT g.query_id, category, expect_grounded, v.grounded AS actual_grounded, round(best_similarity, 4) AS best_similarity,
         coalesce(gs, []) AS gs, expect_guest,
         CASE WHEN expect_guest IS NOT NULL THEN v.grounded AND len(list_filter(coalesce(gs, []), lambda x: lower(x) = lower(expect_guest))) > 0 END AS guest_matched,
         v.grounded = expect_grounded AS correct
  FROM golden g JOIN verdicts v USING (query_id) LEFT JOIN guests USING (query_id))"""
EVAL_SQL = t.with_sql(*cs.FILTERED, *cs.HITS, cs.VERDICTS, GOLDEN_SQL)


def _scored(spark, sf):
    i = F.col("item_id")
    label = F.coalesce(F.col("quality"), (i % 2).cast("int"))
    golden = t.load(spark, sf, "benchmark").join(
        t.load(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality"), "item_id", "left").select(
        i.alias("query_id"), F.when(label == 1, F.lit("in_domain")).otherwise(F.lit("out_of_domain")).alias("category"),
        (label == 1).alias("expect_grounded"), F.when(i % 3 == 0, t.text_of("GUEST src", t.s(i % 20))).alias("expect_guest"))
    chunks, episodes = t.chunks(spark, sf), t.episodes(spark, sf)
    found = hybrid.search(t.queries(spark, sf, True), chunks, episodes, index=cs.stored_index(spark, sf))
    return evaluate.retrieval_rows(golden, found.verdicts, hybrid.enrich(found.hits, chunks, episodes))


@query("retrieval_eval", EVAL_SQL + "SELECT * EXCLUDE (gs), array_to_string(gs, '; ') AS top_guests FROM scored")
def retrieval_eval(spark, sf):
    return _scored(spark, sf).withColumn("top_guests", F.array_join("top_guests", "; "))


@query("retrieval_summary", EVAL_SQL + """,
s AS (SELECT count(*) AS n_questions, avg(CASE WHEN category = 'in_domain' THEN CAST(actual_grounded AS DOUBLE) END) AS grounded_answer_rate,
  avg(CASE WHEN category = 'out_of_domain' THEN CAST(actual_grounded AS DOUBLE) END) AS false_ground_rate,
  avg(CASE WHEN category = 'in_domain' AND expect_guest IS NOT NULL THEN CAST(guest_matched AS DOUBLE) END) AS guest_match_precision,
  min(CASE WHEN category = 'in_domain' THEN best_similarity END) - max(CASE WHEN category = 'out_of_domain' THEN best_similarity END) AS similarity_gap
  FROM scored)
SELECT n_questions, round(grounded_answer_rate, 6) AS grounded_answer_rate, round(false_ground_rate, 6) AS false_ground_rate,
  round(guest_match_precision, 6) AS guest_match_precision, round(similarity_gap, 4) AS similarity_gap,
  CASE WHEN grounded_answer_rate < 0.8 THEN 1 ELSE 0 END + CASE WHEN false_ground_rate > 0 THEN 1 ELSE 0 END AS n_failures,
  NOT (coalesce(grounded_answer_rate < 0.8, FALSE) OR coalesce(false_ground_rate > 0, FALSE)) AS passed FROM s""")
def retrieval_summary(spark, sf):
    s = evaluate.retrieval_summary(_scored(spark, sf))
    rates = ("grounded_answer_rate", "false_ground_rate", "guest_match_precision")
    return s.select("n_questions", *[F.round(r, 6).alias(r) for r in rates],
                    F.round("similarity_gap", 4).alias("similarity_gap"), F.size("failures").alias("n_failures"), "passed")


@query("latency_summary", """
SELECT event_type, n, round((v[(n + 1) // 2] + v[n // 2 + 1]) / 2, 6) AS p50, v[CAST(floor(0.95 * n) AS BIGINT) + 1] AS p95, v[n] AS max
FROM (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v FROM events GROUP BY event_type)""")
def latency_summary(spark, sf):
    s = evaluate.latency_summary(t.load(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")
    return s.withColumn("p50", F.round("p50", 6))


# --- request log --------------------------------------------------------------------

def _log(spark, sf):
    return t.load(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("GET").alias("type"), F.concat(F.lit("/"), "event_type").alias("name"),
        F.round("value").alias("ms"), (F.col("event_type") == "error").alias("failed"))


SUMMARY_SQL = """
log AS (SELECT ts, 'GET' AS type, '/' || event_type AS name, round(value) AS ms, event_type = 'error' AS failed FROM events),
span AS (SELECT epoch_us(max(ts)) / 1000000 - epoch_us(min(ts)) / 1000000 AS s FROM log),
summary AS (
  SELECT CASE WHEN grouping(name) = 1 THEN '' ELSE type END AS type, CASE WHEN grouping(name) = 1 THEN 'Aggregated' ELSE name END AS name,
    count(*) AS requests, count(*) FILTER (failed) AS failures, list_sort(list(ms)) AS v, count(*) AS n
  FROM log GROUP BY GROUPING SETS ((type, name), ())),
shaped AS (
  SELECT type, name, requests, failures, round(requests / s, 6) AS per_second, v[CAST(floor(0.5 * n) AS BIGINT) + 1] AS p50,
    v[CAST(floor(0.95 * n) AS BIGINT) + 1] AS p95, v[CAST(floor(0.99 * n) AS BIGINT) + 1] AS p99 FROM summary, span)"""


@query("request_summary", t.with_sql(SUMMARY_SQL) + "SELECT * FROM shaped")
def request_summary(spark, sf):
    return load_report.request_summary(_log(spark, sf)).withColumn("per_second", F.round("per_second", 6))


@query("load_gate", t.with_sql(SUMMARY_SQL) + """
SELECT requests, failures, round(failures / requests, 6) AS failure_ratio, p95,
  concat_ws(',', CASE WHEN failures / requests > 0.01 THEN 'failure_ratio' END, CASE WHEN p95 > 1500 THEN 'p95' END) AS breaches,
  failures / requests <= 0.01 AND p95 <= 1500 AS passed FROM shaped WHERE name = 'Aggregated'""")
def load_gate(spark, sf):
    return load_report.load_gate(load_report.request_summary(_log(spark, sf))).withColumn(
        "failure_ratio", F.round("failure_ratio", 6)).withColumn("breaches", F.concat_ws(",", "breaches"))


# --- scenarios: four documents each, as logged turns --------------------------------

TOOLS = ("search", "create", "essay", "other")


def _turn_log(spark, sf):
    d = F.col("doc_id")
    tools = F.array(*[F.lit(x) for x in TOOLS])
    calls = F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), 1, (d % 5).cast("int")), lambda i: F.struct(
        F.get(tools, ((d + i * i) % 4).cast("int")).alias("tool"), ((d + i) % 3 != 0).alias("ok")))
    return t.load(spark, sf, "documents").select(
        t.text_of("s", t.s(F.floor(d / 4))).alias("scenario"), F.col("lang").alias("_lang"),
        t.text_of("c", t.s(F.floor(d / 4) % 6)).alias("category"), (d % 4).cast("int").alias("turn_no"), calls.alias("tool_calls"),
        (d % 2 == 0).alias("grounded"), (d % 3).cast("int").alias("n_artifacts"),
        F.when(d % 7 == 0, F.lit("We do not cover this.")).otherwise(F.col("text")).alias("content"),
        F.when(d % 41 == 2, F.lit("timeout")).alias("error")).drop("_lang")


def _expectations(spark, sf):
    d = F.col("doc_id")
    some = lambda c, *xs: F.when(c, F.array(*[F.lit(x) for x in xs])).otherwise(F.array().cast("array<string>"))
    return t.load(spark, sf, "documents").select(
        t.text_of("s", t.s(F.floor(d / 4))).alias("scenario"), (d % 4).cast("int").alias("turn_no"),
        some(d % 5 == 1, "search", "essay").alias("any_of"), some(d % 5 == 2, "other").alias("forbidden"),
        F.when(d % 5 > 2, F.create_map(F.lit("search"), F.lit(1), F.lit("create"), F.lit(0))).alias("max_calls"),
        F.when(d % 6 == 0, d % 12 == 0).alias("grounded"), F.when(d % 6 == 3, d % 9 == 0).alias("artifact"),
        (d % 14 == 7).alias("refusal"), some(d % 8 == 1, "the ", "zzz").alias("forbidden_text"))


SCORED_SQL = """
log AS (
  SELECT doc_id AS d, 's' || (doc_id // 4) AS scenario, 'c' || (doc_id // 4 % 6) AS category, CAST(doc_id % 4 AS INTEGER) AS turn_no,
    list_transform(list_filter(range(0, doc_id % 5), lambda i: (doc_id + i) % 3 <> 0), lambda i: ['search', 'create', 'essay', 'other'][(doc_id + i * i) % 4 + 1]) AS ran,
    doc_id % 2 = 0 AS grounded, doc_id % 3 AS n_artifacts, CASE WHEN doc_id % 7 = 0 THEN 'We do not cover this.' ELSE text END AS content,
    doc_id % 41 = 2 AS failed FROM documents),
kept AS (SELECT * FROM log QUALIFY turn_no <= coalesce(min(CASE WHEN failed THEN turn_no END) OVER (PARTITION BY scenario), 99)),
scored AS (
  SELECT scenario, category, turn_no, CASE WHEN failed THEN ['provider_call_succeeded'] ELSE list_sort(list_filter([
      CASE WHEN d % 5 = 1 AND NOT list_has_any(ran, ['search', 'essay']) THEN 'expected_tool_called' END,
      CASE WHEN d % 5 = 2 AND list_contains(ran, 'other') THEN 'no_forbidden_tools' END,
      CASE WHEN d % 5 > 2 AND len(list_filter(ran, lambda x: x = 'search')) > 1 THEN 'no_redundant_search' END,
      CASE WHEN d % 5 > 2 AND list_contains(ran, 'create') THEN 'no_redundant_create' END,
      CASE WHEN d % 6 = 0 AND grounded <> (d % 12 = 0) THEN 'grounded_as_expected' END,
      CASE WHEN d % 6 = 3 AND (n_artifacts > 0) <> (d % 9 = 0) THEN 'artifact_as_expected' END,
      CASE WHEN d % 14 = 7 AND NOT contains(lower(content), 'do not cover') THEN 'refusal_language_present' END,
      CASE WHEN d % 8 = 1 AND (contains(content, 'the ') OR contains(content, 'zzz')) THEN 'no_forbidden_reply_patterns' END],
      lambda x: x IS NOT NULL)) END AS bad FROM kept)"""


def _scored_turns(spark, sf):
    return evaluate.score_turns(_turn_log(spark, sf), _expectations(spark, sf))


@query("scenario_eval", t.with_sql(SCORED_SQL) + """
SELECT scenario, category, turn_no, len(bad) = 0 AS correct, array_to_string(bad, ', ') AS failed_checks FROM scored""")
def scenario_eval(spark, sf):
    turns = _scored_turns(spark, sf)
    failed = evaluate.scenario_failures(turns)
    return turns.join(failed, ["scenario", "turn_no"], "left").select(
        "scenario", "category", "turn_no", "correct", F.coalesce("failed_checks", F.lit("")).alias("failed_checks"))


@query("scenario_rollup", t.with_sql(SCORED_SQL) + """
, r AS (SELECT scenario, category, bool_and(len(bad) = 0) AS correct FROM scored GROUP BY ALL)
SELECT category, round(avg(CAST(correct AS DOUBLE)), 6) AS pass_rate, count(*) AS n FROM r GROUP BY category
UNION ALL SELECT 'all', CAST(bool_and(correct) AS DOUBLE), count(*) FROM r""")
def scenario_rollup(spark, sf):
    scored = evaluate.scenarios(_scored_turns(spark, sf))
    gate = evaluate.scenario_gate(scored).select(
        F.lit("all").alias("category"), F.col("passed").cast("double").alias("pass_rate"), F.col("n_scenarios").alias("n"))
    return evaluate.category_rates(scored).withColumn("pass_rate", F.round("pass_rate", 6)).unionByName(gate)
