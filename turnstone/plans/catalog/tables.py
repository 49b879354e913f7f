"""Episodes, chunks, queries and transcripts derived from the given tables, once
in Spark and once in SQL. Every derived value follows a plain rule of the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as tx
from turnstone.operators.bounds import broadcast_if_small, spread


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}  # tables whose rows are heavy work


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def text_of(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def s(c: Column) -> Column:
    return c.cast("string")


def start_seconds() -> Column:
    d = F.col("doc_id")
    return F.when(d % 13 != 0, d * 7 % 7200).cast("int")


def chunks(spark, sf_dir) -> DataFrame:
    """A document is a chunk; licence texts play the advertisements."""
    docs = load(spark, sf_dir, "documents")
    vectors = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding")
    return docs.join(vectors, "doc_id", "left").select(*_chunk(), "embedding")


def chunk_texts(spark, sf_dir) -> DataFrame:
    """The same rows without their vectors: a document once per vector of its number, or
    once. Only numbers that several vectors share are joined, not the texts to all vectors."""
    docs = load(spark, sf_dir, "documents")
    several = load(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1")
    return docs.join(broadcast_if_small(several), "doc_id", "left").withColumn(
        "_nth", F.explode(F.sequence(F.lit(1), F.coalesce("n", F.lit(1))))).select(*_chunk())


def _chunk() -> list[Column]:
    return [F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("episode_id"),
            F.lit(0).alias("ordinal"), F.col("source").alias("speaker"),
            start_seconds().alias("start_seconds"), start_seconds().alias("end_seconds"), F.col("text"),
            F.contains(F.lower("text"), F.lit("license")).alias("is_sponsor")]


def episodes(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    second = text_of(" + Guest src", s((d + 1) % 20))
    return docs.select(
        d.alias("episode_id"), text_of("v", s(d)).alias("video_id"),
        text_of("Guest ", F.col("source"), F.when(d % 4 == 0, second).otherwise(F.lit(""))).alias("guest"),
        text_of("Episode ", s(d)).alias("title"),
        F.when(d % 7 == 0, F.lit("")).when(d % 2 == 0, text_of("https://v.test/watch?v=", s(d)))
        .otherwise(text_of("https://v.test/", s(d))).alias("youtube_url"),
        F.when(d % 11 != 0, F.date_add(F.lit("2019-01-01").cast("date"), (d * 37 % 2000).cast("int"))
               ).alias("publish_date"))


def queries(spark, sf_dir, filtered: bool = False) -> DataFrame:
    """Every benchmark passage, with the vector of the same number if there is one;
    filtered, by guest, by date range, by an unknown guest or not."""
    i = F.col("item_id")
    bench = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    vectors = load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    q = bench.join(vectors, "item_id", "left").select(i.alias("query_id"), "query", "vector")
    if not filtered:
        return q
    i = F.col("query_id")
    return q.withColumns({
        "guest": F.when(i % 5 == 0, text_of("guest SRC", s(i % 20))).when(i % 5 == 2, F.lit("Nobody %")),
        "since": F.when(i % 5 == 1, F.lit("2021-01-01")).cast("date"),
        "until": F.when(i % 5 == 1, F.lit("2022-12-31")).when(i % 5 == 3, F.lit("2018-12-31")).cast("date")})


CHUNKS_SQL = """
chunks AS (
  SELECT d.doc_id AS chunk_id, d.doc_id AS episode_id, d.source AS speaker,
         CASE WHEN d.doc_id % 13 <> 0 THEN CAST(d.doc_id * 7 % 7200 AS INTEGER) END AS start_seconds,
         d.text, contains(lower(d.text), 'license') AS is_sponsor,
         CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

EPISODES_SQL = """
episodes AS (
  SELECT doc_id AS episode_id, 'v' || doc_id AS video_id,
         'Guest ' || source || CASE WHEN doc_id % 4 = 0
            THEN ' + Guest src' || ((doc_id + 1) % 20) ELSE '' END AS guest,
         'Episode ' || doc_id AS title,
         CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'https://v.test/watch?v=' || doc_id
              ELSE 'https://v.test/' || doc_id END AS youtube_url,
         CASE WHEN doc_id % 11 <> 0
              THEN CAST(DATE '2019-01-01' + CAST(doc_id * 37 % 2000 AS INTEGER) AS DATE) END AS publish_date
  FROM documents)"""

QUERIES_SQL = f"""
queries AS (
  SELECT b.item_id AS query_id, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS vector,
         CAST(NULL AS VARCHAR) AS guest, CAST(NULL AS DATE) AS since, CAST(NULL AS DATE) AS until
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""

FILTERED_SQL = f"""
queries AS (
  SELECT b.item_id AS query_id, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS vector,
         CASE b.item_id % 5 WHEN 0 THEN 'guest SRC' || (b.item_id % 20) WHEN 2 THEN 'Nobody %' END AS guest,
         CASE WHEN b.item_id % 5 = 1 THEN DATE '2021-01-01' END AS since,
         CASE b.item_id % 5 WHEN 1 THEN DATE '2022-12-31' WHEN 3 THEN DATE '2018-12-31' END AS until
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""

FILTER_SQL = """(q.guest IS NULL OR contains(lower(e.guest), lower(q.guest)))
        AND (q.since IS NULL OR coalesce(e.publish_date >= q.since, FALSE))
        AND (q.until IS NULL OR coalesce(e.publish_date <= q.until, FALSE))"""

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"


def terms_sql(column: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+'), "
            f"lambda t: NOT list_contains({STOP_SQL}, t))")


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# --- documents as transcripts -------------------------------------------------------

def doc_lines() -> Column:
    return F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda ln: ln != "")


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60),
                           seconds % 60)


def speaker(i: Column) -> Column:
    """Two lines each, in turn."""
    return F.when(F.floor(i / 2) % 2 == 0, F.lit("Speaker A")).otherwise(F.lit("Speaker B"))


def rendered(layout: str) -> Column:
    """A document written out as a transcript: one turn per line of its text."""
    at = lambda i: i * 7
    turn = {
        "header": lambda ln, i: text_of(speaker(i), " (", clock(at(i)), "):\n", ln),
        "inline": lambda ln, i: text_of("[", clock(at(i)), "] ", speaker(i), ": ", ln),
        "untimed": lambda ln, i: text_of(speaker(i), ":\n", ln),
    }[layout]
    return F.array_join(F.transform(doc_lines(), turn), "\n")


LINES_SQL = """
raw_lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS raw_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
lines AS (
  SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS text,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY raw_no) - 1 AS INTEGER) AS turn_no
  FROM raw_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
turns AS (
  SELECT doc_id, turn_no, text, turn_no * 7 AS start_seconds,
         CASE WHEN (turn_no // 2) % 2 = 0 THEN 'Speaker A' ELSE 'Speaker B' END AS speaker
  FROM lines)"""


# Fixed values for this data, which holds no advertisement phrases.
AD_OPENERS = ("license", "tion the ")
AD_FOLLOWERS = (" and ", " que ")


def either_sql(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + ")"


FLAGS_SQL = f"""
marked AS (
  SELECT *, {either_sql('text', AD_OPENERS)} AS o, {either_sql('text', AD_FOLLOWERS)} AS f,
         lag(speaker) OVER (PARTITION BY doc_id ORDER BY turn_no) AS before FROM turns),
runs AS (
  SELECT *, sum(CASE WHEN before IS DISTINCT FROM speaker OR NOT (o OR f) THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id ORDER BY turn_no) AS run FROM marked),
flagged AS (
  SELECT doc_id, turn_no, speaker, start_seconds, text,
         o OR (f AND bool_or(o) OVER (PARTITION BY doc_id, run ORDER BY turn_no)) AS is_sponsor FROM runs)"""


def union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
