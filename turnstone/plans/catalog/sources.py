"""Registered transcript, packing, duplicate and maintenance queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from turnstone.functions import text as tx
from turnstone.operators import ad_blocks, dedup, maintain, pack, parse
from turnstone.plans import ingest
from turnstone.plans.catalog import tables as t
from turnstone.settings import DEFAULTS, Settings
from turnstone.sources import transcripts

QUERIES, ORACLES = {}, {}
ADS = Settings(ad_openers=t.AD_OPENERS, ad_followers=t.AD_FOLLOWERS)


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _docs(spark, sf):
    return t.load(spark, sf, "documents")


def _round_trip(layout):
    def run(spark, sf):
        written = _docs(spark, sf).select("doc_id", t.rendered(layout).alias("body"))
        return parse.explode_turns(parse.parse_turns(written, settings=ADS), "doc_id").select(
            "doc_id", "turn_no", "speaker", "start_seconds", "text", "is_sponsor")

    return run


for _layout, _time in (("header", "start_seconds"), ("inline", "start_seconds"), ("untimed", "CAST(NULL AS INTEGER)")):
    query(f"turns_roundtrip_{_layout}", t.with_sql(t.LINES_SQL, t.FLAGS_SQL) + f"""
SELECT doc_id, turn_no, speaker, {_time} AS start_seconds, text, is_sponsor FROM flagged""")(_round_trip(_layout))


@query("sponsor_flags", t.with_sql(t.LINES_SQL, t.FLAGS_SQL) + """
SELECT doc_id, turn_no, speaker, is_sponsor FROM flagged""")
def sponsor_flags(spark, sf):
    turns = _docs(spark, sf).select("doc_id", F.posexplode(t.doc_lines()).alias("turn_no", "text")).withColumn(
        "speaker", t.speaker(F.col("turn_no")))
    return ad_blocks.flag_ad_turns(turns, ["doc_id"], "turn_no", ADS).select(
        "doc_id", "turn_no", "speaker", "is_sponsor")


@query("token_estimate", r"""
SELECT doc_id, greatest(1, CAST(floor(n * CAST(1.3 AS DOUBLE)) AS INTEGER)) AS tokens, n AS n_words FROM (
  SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents)""")
def token_estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"),
                                   tx.word_count(F.col("text")).alias("n_words"))


@query("sentence_split", r"""
SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_no FROM (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)""")
def sentence_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    """Every other document is given DOS line ends first; the hash ignores them."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return _docs(spark, sf).select("doc_id", tx.content_hash(raw).alias("content_hash"))


def _raw_transcripts(spark, sf):
    """Documents as transcript files; some lack an id, a date or front matter."""
    d = F.col("doc_id")
    header = t.text_of(
        "---\nguest: Guest ", F.col("source"), "\ntitle: \"Doc: ", t.s(d), "\"\nvideo_id: ",
        F.when(d % 10 == 3, F.lit("''")).otherwise(t.text_of("v", t.s(d))),
        F.when(d % 6 == 1, F.lit("\nyoutube_url: https://v.test/x?v=1")).otherwise(F.lit("")),
        "\npublish_date: ", F.when(d % 9 == 4, F.lit("soon")).otherwise(
            t.s(F.date_add(F.lit("2019-01-01").cast("date"), (d % 2000).cast("int")))),
        "\nduration_seconds: ", F.when(d % 8 == 5, F.lit("long")).otherwise(t.s(d + 0.5)),
        "\nkeywords: ", F.when(d % 2 == 0, t.text_of("[", F.col("lang"), ", talk]")).otherwise(
            t.text_of("'", F.col("lang"), " , talk,'")), "\n---\n", F.col("text"))
    raw = F.when(d % 17 == 2, F.col("text")).when(d % 17 == 3, F.lit("---\nguest: none\n")).otherwise(header)
    return _docs(spark, sf).select(_path(d).alias("source_path"), raw.alias("raw"))


def _path(d):
    return F.format_string("/corpus/episodes/doc-%08d/transcript.md", d)


PATH_SQL = "printf('/corpus/episodes/doc-%08d/transcript.md', doc_id)"


@query("front_matter", f"""
SELECT {PATH_SQL} AS source_path,
  CASE WHEN doc_id % 10 = 3 THEN printf('slug:doc-%08d', doc_id) ELSE 'v' || doc_id END AS video_id,
  'Guest ' || source AS guest, 'Doc: ' || doc_id AS title,
  CASE WHEN doc_id % 6 = 1 THEN 'https://v.test/x?v=1' WHEN doc_id % 10 = 3 THEN ''
       ELSE 'https://www.youtube.com/watch?v=v' || doc_id END AS youtube_url,
  CASE WHEN doc_id % 9 <> 4 THEN CAST(CAST(DATE '2019-01-01' + CAST(doc_id % 2000 AS INTEGER) AS DATE) AS VARCHAR) END AS publish_date,
  CASE WHEN doc_id % 8 <> 5 THEN doc_id + 0.5 END AS duration_seconds,
  lang || '|talk' AS keywords, md5(chr(10) || text) AS body_md5
FROM documents WHERE doc_id % 17 NOT IN (2, 3)""")
def front_matter(spark, sf):
    good, _ = transcripts.parse_files(_raw_transcripts(spark, sf))
    return good.select("source_path", "video_id", "guest", "title", "youtube_url",
                       t.s(F.col("publish_date")).alias("publish_date"), "duration_seconds",
                       F.array_join("keywords", "|").alias("keywords"), F.md5("body").alias("body_md5"))


@query("parse_errors", f"""
SELECT {PATH_SQL} AS source_path, CASE doc_id % 17 WHEN 2 THEN 'missing' ELSE 'unterminated' END AS error
FROM documents WHERE doc_id % 17 IN (2, 3)""")
def parse_errors(spark, sf):
    return transcripts.parse_files(_raw_transcripts(spark, sf))[1]


# --- packing ------------------------------------------------------------------------

WORDS_SQL = "greatest(1, CAST(floor(len(regexp_extract_all({0}, '\\S+')) * CAST(1.3 AS DOUBLE)) AS INTEGER))"
# Long turns are cut into sentence groups, then runs of equal flag are packed; both by
# recursion over the position where the next group starts.
PACK_SQL = t.with_sql(t.LINES_SQL, t.FLAGS_SQL).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
sent AS (
  SELECT doc_id, turn_no, unnest(s) AS sentence, generate_subscripts(s, 1) AS k FROM (
    SELECT doc_id, turn_no, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s
    FROM flagged WHERE {WORDS_SQL.format('text')} > 60)),
sums AS (
  SELECT *, {WORDS_SQL.format('sentence')} AS c,
         sum({WORDS_SQL.format('sentence')}) OVER (PARTITION BY doc_id, turn_no ORDER BY k) AS upto FROM sent),
groups(doc_id, turn_no, a, b) AS (
  SELECT doc_id, turn_no, CAST(1 AS BIGINT), greatest(1, (SELECT coalesce(max(k), 1) FROM sums x
     WHERE x.doc_id = f.doc_id AND x.turn_no = f.turn_no AND x.upto <= 60))
  FROM (SELECT DISTINCT doc_id, turn_no FROM sums) f
  UNION ALL
  SELECT g.doc_id, g.turn_no, g.b + 1, greatest(g.b + 1, (SELECT coalesce(max(x.k), 0) FROM sums x
     WHERE x.doc_id = g.doc_id AND x.turn_no = g.turn_no AND x.upto - p.upto <= 60))
  FROM groups g JOIN sums p ON p.doc_id = g.doc_id AND p.turn_no = g.turn_no AND p.k = g.b
  WHERE EXISTS (SELECT 1 FROM sums x WHERE x.doc_id = g.doc_id AND x.turn_no = g.turn_no AND x.k = g.b + 1)),
parts AS (
  SELECT g.doc_id, g.turn_no, g.a, string_agg(s.sentence, ' ' ORDER BY s.k) AS text
  FROM groups g JOIN sent s ON s.doc_id = g.doc_id AND s.turn_no = g.turn_no AND s.k BETWEEN g.a AND g.b
  GROUP BY g.doc_id, g.turn_no, g.a
  UNION ALL SELECT doc_id, turn_no, 1, text FROM flagged WHERE {WORDS_SQL.format('text')} <= 60),
pieces AS (
  SELECT p.doc_id, f.speaker, f.start_seconds, f.is_sponsor, p.text, {WORDS_SQL.format('p.text')} AS c,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.turn_no, p.a) AS i
  FROM parts p JOIN flagged f ON f.doc_id = p.doc_id AND f.turn_no = p.turn_no),
segs AS (
  SELECT *, sum(CASE WHEN prev IS DISTINCT FROM is_sponsor THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg,
         sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT *, lag(is_sponsor) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM pieces)),
ends AS (SELECT doc_id, seg, min(i) AS first_i, max(i) AS last_i, min(upto - c) AS base FROM segs GROUP BY doc_id, seg),
spans(doc_id, seg, last_i, s, e) AS (
  SELECT d.doc_id, d.seg, d.last_i, d.first_i, greatest(d.first_i, (SELECT coalesce(max(x.i), 0) FROM segs x
     WHERE x.doc_id = d.doc_id AND x.seg = d.seg AND x.upto - d.base <= 60))
  FROM ends d
  UNION ALL
  SELECT doc_id, seg, last_i, ns, greatest(e + 1, (SELECT coalesce(max(x.i), 0) FROM segs x
     WHERE x.doc_id = n.doc_id AND x.seg = n.seg AND x.upto - n.before <= 60))
  FROM (
    SELECT m.*, (SELECT min(x.upto - x.c) FROM segs x WHERE x.doc_id = m.doc_id AND x.i = m.ns) AS before
    FROM (SELECT q.*, (SELECT coalesce(min(x.i), q.e + 1) FROM segs x
             WHERE x.doc_id = q.doc_id AND x.i BETWEEN q.s AND q.e AND l.upto - (x.upto - x.c) <= 20) AS ns
          FROM spans q JOIN segs l ON l.doc_id = q.doc_id AND l.i = q.e WHERE q.e < q.last_i) m) n),
chunks AS (
  SELECT s.doc_id, s.s, s.e, string_agg(x.speaker || ': ' || x.text, chr(10) || chr(10) ORDER BY x.i) AS text,
         min_by(x.speaker, x.i) AS speaker, min_by(x.start_seconds, x.i) AS start_seconds,
         max_by(x.start_seconds, x.i) AS end_seconds, bool_and(x.is_sponsor) AS is_sponsor
  FROM spans s JOIN segs x ON x.doc_id = s.doc_id AND x.i BETWEEN s.s AND s.e GROUP BY s.doc_id, s.s, s.e)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY e, s) - 1 AS ordinal, speaker, start_seconds, end_seconds,
       {WORDS_SQL.format('text')} AS token_count, is_sponsor, text
FROM chunks"""
PACKING = Settings(ad_openers=t.AD_OPENERS, ad_followers=t.AD_FOLLOWERS, target_tokens=60, overlap_tokens=20)


def _packed(spark, sf, settings):
    written = _docs(spark, sf).select("doc_id", t.rendered("header").alias("body"))
    return pack.pack_chunks(parse.parse_turns(written, settings=settings), "doc_id", settings=settings)


@query("chunk_pack", PACK_SQL)
def chunk_pack(spark, sf):
    """A small target, so that splitting, carrying and flag borders all occur."""
    return _packed(spark, sf, PACKING)


@query("chunk_pack_invariants", t.with_sql(t.LINES_SQL, t.FLAGS_SQL) + """
SELECT doc_id, bool_or(is_sponsor) AS has_ads, TRUE AS contiguous, TRUE AS in_budget, TRUE AS covers,
       min(start_seconds) AS first_second, max(start_seconds) AS last_second
FROM flagged GROUP BY doc_id""")
def chunk_pack_invariants(spark, sf):
    """Default target: ordinals without gaps, whole documents, bounded chunks. Speaker
    labels are not part of the budget, and one sentence over the target stays whole."""
    chunks = _packed(spark, sf, ADS)
    labels = F.regexp_count("text", F.lit(r"(?m)^Speaker [AB]: "))
    longest = F.array_max(F.transform(tx.sentences(F.col("text")), tx.token_estimate))
    per = chunks.groupBy("doc_id").agg(
        F.bool_or("is_sponsor").alias("has_ads"),
        ((F.min("ordinal") == 0) & (F.max("ordinal") + 1 == F.count("*"))).alias("contiguous"),
        F.bool_and((F.col("token_count") - 3 * labels <= 560) | (longest > 400)).alias("in_budget"),
        F.min("start_seconds").alias("first_second"), F.max("end_seconds").alias("last_second"))
    want = _docs(spark, sf).select("doc_id", (F.size(t.doc_lines()) * 7 - 7).alias("want"))
    return per.join(want, "doc_id").withColumn("covers", F.col("last_second") == F.col("want")).drop("want")


# --- shared ids ---------------------------------------------------------------------

def _files(spark, sf):
    """Documents under an id made of their first word and language, so that many
    share one; the title names some other source."""
    d = F.col("doc_id")
    first = F.lower(tx.first_word(F.col("text")))
    return _docs(spark, sf).select(
        _path(d).alias("source_path"), F.md5(F.concat_ws("/", first, "lang")).alias("video_id"),
        t.text_of("Guest ", F.col("source")).alias("guest"),
        t.text_of("A talk with guest src", t.s((d * 7 + 3) % 20), " again").alias("title"),
        F.lit("https://v.test/").alias("youtube_url"), F.lit("2020-01-01").cast("date").alias("publish_date"),
        F.lit(1.0).alias("duration_seconds"), F.lit("d").alias("description"),
        F.array(F.col("lang")).alias("keywords"), F.col("text").alias("body"), F.sha2("text", 256).alias("content_hash"))


FILES_SQL = rf"""
files AS (
  SELECT {PATH_SQL} AS source_path, doc_id, left(text, 3000) AS head, sha256(text) AS content_hash,
         md5(concat_ws('/', lower(regexp_extract(text, '(\S+)', 1)), lang)) AS video_id,
         'Guest ' || source AS guest, 'A talk with guest src' || ((doc_id * 7 + 3) % 20) || ' again' AS title
  FROM documents),
members AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY source_path) AS pos FROM files
  WHERE video_id IN (SELECT video_id FROM files GROUP BY video_id HAVING count(*) > 1)),
ws AS (SELECT *, regexp_extract_all(head, '\S+') AS w FROM members),
bags AS MATERIALIZED (SELECT *, list_distinct(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM ws),
grams AS (SELECT video_id, pos, unnest(g) AS gram FROM bags),
common AS (
  SELECT a.video_id, a.pos AS p, b.pos AS q, count(*) AS n FROM grams a JOIN grams b
    ON a.video_id = b.video_id AND a.gram = b.gram AND a.pos < b.pos GROUP BY ALL),
alike AS (
  SELECT c.video_id, c.p, c.q FROM common c JOIN bags a ON a.video_id = c.video_id AND a.pos = c.p
    JOIN bags b ON b.video_id = c.video_id AND b.pos = c.q
  WHERE n >= 0.5 * (len(a.g) + len(b.g) - n)
  UNION SELECT a.video_id, a.pos, b.pos FROM bags a JOIN bags b ON a.video_id = b.video_id AND a.pos < b.pos AND a.head = b.head),
near AS MATERIALIZED (SELECT video_id, q, list(p) AS ps FROM alike GROUP BY video_id, q),
walk(video_id, pos, kept) AS (
  SELECT DISTINCT video_id, CAST(1 AS BIGINT), [CAST(1 AS BIGINT)] FROM members
  UNION ALL
  SELECT w.video_id, w.pos + 1, CASE WHEN list_has_any(w.kept, coalesce(n.ps, [])) THEN w.kept ELSE list_append(w.kept, w.pos + 1) END
  FROM walk w JOIN members m ON m.video_id = w.video_id AND m.pos = w.pos + 1
  LEFT JOIN near n ON n.video_id = w.video_id AND n.q = w.pos + 1),
final AS (SELECT video_id, max_by(kept, pos) AS kept FROM walk GROUP BY video_id),
marked AS (
  SELECT m.*, list_contains(f.kept, m.pos) AS is_kept, len(f.kept) AS n_kept FROM members m JOIN final f USING (video_id)),
rivals AS (SELECT *, first_value(lower(title)) OVER (PARTITION BY video_id ORDER BY pos) AS first_title FROM marked WHERE is_kept AND n_kept > 1),
named AS (SELECT video_id, count(*) AS n, min(source_path) AS owner_path, min(lower(guest)) AS owner
          FROM rivals WHERE contains(first_title, lower(guest)) GROUP BY video_id HAVING count(*) = 1),
owners AS (SELECT n.video_id, owner_path FROM named n WHERE NOT EXISTS (
  SELECT 1 FROM rivals r WHERE r.video_id = n.video_id AND r.source_path <> n.owner_path AND contains(lower(r.guest), n.owner))),
decided AS (
  SELECT f.source_path, f.video_id AS old_id, f.content_hash,
         CASE WHEN m.source_path IS NULL THEN 'keep' WHEN NOT m.is_kept THEN 'duplicate'
              WHEN m.n_kept > 1 AND o.owner_path IS DISTINCT FROM f.source_path THEN 'borrowed' ELSE 'keep' END AS decision
  FROM files f LEFT JOIN marked m ON m.source_path = f.source_path LEFT JOIN owners o ON o.video_id = f.video_id),
named_again AS (
  SELECT *, CASE decision WHEN 'borrowed' THEN 'slug:' || string_split(source_path, '/')[-2] ELSE old_id END AS video_id FROM decided),
stored AS (
  SELECT video_id, CASE WHEN substr(content_hash, 1, 1) < '4' THEN content_hash || 'x' ELSE content_hash END AS content_hash
  FROM named_again WHERE decision <> 'duplicate' AND substr(content_hash, 2, 1) < 'c'),
outcomes AS (
  SELECT n.source_path, n.video_id, CASE
    WHEN decision = 'duplicate' THEN 'duplicate'
    WHEN source_path > min(CASE WHEN decision <> 'duplicate' THEN source_path END) OVER (PARTITION BY n.video_id) THEN 'collision'
    WHEN EXISTS (SELECT 1 FROM stored s WHERE s.video_id = n.video_id AND s.content_hash = n.content_hash) THEN 'unchanged'
    ELSE 'ingest' END AS outcome
  FROM named_again n)"""
RECURSIVE = t.with_sql(FILES_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
WHOLE = RECURSIVE.replace("left(text, 3000)", "text")
FIRST = replace(DEFAULTS, compare_chars=3000)  # ingest_run_counts, whose SQL compares that much
SAME = dedup.ByShingles(0.5)


def _stored(resolved_like):
    """What an earlier run left: three of four episodes, some since edited."""
    kept = resolved_like.where((F.col("decision") != dedup.DUPLICATE) & (F.substring("content_hash", 2, 1) < "c"))
    edited = F.when(F.substring("content_hash", 1, 1) < "4", F.concat("content_hash", F.lit("x"))).otherwise(
        F.col("content_hash"))
    return kept.select("video_id", edited.alias("content_hash"))


@query("duplicate_sources", WHOLE + "SELECT source_path, decision FROM decided")
def duplicate_sources(spark, sf):
    return dedup.decide(_files(spark, sf), same=SAME).select("source_path", "decision")


@query("duplicate_sources_whole", WHOLE + "SELECT source_path, decision FROM decided")
def duplicate_sources_whole(spark, sf):
    """Copies by their whole texts, not their first characters."""
    return dedup.decide(_files(spark, sf), replace(DEFAULTS, compare_chars=0), same=SAME).select("source_path", "decision")


@query("duplicate_by_sequence", f"""
WITH f AS (SELECT {PATH_SQL} AS source_path, doc_id // 8 AS g, doc_id % 2 = 0 AS same FROM documents)
SELECT source_path, CASE WHEN same AND source_path > min(source_path) FILTER (same) OVER (PARTITION BY g) THEN 'duplicate' ELSE 'keep' END AS decision
FROM f QUALIFY count(*) OVER (PARTITION BY g) > 1""")
def duplicate_by_sequence(spark, sf):
    """The default rule on what SQL can judge too: eight files share an id, half of
    them one text, the others digests that have little in common."""
    d = F.col("doc_id")
    digest = F.concat(*[F.sha2(t.text_of(t.s(d), f" {k}"), 256) for k in range(4)])
    same = F.repeat(t.text_of("the same talk under ", t.s(F.floor(d / 8)), ", "), F.lit(10))
    return dedup.decide_copies(_docs(spark, sf).select(
        _path(d).alias("source_path"), t.s(F.floor(d / 8)).alias("video_id"), F.when(d % 2 == 0, same).otherwise(digest).alias("body")))


@query("metadata_owner", t.with_sql(f"""
files AS (SELECT {PATH_SQL} AS source_path, md5(concat_ws('/', lower(regexp_extract(text, '(\\S+)', 1)), lang)) AS video_id,
  'Guest ' || source AS guest, 'A talk with guest src' || ((doc_id * 7 + 3) % 20) || ' again' AS title FROM documents),
firsts AS (SELECT *, first_value(lower(title)) OVER (PARTITION BY video_id ORDER BY source_path) AS first_title FROM files),
named AS (SELECT video_id, min(source_path) AS owner_path, min(lower(guest)) AS owner FROM firsts
  WHERE contains(first_title, lower(guest)) GROUP BY video_id HAVING count(*) = 1)""") + """
SELECT n.video_id, owner_path FROM named n WHERE NOT EXISTS (SELECT 1 FROM files f
  WHERE f.video_id = n.video_id AND f.source_path <> n.owner_path AND contains(lower(f.guest), n.owner))""")
def metadata_owner(spark, sf):
    return dedup.metadata_owners(_files(spark, sf))


@query("borrowed_metadata", WHOLE + """
SELECT source_path, video_id, decision, CASE decision WHEN 'borrowed' THEN 'Untitled episode' ELSE 'A talk with guest src'
    || ((CAST(string_split(source_path, '-')[2][:8] AS INTEGER) * 7 + 3) % 20) || ' again' END AS title,
  CASE decision WHEN 'borrowed' THEN '' ELSE 'https://v.test/' END AS youtube_url,
  CASE WHEN decision <> 'borrowed' THEN '2020-01-01' END AS publish_date, content_hash
FROM named_again""")
def borrowed_metadata(spark, sf):
    return dedup.drop_borrowed(dedup.decide(_files(spark, sf), same=SAME)).select(
        "source_path", "video_id", "decision", "title", "youtube_url",
        t.s(F.col("publish_date")).alias("publish_date"), "content_hash")


def _resolved(spark, sf, settings=DEFAULTS):
    decided = dedup.drop_borrowed(dedup.decide(_files(spark, sf), settings, same=SAME)).checkpoint()
    return ingest.outcomes(decided, _stored(decided))


@query("ingest_outcomes", WHOLE + "SELECT source_path, video_id, outcome FROM outcomes")
def ingest_outcomes(spark, sf):
    return _resolved(spark, sf).select("source_path", "video_id", "outcome")


@query("ingest_run_counts", RECURSIVE + f"""
SELECT count(*) AS episodes_seen, count(*) FILTER (outcome = 'ingest') AS episodes_ingested,
       count(*) FILTER (outcome <> 'ingest') AS episodes_skipped,
       (SELECT count(*) FROM ({PACK_SQL}) p JOIN files USING (doc_id) JOIN outcomes USING (source_path) WHERE outcome = 'ingest') AS chunks_written
FROM outcomes""")
def ingest_run_counts(spark, sf):
    """The chunks are those the ingested documents pack into."""
    outcomes = _resolved(spark, sf, FIRST).select("source_path", "outcome").checkpoint()
    new = outcomes.where(F.col("outcome") == ingest.INGEST)
    paths = _docs(spark, sf).select("doc_id", _path(F.col("doc_id")).alias("source_path"))
    written = _packed(spark, sf, PACKING).join(paths, "doc_id").join(new, "source_path", "left_semi").count()
    return ingest.counters(outcomes, written)


@query("expected_ids", WHOLE + "SELECT DISTINCT video_id FROM named_again WHERE decision <> 'duplicate'")
def expected_ids(spark, sf):
    return ingest.expected_ids(_resolved(spark, sf))


# --- stored episodes ----------------------------------------------------------------

def _now(spark, sf):
    return _docs(spark, sf).select(t.text_of("v", t.s(F.col("doc_id"))).alias("video_id"),
                                   F.sha2("text", 256).alias("content_hash"), "doc_id", "source")


def _before(spark, sf):
    d = F.col("doc_id")
    was = F.when(d % 5 == 0, F.concat("content_hash", F.lit("old"))).otherwise(F.col("content_hash"))
    return _now(spark, sf).where(d % 7 != 0).select("video_id", was.alias("content_hash"), "doc_id",
                                                    t.text_of("was ", F.col("source")).alias("source"))


BEFORE_SQL = """
now AS (SELECT 'v' || doc_id AS video_id, sha256(text) AS content_hash, doc_id, source FROM documents),
before AS (SELECT video_id, CASE WHEN doc_id % 5 = 0 THEN content_hash || 'old' ELSE content_hash END AS content_hash,
                  doc_id, 'was ' || source AS source FROM now WHERE doc_id % 7 <> 0)"""


@query("changed_sources", t.with_sql(BEFORE_SQL) + """
SELECT video_id, content_hash FROM now n WHERE NOT EXISTS (
  SELECT 1 FROM before b WHERE b.video_id = n.video_id AND b.content_hash = n.content_hash)""")
def changed_sources(spark, sf):
    return maintain.changed(_now(spark, sf), _before(spark, sf)).select("video_id", "content_hash")


@query("upsert_episodes", t.with_sql(BEFORE_SQL) + """
SELECT n.video_id, n.content_hash, CASE WHEN n.content_hash = b.content_hash THEN b.source ELSE n.source END AS source
FROM now n LEFT JOIN before b USING (video_id)""")
def upsert_episodes(spark, sf):
    before = _before(spark, sf)
    return maintain.upsert(before, maintain.changed(_now(spark, sf), before)).select(
        "video_id", "content_hash", "source")


@query("prune_stale", """
SELECT 'v' || doc_id AS video_id, doc_id % 3 <> 0 AS kept, len(string_split(text, chr(10))) AS n_chunks FROM documents""")
def prune_stale(spark, sf):
    """A third of the sources is gone; their chunks (lines) go with them."""
    docs = _docs(spark, sf).select("doc_id", t.text_of("v", t.s(F.col("doc_id"))).alias("video_id"), "text")
    episodes = docs.select("video_id", F.col("doc_id").alias("episode_id"))
    lines = docs.select(F.col("doc_id").alias("episode_id"), F.explode(F.split("text", "\n")).alias("line"))
    kept, stale = maintain.prune(episodes, docs.where(F.col("doc_id") % 3 != 0).select("video_id"))
    parts = [e.withColumn("kept", F.lit(k)).join(
        maintain.chunks_of(e, lines).groupBy("episode_id").agg(F.count("*").alias("n_chunks")), "episode_id")
        for e, k in ((kept, True), (stale, False))]
    return t.union(parts).select("video_id", "kept", "n_chunks")


@query("cascade_delete", """
WITH m AS (SELECT conv_id AS session_id, conv_id * 100 + turn AS message_id, turn FROM conversations),
a AS (SELECT page_id AS artifact_id, p.page_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS session_id,
        (p.page_id % (SELECT count(DISTINCT conv_id) FROM conversations)) * 100 + p.page_id % 3 AS message_id FROM pages p)
SELECT 'message' AS kind, message_id AS id, session_id, CAST(NULL AS BIGINT) AS message_id FROM m WHERE session_id % 4 <> 1 AND turn <> 1
UNION ALL
SELECT 'artifact', artifact_id, session_id, CASE WHEN message_id IN (SELECT message_id FROM m WHERE turn = 1) THEN NULL ELSE message_id END
FROM a WHERE session_id % 4 <> 1""")
def cascade_delete(spark, sf):
    """Every fourth session is deleted, then the second message of all others."""
    c = t.load(spark, sf, "conversations")
    messages = c.select(F.col("conv_id").alias("session_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), "turn")
    sessions = messages.select("session_id").distinct()
    n = sessions.agg(F.count("*").alias("n")).scalar()
    p = F.col("page_id")
    artifacts = t.load(spark, sf, "pages").select(p.alias("artifact_id"), (p % n).alias("session_id")).withColumn(
        "message_id", F.col("session_id") * 100 + F.col("artifact_id") % 3)
    gone = sessions.where(F.col("session_id") % 4 == 1)
    _, messages, artifacts = maintain.delete_sessions(sessions, messages, artifacts, gone)
    messages, artifacts = maintain.delete_messages(messages, artifacts, messages.where("turn = 1"))
    return messages.select(F.lit("message").alias("kind"), F.col("message_id").alias("id"), "session_id",
                           F.lit(None).cast("bigint").alias("message_id")).unionByName(
        artifacts.select(F.lit("artifact").alias("kind"), F.col("artifact_id").alias("id"), "session_id", "message_id"))
