"""Registered essay, markup and admission queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.functions import admission, markup, rubric
from turnstone.operators import html_clean
from turnstone.plans.catalog import tables as t

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# --- essays: a document dressed up by rule ------------------------------------------

ESSAY_SQL = r"""
essays AS (
  SELECT doc_id, doc_id % 12 AS evidence,
    CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) ELSE '' END || text || chr(10)
    || CASE WHEN doc_id % 4 > 0 THEN '## One' || chr(10) || 'See [1] and [2].' || chr(10) || '## Two' || chr(10) || 'More [' || doc_id % 15 || '].' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 > 1 THEN '## Three' || chr(10) || '- point **bold**' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 7 = 0 THEN repeat('**b** ', 13) ELSE '' END
    || CASE WHEN doc_id % 11 = 0 THEN 'as in [N]' ELSE '' END AS essay
  FROM documents),
m AS (
  SELECT *, len(regexp_extract_all(essay, '\S+')) AS words, len(regexp_extract_all(essay, '(?m)^##\s+(.+)$')) AS sections,
    regexp_matches(essay, '(?m)^#\s+(.+)$') AS h1, len(regexp_extract_all(essay, '\*\*[^*]+\*\*')) AS bold,
    regexp_matches(essay, '(?m)^\s*([-*]|\d+\.)\s+') AS has_list, regexp_matches(essay, '(?i)\[n\]') AS holder,
    list_sort(list_distinct(list_transform(regexp_extract_all(essay, '\[(\d{1,2})\]', 1), lambda x: CAST(x AS INTEGER)))) AS cited,
    trim(regexp_replace(essay, '(?m)^#.*$', ''), ' ' || chr(10) || chr(9)) AS body
  FROM essays),
n AS (
  SELECT *, list_filter(cited, lambda c: c < 1 OR c > evidence) AS bad,
    CASE WHEN body = '' THEN 0 ELSE len(regexp_extract_all(
      CASE WHEN regexp_matches(body, '(?s)[.!?]\s') THEN regexp_extract(body, '(?s)^(.*?[.!?])\s', 1) ELSE body END, '\S+')) END AS hook
  FROM m),
checked AS (
  SELECT doc_id, words AS word_count, sections AS section_count, len(cited) AS citation_count, bold AS bold_count,
    array_to_string(bad, ',') AS invalid_citations,
    words BETWEEN 1050 AND 1450 AS word_count_in_range, h1 AS has_headline, hook BETWEEN 1 AND 25 AS hook_is_short,
    sections BETWEEN 3 AND 5 AS section_count_3_to_5, has_list, bold <= 12 AS bold_not_excessive,
    len(cited) >= 3 AS has_three_citations, len(bad) = 0 AS citations_in_range, NOT holder AS no_literal_placeholder_citations
  FROM n)"""


def _essays(spark, sf):
    d = F.col("doc_id")
    some = lambda c, text: F.when(c, text if not isinstance(text, str) else F.lit(text)).otherwise(F.lit(""))
    essay = t.text_of(
        some(d % 3 == 0, t.text_of("# Title ", t.s(d), "\n")), F.col("text"), "\n",
        some(d % 4 > 0, t.text_of("## One\nSee [1] and [2].\n## Two\nMore [", t.s(d % 15), "].\n")),
        some(d % 5 > 1, "## Three\n- point **bold**\n"), some(d % 7 == 0, "**b** " * 13), some(d % 11 == 0, "as in [N]"))
    docs = t.load(spark, sf, "documents").select("doc_id", (d % 12).alias("evidence"), essay.alias("essay"))
    measured = docs.withColumn("m", rubric.measures(F.col("essay"), F.col("evidence")))
    return measured.withColumn("c", rubric.checks(F.col("m")))


@query("rubric", t.with_sql(ESSAY_SQL) + "SELECT * FROM checked")
def essay_rubric(spark, sf):
    return _essays(spark, sf).select(
        "doc_id", "m.word_count", "m.section_count", "m.citation_count", "m.bold_count",
        F.concat_ws(",", F.transform("m.invalid_citations", lambda n: n.cast("string"))).alias("invalid_citations"), "c.*")


PASSED_SQL = " + ".join(f"CAST({c} AS INTEGER)" for c in rubric.CHECKS)


@query("rubric_fixes", t.with_sql(ESSAY_SQL) + f"SELECT doc_id, 9 - ({PASSED_SQL}) AS n_fixes FROM checked")
def rubric_fixes(spark, sf):
    return _essays(spark, sf).select("doc_id", F.size(rubric.fixes(F.col("m"), F.col("c"))).alias("n_fixes"))


@query("better_revision", t.with_sql(ESSAY_SQL) + f""",
p AS (SELECT doc_id, {PASSED_SQL} AS n FROM checked)
SELECT a.doc_id, b.n >= a.n AS keep_revision, greatest(a.n, b.n) AS n_passed FROM p a JOIN p b ON b.doc_id = a.doc_id + 1""")
def better_revision(spark, sf):
    """The next document's essay plays the revision."""
    p = _essays(spark, sf).select("doc_id", rubric.n_passed(F.col("c")).alias("n"))
    b = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m"))
    return p.join(b, "doc_id").select("doc_id", (F.col("m") >= F.col("n")).alias("keep_revision"),
                                      F.greatest("n", "m").alias("n_passed"))


@query("markdown_title", t.with_sql(ESSAY_SQL) + """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id ELSE 'Untitled ' || doc_id END AS title FROM essays""")
def markdown_title(spark, sf):
    return _essays(spark, sf).select("doc_id", rubric.markdown_title(
        F.col("essay"), t.text_of("Untitled ", t.s(F.col("doc_id")))).alias("title"))


# --- markup: pages with attacks added by rule ---------------------------------------

ATTACKS = (
    "", '<p onclick="x()">hi</p>', '<a href="JavaScript: alert(1)">x</a>', "<style>@import url(//e.test/x.css);p{color:red}</style>",
    '<div style="background:url( \'https://e.test/t.png\' )">x</div>', "<style>a{width:expression (alert(1))}</style>",
    '<img src="data:text/html;base64,AAAA">', "<IFRAME src=x></IFRAME><form><input></form>", "<SCRIPT>bad()</SCRIPT >after",
)
ATTACK_SQL = "CASE page_id % 9 " + " ".join(
    "WHEN {} THEN '{}'".format(i, a.replace("'", "''")) for i, a in enumerate(ATTACKS)) + " END"
PAGES_SQL = f"pages2 AS (SELECT page_id, html || {ATTACK_SQL} AS raw FROM pages)"
# The remote-reference rule without its look-ahead, which this dialect lacks: an
# address that starts with data: has no // right after it in this data.
REMOTE = r"url\(\s*[''\"]?\s*[a-z]*:?//[^)]*\)"
TAG = r"<\s*(script|iframe|object|embed|form|input|button|base|link|meta|applet|frame|frameset)\b"
NO_IMPORT = "regexp_replace(raw, '@import[^;]+;?', '', 'gi')"
NO_REMOTE = f"regexp_replace({NO_IMPORT}, '{REMOTE}', 'none', 'gi')"
SCRUBBED = rf"regexp_replace({NO_REMOTE}, 'expression\s*\(', 'none(', 'gi')"
BLOCK = r"<\s*script\b.*?<\s*/\s*script\s*>"
SCRIPT = r"(javascript|vbscript)\s*:"
NO_BLOCK = f"regexp_replace(raw, '{BLOCK}', '', 'gis')"
CLEAN_MD = f"regexp_replace({NO_BLOCK}, '{SCRIPT}', '', 'gi')"


def _pages(spark, sf):
    p = F.col("page_id")
    attack = F.get(F.array(*[F.lit(a) for a in ATTACKS]), (p % len(ATTACKS)).cast("int"))
    return t.load(spark, sf, "pages").select("page_id", F.concat("html", attack).alias("raw"))


@query("markup_findings", t.with_sql(PAGES_SQL) + rf"""
SELECT page_id, concat_ws(',', CASE WHEN regexp_matches({NO_REMOTE}, '(?i)expression\s*\(') THEN 'css_expression' END,
  CASE WHEN regexp_matches(raw, '(?i)@import[^;]+;?') THEN 'css_import' END,
  CASE WHEN regexp_matches({NO_IMPORT}, '(?i){REMOTE}') THEN 'css_remote_url' END,
  CASE WHEN regexp_matches(raw, '(?i){TAG}') THEN 'dangerous_tag' END,
  CASE WHEN contains(lower(raw), 'data:text/html') THEN 'data_html_url' END,
  CASE WHEN regexp_matches(raw, '(?i)\son[a-z]+\s*=') THEN 'event_handler_attribute' END,
  CASE WHEN regexp_matches(raw, '(?i){SCRIPT}') THEN 'javascript_url' END) AS findings
FROM pages2""")
def markup_findings(spark, sf):
    return _pages(spark, sf).select("page_id", F.concat_ws(",", markup.html_findings(F.col("raw"))).alias("findings"))


@query("css_scrub", t.with_sql(PAGES_SQL) + f"SELECT page_id, md5({SCRUBBED}) AS scrubbed FROM pages2")
def css_scrub(spark, sf):
    return _pages(spark, sf).select("page_id", F.md5(markup.scrub_css(F.col("raw"))).alias("scrubbed"))


@query("markdown_clean", t.with_sql(PAGES_SQL) + f"""
SELECT page_id, md5({CLEAN_MD}) AS cleaned, {CLEAN_MD} <> raw AS modified, 'markdown-strip' AS sanitizer,
  concat_ws(',', CASE WHEN regexp_matches({NO_BLOCK}, '(?i){SCRIPT}') THEN 'javascript_url' END,
            CASE WHEN regexp_matches(raw, '(?is){BLOCK}') THEN 'script_block' END) AS findings,
  length(raw) AS original_bytes, length({CLEAN_MD}) AS sanitized_bytes FROM pages2""")
def markdown_clean(spark, sf):
    raw = F.col("raw")
    cleaned = markup.clean_markdown(raw)
    return _pages(spark, sf).select("page_id", F.md5(cleaned).alias("cleaned"), markup.report(
        "markdown-strip", raw, cleaned, markup.markdown_findings(raw)).alias("r")).select(
        "page_id", "cleaned", "r.*").withColumn("findings", F.concat_ws(",", "findings"))


@query("html_clean")
def html_cleaned(spark, sf):
    pages = _pages(spark, sf).select("page_id", F.lit("html").alias("kind"), F.col("raw").alias("content"))
    return html_clean.sanitize(pages).select(
        "page_id", "content", "sanitizer_report.*").withColumn("findings", F.concat_ws(",", "findings"))


# --- admission ----------------------------------------------------------------------

@query("artifact_admission", """
WITH a AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN ' HTML ' WHEN 1 THEN 'markdown' WHEN 2 THEN 'pdf' WHEN 3 THEN NULL WHEN 4 THEN 'html' ELSE '' END AS kind,
         CASE WHEN page_id % 10 = 7 THEN '  ' WHEN page_id % 25 = 9 THEN repeat('é', 100001) ELSE html END AS content,
         CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN repeat('t', 400) ELSE url END AS title FROM pages)
SELECT page_id, CASE WHEN page_id % 6 IN (0, 4) THEN 'html' WHEN page_id % 6 = 2 THEN 'pdf' ELSE 'markdown' END AS kind,
  CASE WHEN title = '' THEN 'Untitled' ELSE left(title, 300) END AS title,
  CASE WHEN page_id % 6 = 2 THEN 'kind' WHEN trim(content) = '' THEN 'empty' WHEN strlen(content) > 200000 THEN 'too_large' END AS reject
FROM a""")
def artifact_admission(spark, sf):
    p = F.col("page_id")
    kind = F.get(F.array(*[F.lit(k) for k in (" HTML ", "markdown", "pdf", None, "html", "")]), (p % 6).cast("int"))
    content = F.when(p % 10 == 7, F.lit("  ")).when(p % 25 == 9, F.repeat(F.lit("é"), F.lit(100_001))).otherwise(F.col("html"))
    title = F.when(p % 4 == 0, F.lit("")).when(p % 4 == 1, F.repeat(F.lit("t"), F.lit(400))).otherwise(F.col("url"))
    rows = t.load(spark, sf, "pages").select("page_id", kind.alias("kind"), content.alias("content"), title.alias("title"))
    return rows.select("page_id", admission.artifact_kind(F.col("kind")).alias("kind"),
                       admission.artifact_title(F.col("title")).alias("title"),
                       admission.artifact_reject(F.col("kind"), F.col("content")).alias("reject"))


@query("record_admission", """
SELECT conv_id, turn,
  CASE WHEN n % 7 = 0 THEN 'nul' WHEN n % 7 = 1 THEN 'too_long' WHEN n % 7 = 2 THEN 'too_short' WHEN n % 7 = 3 THEN 'blank' END AS message,
  CASE WHEN length(text) > 1000 THEN 'too_long' END AS query, CASE WHEN length(text) > 200 THEN 'too_long' END AS guest,
  n % 3 = 0 AS json_nul, CASE WHEN turn % 4 > n % 5 THEN 'reversed_range' END AS range, CASE WHEN n NOT BETWEEN 1 AND 25 THEN 'out_of_range' END AS top_k
FROM (SELECT *, conv_id + turn AS n FROM conversations)""")
def record_admission(spark, sf):
    n, text = F.col("conv_id") + F.col("turn"), F.col("text")
    message = (F.when(n % 7 == 0, F.concat(text, F.lit("\x00"))).when(n % 7 == 1, F.rpad(text, 8001, "."))
               .when(n % 7 == 2, F.lit("")).when(n % 7 == 3, F.lit(" \t")).otherwise(text))
    json = F.when(n % 3 == 0, F.lit('{"a": ["x\\u0000"]}')).otherwise(F.lit('{"a": "\\\\u0000"}'))
    day = F.lit("2020-01-01").cast("date")
    return t.load(spark, sf, "conversations").select(
        "conv_id", "turn", admission.field_reject("message", message).alias("message"),
        admission.field_reject("query", text).alias("query"), admission.field_reject("guest", text).alias("guest"),
        admission.json_has_nul(json).alias("json_nul"),
        admission.range_reject(F.date_add(day, (F.col("turn") % 4).cast("int")), F.date_add(day, (n % 5).cast("int"))).alias("range"),
        admission.number_reject(n, admission.TOP_K_RANGE).alias("top_k"))
