"""Knowledge-base checks, each one row of (name, status, detail, n_bad, examples)."""

from __future__ import annotations

import heapq
from datetime import date
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions import text as tx
from turnstone.operators import dedup, keyword, vector
from turnstone.settings import DEFAULTS, Settings

EARLIEST = date(2019, 1, 1)  # fixed value: nothing was published before
EXAMPLES = 5
# The names the report lists checks under.
NAMES = {
    "match": "episode count matches the corpus",
    "shared": "no transcripts share a video id",
    "chunks": "every episode has chunks",
    "ordinals": "chunk ordinals are contiguous",
    "orphans": "no orphan chunks",
    "vectors": "no missing embeddings",
    "dimension": "embedding dimension is correct",
    "range": "publish dates are in range",
    "dated": "publish dates are present",
    "indexes": "retrieval indexes are usable",
    "terms": "every chunk has searchable text",
    "by_vector": "sample is reachable by vector search",
    "by_text": "sample is reachable by keyword search",
}


def _tally(batches):
    """Of a task's offenders the number and the first few, for one more round."""
    n, first = 0, []
    for batch in batches:
        examples = batch.column(0).to_pylist()
        n += len(examples)
        first = heapq.nsmallest(EXAMPLES, first + [e for e in examples if e is not None])
    yield pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([first], pa.list_(pa.string()))], names=["n", "first"])


def _check(name: str, bad: DataFrame, what: str, warn_only: bool = False) -> DataFrame:
    """``bad`` has one ``example`` text per offender. Counted and sampled in one pass
    over it; a task sends ``EXAMPLES`` texts at most."""
    tally = bad.select("example").mapInArrow(_tally, "n long, first array<string>")
    one = tally.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_bad"),
        F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, EXAMPLES).alias("examples"))
    worst = "warn" if warn_only else "fail"
    return one.select(
        F.lit(NAMES[name]).alias("name"),
        F.when(F.col("n_bad") == 0, F.lit("pass")).otherwise(F.lit(worst)).alias("status"),
        F.when(F.col("n_bad") == 0, F.lit("ok")).otherwise(
            F.concat(F.col("n_bad").cast("string"), F.lit(f" {what}"))).alias("detail"),
        "n_bad", "examples")


def _note(df: DataFrame, name: str, detail: str) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(NAMES[name]).alias("name"), F.lit("warn").alias("status"),
        F.lit(detail).alias("detail"), F.lit(0).cast("long").alias("n_bad"),
        F.array().cast("array<string>").alias("examples"))


def episodes_match(episodes: DataFrame, expected: DataFrame | int | None) -> DataFrame:
    """Against the ids the corpus yields, or against a count."""
    if expected is None:
        return _note(episodes, "match", "no reference count")
    if isinstance(expected, int):
        wrong = episodes.agg(F.count("*").alias("n")).where(F.col("n") != expected)
        return _check("match", wrong.select(F.col("n").cast("string").alias("example")),
                      f"count differs from {expected}")
    stale = episodes.join(expected, "video_id", "left_anti")
    missing = expected.join(episodes, "video_id", "left_anti")
    bad = stale.select("video_id").unionByName(missing.select("video_id"))
    return _check("match", bad.select(F.col("video_id").alias("example")), "stale or missing")


def shared_ids(decided: DataFrame | None, episodes: DataFrame) -> DataFrame:
    if decided is None:
        return _note(episodes, "shared", "corpus not available")
    bad = decided.where(F.col("decision") != dedup.KEEP)
    return _check("shared", bad.select(dedup.folder(F.col("source_path")).alias("example")),
                  "copies or borrowed metadata", warn_only=True)


def have_chunks(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    held = chunks.select("episode_id").distinct()  # combined before the shuffle
    bad = episodes.join(held, "episode_id", "left_anti")
    return _check("chunks", bad.select(F.col("video_id").alias("example")), "without chunks")


def ordinals_contiguous(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy("episode_id").agg(
        F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count("*").alias("n"))
    bad = per.where((F.col("low") != 0) | (F.col("high") + 1 != F.col("n")))
    return _check("ordinals", episodes.join(bad, "episode_id", "left_semi").select(
        F.col("video_id").alias("example")), "with gaps")


def _ids(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").cast("string").alias("example"))


def no_orphans(episodes: DataFrame, chunks: DataFrame) -> DataFrame:
    return _check("orphans", _ids(chunks.join(episodes, "episode_id", "left_anti")),
                  "without an episode")


def no_missing_vectors(chunks: DataFrame) -> DataFrame:
    bad = chunks.where(F.col("embedding").isNull() & ~F.col("is_sponsor"))
    return _check("vectors", _ids(bad), "not embedded")


def dimension(chunks: DataFrame, dim: int) -> DataFrame:
    return _check("dimension", _ids(chunks.where(F.size("embedding") != dim)),
                  f"vectors not {dim}-dimensional")


def dates_in_range(episodes: DataFrame, earliest: date, today: date) -> DataFrame:
    bad = episodes.where((F.col("publish_date") < F.lit(earliest))
                         | (F.col("publish_date") > F.lit(today)))
    return _check("range", bad.select(F.concat(
        "video_id", F.lit(" ("), F.col("publish_date").cast("string"), F.lit(")")
    ).alias("example")), f"dated outside {earliest}..{today}")


def dates_present(episodes: DataFrame) -> DataFrame:
    bad = episodes.where(F.col("publish_date").isNull())
    return _check("dated", bad.select(F.col("video_id").alias("example")), "without a date",
                  warn_only=True)


def indexes_usable(chunks: DataFrame, term_table: DataFrame, vector_table: DataFrame) -> DataFrame:
    """The derived tables hold exactly the chunks they should."""
    content = chunks.where(~F.col("is_sponsor"))
    by_text = keyword.with_terms(content).where(F.size("terms") > 0).select("chunk_id")
    by_vector = content.where(F.col("embedding").isNotNull()).select("chunk_id")
    bad = None
    for want, have in ((by_text, term_table), (by_vector, vector_table)):
        got = have.select("chunk_id").distinct()
        for part in (want.join(got, "chunk_id", "left_anti"), got.join(want, "chunk_id", "left_anti")):
            bad = part if bad is None else bad.unionByName(part)
    return _check("indexes", _ids(bad), "missing from or extra in a search table")


def searchable_text(chunks: DataFrame) -> DataFrame:
    bad = keyword.with_terms(chunks.where(~F.col("is_sponsor"))).where(F.size("terms") == 0)
    return _check("terms", _ids(bad), "without terms")


def sample(chunks: DataFrame, n: int) -> DataFrame:
    """The same ``n`` chunks every time: first by the md5 of their id."""
    return vector.searchable(chunks).orderBy(
        F.md5(F.col("chunk_id").cast("string")), "chunk_id").limit(n)


def found_by_vector(chunks: DataFrame, n: int = 20, settings: Settings = DEFAULTS) -> DataFrame:
    """Sampled chunks with ``found``: is its own id among the three nearest?"""
    asked = sample(chunks, n).select(
        F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = vector.nearest(asked, chunks.select("chunk_id", "embedding", "is_sponsor"), 3, settings)
    own = near.where(F.col("query_id") == F.col("chunk_id")).select(
        "query_id", F.lit(True).alias("found"))
    return asked.select("query_id").join(own, "query_id", "left").select(
        F.col("query_id").alias("chunk_id"), F.coalesce("found", F.lit(False)).alias("found"))


def found_by_text(chunks: DataFrame, n: int = 20, words: int = 12) -> DataFrame:
    """Sampled chunks with ``found``: do the stored terms hold the first words'
    terms? A phrase without terms asks nothing and counts as found."""
    rows = keyword.with_terms(sample(chunks, n))
    asked = tx.terms(tx.first_words(F.col("text"), words))
    return rows.select("chunk_id", (F.size(F.array_except(asked, "terms")) == 0).alias("found"))


def reachable(chunks: DataFrame, n: int = 20, settings: Settings = DEFAULTS) -> list[DataFrame]:
    if vector.searchable(chunks).isEmpty():
        return [_note(chunks, "by_vector", "no chunks to sample")]
    return [_check("by_vector", _ids(found_by_vector(chunks, n, settings).where(~F.col("found"))),
                   "not found by their own vector"),
            _check("by_text", _ids(found_by_text(chunks, n).where(~F.col("found"))),
                   "not found by their own text")]


def run_all(episodes: DataFrame, chunks: DataFrame, today: date, *,
            expected: DataFrame | int | None = None, decided: DataFrame | None = None,
            term_table: DataFrame | None = None, vector_table: DataFrame | None = None,
            earliest: date = EARLIEST, sample_size: int = 20,
            settings: Settings = DEFAULTS) -> DataFrame:
    """All checks as one table, in report order."""
    if term_table is None:
        term_table = keyword.with_terms(chunks.where(~F.col("is_sponsor"))).where(F.size("terms") > 0)
    if vector_table is None:
        vector_table = vector.searchable(chunks)
    rows = [
        episodes_match(episodes, expected), shared_ids(decided, episodes),
        have_chunks(episodes, chunks), ordinals_contiguous(episodes, chunks),
        no_orphans(episodes, chunks), no_missing_vectors(chunks),
        dimension(chunks, settings.dim), dates_in_range(episodes, earliest, today),
        dates_present(episodes), indexes_usable(chunks, term_table, vector_table),
        searchable_text(chunks), *reachable(chunks, sample_size, settings)]
    numbered = [r.withColumn("no", F.lit(i)) for i, r in enumerate(rows, 1)]
    return reduce(DataFrame.unionByName, numbered)


def report(checks: DataFrame) -> DataFrame:
    """Printable ``line`` per check, its examples under it, and a total."""
    mark = F.upper("status")
    width = max(map(len, NAMES.values()))
    head = F.concat(mark, F.lit("  "), F.rpad("name", width, " "), F.lit("  "), F.col("detail"))
    pad = " " * (6 + width)
    body = F.transform(F.slice("examples", 1, EXAMPLES),
                       lambda e: F.concat(F.lit(f"{pad}  e.g. "), e))
    lines = checks.select("no", F.posexplode(F.concat(F.array(head), body)).alias("sub", "line"))
    failed = F.count_if(F.col("status") == "fail")
    warned = F.count_if(F.col("status") == "warn")
    total = checks.agg(F.lit(1 << 20).alias("no"), F.lit(0).alias("sub"), F.format_string(
        "%d checks: %d passed, %d warnings, %d failed", F.count("*"),
        F.count("*") - failed - warned, warned, failed).alias("line"))
    return lines.unionByName(total)


def failed(checks: DataFrame) -> bool:
    """Should the caller exit with an error?"""
    return not checks.where(F.col("status") == "fail").isEmpty()

