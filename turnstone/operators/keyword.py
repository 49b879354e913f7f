"""Terms of chunks: the stored column, and one row per chunk and stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.functions import stem
from turnstone.functions import text as tx
from turnstone.operators.bounds import fits
from turnstone.operators.tables import stored
from turnstone.settings import DEFAULTS, Settings

PART_BYTES = 16 << 20  # of text, whose words one task counts


def with_terms(chunks: DataFrame) -> DataFrame:
    """The stored ``terms`` column, or the same computed on the fly."""
    if "terms" in chunks.columns:
        return chunks
    return chunks.withColumn("terms", tx.terms(F.col("text")))


def term_table(chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``chunk_id, length, term, tf``: terms are stems, computed once per distinct word."""
    kept = chunks.where(~F.col("is_sponsor")) if "is_sponsor" in chunks.columns else chunks
    terms = with_terms(kept).select("chunk_id", "terms")
    # As many parts as the text needs: a chunk's words are counted where they lie, and no
    # task's share grows with the table.
    width = F.octet_length("text") if "text" in kept.columns else F.size("terms") * 8
    size = kept.agg(F.sum(width).alias("b")).first().b or 0
    parts = max(kept.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    # explode would add a filter on the array's size, and with it a second pass over
    # the text; the outer form does not.
    said = terms.repartition(parts, "chunk_id").select(
        "chunk_id", F.size("terms").alias("length"), F.explode_outer("terms").alias("word")).where(F.col("word").isNotNull())
    counted = stored(said.groupBy("chunk_id", "length", "word").agg(F.count("*").alias("n")), "words")
    stems = stored(stem.with_stems(counted.select("word").distinct(), "word"), "stems")
    both = counted.join(F.broadcast(stems), "word") if fits(stems, settings) else counted.repartition(parts, "word").join(
        stems.repartition(parts, "word"), "word")
    return both.repartition(parts, "chunk_id").groupBy("chunk_id", "length", F.col("stem").alias("term")).agg(F.sum("n").alias("tf"))
