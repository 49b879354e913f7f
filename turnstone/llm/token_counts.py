"""Token counts behind a cache of digests.

The cache is a Parquet folder of (tokenizer, digest, n_tokens): the digest is the
SHA-256 of the content the tokenizer sees, ``tokenizer`` that of its version.
Documents are joined to it by digest; only distinct contents it lacks are
encoded, and their counts are appended.

Cases. Null text is empty content: 0 tokens. Long texts are encoded whole.
Repeated contents are encoded once. Empty table: empty result, nothing appended.
Extra columns are not read. A run that fails before its append leaves the cache
as it was; one that appends what another run has appended too does no harm,
because readers take one count per digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.llm.common import first_per_task, pieces, utf8, written

FREQUENT = 10_000  # a content with over one row in so many is frequent, so there are fewer than so many
CACHE = "tokenizer string, digest binary, n_tokens long"
_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def counter_of(file: bytes, kind: str) -> Callable[[list[str]], list[int]]:
    """Counts by the library that belongs to the file; no special tokens added."""
    if kind == "json":
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(file.decode())
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if kind == "model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=file)
        return lambda texts: [len(sp.encode(t)) for t in texts]
    raise ValueError(f"no library for .{kind}")


def version_of(file: bytes, kind: str) -> str:
    """Digest of everything that decides a count: the library, its version, the file."""
    import sentencepiece
    import tokenizers

    used = {"json": tokenizers, "model": sentencepiece}[kind].__version__
    return hashlib.sha256(f"{kind} {used} ".encode() + file).hexdigest()


def _encoded(file, kind: str):
    """Counts of the first row of each digest a task sees."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hashlib.sha256(file.value).hexdigest()
        if key not in _loaded:
            _loaded[key] = counter_of(file.value, kind)
        count = _loaded[key]
        for batch in pieces(first_per_task("digest")(batches), 64):
            found = count([t.decode() for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["digest", "n_tokens"])

    return step


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; empty where nothing is stored yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    mine = stored.where(F.col("tokenizer") == version)
    return mine.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, tokenizer_path: str, cache_path: str, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encodes the distinct contents the cache lacks and appends their counts;
    returns the tokenizer's version.

    Before the texts shuffle by digest a task drops its own repeats, so a content
    that fills a third of the table adds one row per task to one partition."""
    spark = docs.sparkSession
    kind = tokenizer_path.rsplit(".", 1)[-1]
    raw = open(tokenizer_path, "rb").read()
    version, file = version_of(raw, kind), spark.sparkContext.broadcast(raw)
    content = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text"))
    once = texts.mapInArrow(first_per_task("digest"), "digest binary, text string")
    known = read_cache(spark, cache_path, version).select("digest")
    if not known.isEmpty():
        once = once.join(known, "digest", "left_anti")
    # Rows of a digest meet in one task, which encodes the first and skips the rest.
    counted = once.repartition("digest").mapInArrow(_encoded(file, kind), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return version


def counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    The counts of frequent contents are broadcast, so their rows are settled where they
    lie; by its definition there are fewer than ``FREQUENT``. The others meet by digest."""
    version = fill(docs, tokenizer_path, cache_path, doc_id, text)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"),
                       F.unhex(F.sha2(content, 256)).alias("digest"))
    rows = written(rows, "digests")
    known = read_cache(docs.sparkSession, cache_path, version)
    least = rows.count() / FREQUENT
    often = rows.groupBy("digest").agg(F.count("*").alias("_rows")).where(F.col("_rows") > F.greatest(F.lit(least), F.lit(1))).select("digest")
    often = written(known.join(often, "digest"), "frequent")
    settled = rows.join(F.broadcast(often), "digest")
    others = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(known, "digest", "left")
    return settled.unionByName(others).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
