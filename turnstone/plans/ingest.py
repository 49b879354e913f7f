"""Transcripts to a searchable knowledge base, as one job over all files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as tx
from turnstone.operators import dedup, embed, maintain, pack, parse
from turnstone.operators.bounds import merged
from turnstone.session import ensure_checkpoint_dir
from turnstone.settings import DEFAULTS, Settings
from turnstone.sources import transcripts
from turnstone.sources.store import RUNS, Conflict, Store

INGEST, UNCHANGED, COLLISION, PARSE_ERROR = "ingest", "unchanged", "collision", "parse_error"


def resolve(files: DataFrame, stored: DataFrame, force: bool = False,
            settings: Settings = DEFAULTS,
            same: dedup.BySequence | dedup.ByShingles | None = None) -> DataFrame:
    """Parsed files with their final ``video_id`` and ``outcome``: ingest,
    unchanged, duplicate or collision."""
    return outcomes(dedup.drop_borrowed(dedup.decide(files, settings, same)), stored, force)


def outcomes(decided: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    copies = decided.where(F.col("decision") == dedup.DUPLICATE)
    others = dedup.first_per_id(decided.where(F.col("decision") != dedup.DUPLICATE))
    known = stored.select("video_id", "content_hash", F.lit(True).alias("_known"))
    judged = others.join(merged(known), ["video_id", "content_hash"], "left").withColumn(
        "outcome",
        F.when(F.col("collides"), F.lit(COLLISION))
        .when(F.col("_known") & F.lit(not force), F.lit(UNCHANGED))
        .otherwise(F.lit(INGEST))).drop("_known", "collides")
    return judged.unionByName(copies.withColumn("outcome", F.lit(dedup.DUPLICATE)))


def keep_strangers(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """For a part of the corpus: a file whose id is stored from another path is a
    collision. The full run, which sees both files, decides between them."""
    other = stored.select("video_id", F.col("source_path").alias("_at"))
    strange = F.col("_at").isNotNull() & (F.col("_at") != F.col("source_path")) & (F.col("outcome") == INGEST)
    return resolved.join(other, "video_id", "left").withColumn(
        "outcome", F.when(strange, F.lit(COLLISION)).otherwise(F.col("outcome"))).drop("_at")


def expected_ids(resolved: DataFrame) -> DataFrame:
    """The ids the corpus is stored under: copies skipped, borrowed ids replaced."""
    return resolved.where(F.col("outcome") != dedup.DUPLICATE).select("video_id").distinct()


def episode_id(video_id):
    return F.sha2(video_id, 256)


def build_chunks(episodes: DataFrame, make_encoder: Callable[[], object],
                 settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks of episodes given with ``episode_id`` and ``body``. Map-only: no
    row leaves its task between the transcript and its embedded chunks."""
    turns = parse.parse_turns(episodes.select("episode_id", "body"), "body", settings)
    chunks = pack.pack_chunks(turns, "episode_id", settings=settings)
    chunks = chunks.withColumn(
        "chunk_id", F.sha2(F.concat_ws(":", "episode_id", "ordinal"), 256)
    ).withColumn("terms", tx.terms(F.col("text")))
    return embed.embed_passages(chunks, make_encoder)


def counters(outcomes: DataFrame, chunks_written: int) -> DataFrame:
    """One row of run counts from ``outcome`` per file."""
    done = F.count_if(F.col("outcome") == INGEST)
    return outcomes.agg(
        F.count("*").alias("episodes_seen"), done.alias("episodes_ingested"),
        (F.count("*") - done).alias("episodes_skipped"),
        F.lit(chunks_written).cast("long").alias("chunks_written"))


def run(spark: SparkSession, root: str, store: Store, force: bool = False,
        make_encoder: Callable[[], object] = embed.HashedTerms,
        settings: Settings = DEFAULTS, limit: int = 0, run_id: str | None = None,
        files: DataFrame | None = None) -> dict:
    """Ingest everything under ``root`` (or the given files) and log the run. A
    failure is logged as such, with nothing committed."""
    run_id = run_id or uuid.uuid4().hex
    started = datetime.now(timezone.utc)
    source = root
    try:
        row = _ingest(spark, files if files is not None else transcripts.scan(spark, root, limit),
                      store, force, make_encoder, settings, run_id, files is not None)
        summary = {"status": "ok", "error": None, **row}
    except Exception as exc:  # noqa: BLE001 - the run log must say what happened
        summary = {"status": "failed", "error": f"{type(exc).__name__}: {exc}",
                   "episodes_seen": 0, "episodes_ingested": 0, "episodes_skipped": 0,
                   "chunks_written": 0}
    store.log_run(spark.createDataFrame([{
        "run_id": run_id, "source": source, "started_at": started,
        "finished_at": datetime.now(timezone.utc), **summary}], RUNS))
    return {"run_id": run_id, **summary}


def _committed(store: Store, run_id: str, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> None:
    """Applies ``change`` to the last version; again where another writer was first."""
    for left in reversed(range(tries)):
        base = store.version()
        try:
            store.commit(change(store.episodes(base)), run_id, base)
            return
        except Conflict:
            if not left:
                raise


def _ingest(spark, files, store, force, make_encoder, settings, run_id, part) -> dict:
    ensure_checkpoint_dir(spark)
    # Read by the copy rounds, the outcomes, the packing and the counts: parsed once.
    parsed, errors = transcripts.parted(transcripts.read_files(files).checkpoint())
    stored = store.episodes()
    resolved = resolve(parsed, stored, force, settings)
    if part:
        resolved = keep_strangers(resolved, stored)
    resolved = resolved.checkpoint()
    new = resolved.where(F.col("outcome") == INGEST).withColumn(
        "episode_id", episode_id(F.col("video_id")))
    written = store.write_chunks(build_chunks(new, make_encoder, settings), run_id)
    store.write_index(run_id)
    fresh = new.withColumn("ingested_at", F.current_timestamp()).withColumn(
        "run_id", F.lit(run_id)).select(stored.columns)
    fresh = fresh.checkpoint()
    _committed(store, run_id, lambda now: maintain.upsert(now, fresh))
    every = resolved.select("outcome").unionByName(
        errors.select(F.lit(PARSE_ERROR).alias("outcome")))
    return counters(every, written).first().asDict()


def prune(spark: SparkSession, root: str, store: Store, subset: bool = False,
          settings: Settings = DEFAULTS) -> DataFrame:
    """Drop episodes no transcript maps to. Returns the table of ids dropped."""
    ensure_checkpoint_dir(spark)
    parsed, _ = transcripts.parted(transcripts.read_files(transcripts.scan(spark, root)).checkpoint())
    stored = store.episodes()
    expected = expected_ids(resolve(parsed, stored, settings=settings)).checkpoint()
    _, stale = maintain.prune(stored, expected, subset)
    stale = stale.select("video_id").checkpoint()
    if not stale.isEmpty():
        _committed(store, f"prune-{uuid.uuid4().hex}", lambda now: now.join(stale, "video_id", "left_anti"))
    return stale
