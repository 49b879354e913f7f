"""New transcript files picked up as they arrive."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnstone.operators.embed import HashedTerms
from turnstone.plans import ingest
from turnstone.settings import DEFAULTS, Settings
from turnstone.sources.store import Store
from turnstone.sources.transcripts import PATTERN


def start(spark: SparkSession, root: str, store: Store, checkpoint: str,
          make_encoder: Callable[[], object] = HashedTerms,
          settings: Settings = DEFAULTS) -> StreamingQuery:
    """Ingest what is there now and stop. A file source sees new paths, not edits
    in place, and one batch cannot compare its files with earlier ones: a file whose
    id another path has stored is a collision here. The batch job stays the authority
    for both. A batch retried after its commit is skipped; its run id carries the
    query's own id, which the checkpoint keeps, so no other stream can shadow it."""
    files = (spark.readStream.format("text").option("wholetext", "true")
             .load(f"{root.rstrip('/')}/{PATTERN}")
             .select(F.col("_metadata.file_path").alias("source_path"),
                     F.col("value").alias("raw")))

    def each(batch: DataFrame, batch_id: int) -> None:
        about = batch.sparkSession.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value
        run_id = f"stream-{json.loads(about)['id']}-{batch_id}"
        if not store.committed(run_id):
            done = ingest.run(batch.sparkSession, root, store, make_encoder=make_encoder,
                              settings=settings, run_id=run_id, files=batch)
            if done["status"] != "ok":
                raise RuntimeError(done["error"])

    return (files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
