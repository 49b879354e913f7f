"""Session settings the jobs rely on, applied to a builder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def packed(folder: str | None = None) -> str:
    """This package as a zip that Spark hands to every Python worker."""
    root = Path(__file__).resolve().parent
    made = Path(folder or tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))) / f"{root.name}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    return str(made)


def builder(app: str = "turnstone", master: str | None = None) -> SparkSession.Builder:
    """AQE sizes reducers from ``advisoryPartitionSizeInBytes``; the initial
    partition count is left to the cluster's own default. The package travels with
    the session, so workers need not have it installed."""
    package = packed()
    b = (
        SparkSession.builder.appName(app)
        .config("spark.files", package)
        .config("spark.submit.pyFiles", package)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    return b.master(master) if master else b


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where the
    session names none and runs locally."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(made)
    return made
