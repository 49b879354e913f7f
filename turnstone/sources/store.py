"""Where a knowledge base lives: plain Parquet folders and a commit log.

``episodes/version=N-R`` holds one small row per episode, written whole by run R.
``chunks/run_id=R`` holds only what run R produced. An episode row names the run its
chunks came from, so replacing or pruning an episode touches no chunk file. A commit
is one folder in ``commits``, named by its version and holding a file named by its run,
put there by a rename that fails if the folder exists; a reader sees the last committed
version only. The file system must rename exclusively (HDFS and local ones do).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from turnstone.operators import graph as graphs
from turnstone.operators import postings
from turnstone.operators.bounds import broadcast_if_small
from turnstone.operators.graph import Graph

EPISODES = (
    "episode_id string, video_id string, guest string, title string, youtube_url string, "
    "publish_date date, duration_seconds double, description string, keywords array<string>, "
    "source_path string, content_hash string, ingested_at timestamp, run_id string")
CHUNKS = (
    "chunk_id string, episode_id string, ordinal int, speaker string, start_seconds int, "
    "end_seconds int, text string, token_count int, is_sponsor boolean, terms array<string>, "
    "embedding array<float>, run_id string")

class Conflict(RuntimeError):
    """Another writer has committed first; read the store again and retry."""


RUNS = (
    "run_id string, status string, source string, episodes_seen long, episodes_ingested long, "
    "episodes_skipped long, chunks_written long, error string, started_at timestamp, "
    "finished_at timestamp")


def columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):
        """A path and its file system: the only way to ask any store about files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str, schema: str) -> DataFrame:
        path, fs = self._at(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _commits(self) -> dict[int, str]:
        """Version and run id of every commit, from one listing."""
        pattern, fs = self._at("commits/[0-9]*/*")
        found = fs.globStatus(pattern) or []
        return {int(f.getPath().getParent().getName()): f.getPath().getName() for f in found}

    def version(self) -> int:
        return max(self._commits(), default=0)

    def committed(self, run_id: str) -> bool:
        return run_id in self._commits().values()

    def episodes(self, version: int | None = None) -> DataFrame:
        commits = self._commits()
        version = max(commits, default=0) if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], EPISODES)
        return self._read(f"episodes/version={version}-{commits[version]}", EPISODES)

    def chunks(self) -> DataFrame:
        """Chunks of live episodes only."""
        live = self.episodes().select("episode_id", "run_id")
        return self._read("chunks", CHUNKS).join(live, ["episode_id", "run_id"], "left_semi")

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def write_chunks(self, chunks: DataFrame, run_id: str) -> int:
        """Written under the run's own folder: a retried run overwrites itself."""
        path = f"{self.root}/chunks/run_id={run_id}"
        chunks.select(*[c for c in columns(CHUNKS) if c != "run_id"]).write.mode(
            "overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    def write_index(self, run_id: str) -> None:
        """The posting lists of the run's chunks, a segment of their own."""
        postings.build(self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks/run_id={run_id}"), f"{self.root}/postings", run_id)

    def index(self) -> postings.Index:
        """The stored keyword index, for ``hybrid.search``: the segments of live runs, and of
        their chunks those whose episode still names the run."""
        live = self.episodes().select("episode_id", F.col("run_id").alias("segment"))
        whole = postings.read(self.spark, f"{self.root}/postings")
        runs = broadcast_if_small(live.select("segment").distinct())
        return postings.Index(whole.blocks.join(runs, "segment", "left_semi"),
                              whole.docs.join(broadcast_if_small(live), ["episode_id", "segment"], "left_semi"), whole=False)

    def write_graph(self) -> Graph:
        """The neighbour graph of the live chunks, stored under the version it belongs to."""
        return graphs.build(self.chunks(), f"{self.root}/graphs/version={self.version()}")

    def graph(self) -> Graph | None:
        """The stored graph of the current version, for ``hybrid.search``; None if none has
        been written since the last commit."""
        name = f"graphs/version={self.version()}"
        return graphs.read(self.spark, f"{self.root}/{name}") if "shape" in self._names(name) else None

    def commit(self, episodes: DataFrame, run_id: str, base: int) -> int:
        """Makes ``episodes``, derived from version ``base``, the next version. Raises
        ``Conflict`` if that version exists by now, with nothing changed."""
        number = base + 1
        episodes.select(*columns(EPISODES)).write.mode("overwrite").parquet(
            f"{self.root}/episodes/version={number}-{run_id}")
        # A folder that names the run is made aside and then renamed, which fails where another
        # writer's folder is there: a commit is whole or absent whenever a writer ends.
        path, fs = self._at(f"commits/{number:012d}")
        aside, _ = self._at(f"commits/_{uuid.uuid4().hex}")
        jvm = self.spark._jvm
        fs.create(jvm.org.apache.hadoop.fs.Path(aside, run_id), True).close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(files.makeQualified(aside), files.makeQualified(path), plain)
        except Py4JJavaError as exc:
            fs.delete(aside, True)
            if "AlreadyExists" in exc.java_exception.getClass().getName():
                raise Conflict(f"version {number} has been committed by another run") from exc
            raise
        return number

    def vacuum(self, keep: int = 1, running: tuple[str, ...] = ()) -> list[str]:
        """Deletes the chunk folders that none of the last ``keep`` versions names,
        except those of runs still under way, and older episode versions. Returns
        the run ids whose chunks went."""
        last = sorted(self._commits())[-keep:]
        named = set(running)
        for v in last:
            named |= {r.run_id for r in self.episodes(v).select("run_id").distinct().collect()}
        stale = [n for n in self._names("chunks") if n.startswith("run_id=") and n[7:] not in named]
        old = [n for n in self._names("episodes") if last and int(n[8:].split("-")[0]) < last[0]]
        segments = [f"postings/{part}/segment={n[7:]}" for n in stale for part in ("blocks", "docs")]
        for name in [f"chunks/{n}" for n in stale] + segments + [f"episodes/{n}" for n in old]:
            path, fs = self._at(name)
            fs.delete(path, True)
        return [n[7:] for n in stale]

    def log_run(self, row: DataFrame) -> None:
        row.select(*columns(RUNS)).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
