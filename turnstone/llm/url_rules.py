"""URL filter by a sort-merge range join.

A host's labels are reversed, so a host and its subdomains share a prefix: the key
``org.example.`` starts ``org.example.www.``. A rule on a host is an interval
of keys, and such intervals nest. Urls and rules are sorted together; a sweep
keeps the stack of intervals that contain the present key and tries their rules
on the url's path. The longest rule wins (host and path together; ties: the longer
host, then block).

Cases. Null url or one without ``://``: host and path empty, no rule fits. Repeated
and tied urls are judged each. Repeated rules count once. Empty tables: empty
result, or every url by the default. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import lower_ascii

def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    u = F.col(url)
    rest = F.when(F.instr(u, "://") > 0, F.substr(u, F.instr(u, "://") + F.lit(3)))
    after = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    path = F.when(F.substr(after, F.lit(1), F.lit(1)) == "/", after)
    return urls.withColumns({
        "host": F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        "path": F.coalesce(path, F.lit(""))})


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _cuts(keyed: DataFrame, ranges: int) -> list[tuple[str, str, int]]:
    """At most ``ranges - 1`` (key, path, salt) cut points of about equal shares, from a
    sample whose size depends on ``ranges`` only. They steer balance, not results."""
    rows = keyed.count()
    want = 40 * ranges
    some = keyed.select("key", "path", "salt").sample(fraction=min(1.0, 2.0 * want / max(rows, 1)), seed=7).limit(4 * want)
    found = sorted(tuple(r) for r in some.collect())
    picked = [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []
    return sorted(set(picked))


def _swept(default: str):
    """Sweep of one task: rows arrive sorted by (range, key, rules first, path)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list]] = []  # (key prefix, its rules), each inside the one below
        here = None
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out = {"id": [], "host": [], "path": [], "rule": [], "verdict": []}
            for i in range(batch.num_rows):
                key = cols["key"][i]
                if cols["part"][i] != here:
                    here, stack = cols["part"][i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if cols["kind"][i] == 0:
                    rule = (cols["host"][i], cols["path"][i], cols["verdict"][i])
                    if stack and stack[-1][0] == key:
                        stack[-1][1].append(rule)
                    else:
                        stack.append((key, [rule]))
                    continue
                path, best = cols["path"][i], None
                for _, rules in stack:
                    for host, prefix, verdict in rules:
                        if path.startswith(prefix):
                            rank = (len(host) + len(prefix), len(host), verdict)
                            if best is None or rank > best[0]:
                                best = (rank, host + prefix)
                for n, v in (("id", cols["id"][i]), ("host", cols["host"][i]), ("path", path),
                             ("rule", best and best[1]), ("verdict", best[0][2] if best else default)):
                    out[n].append(v)
            kinds = {"id": batch.schema.field("id").type}
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, kinds.get(n, pa.string())) for n, v in out.items()], names=["page_id", "host", "path", "rule", "verdict"])

    return step


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url_id: str = "page_id", url: str = "url",
          ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every url. ``rules`` has host, path, verdict.

    Cut points on (key, path, a hash of the id) split even a single hot host, url or null
    into ranges; only rows equal in id and url stay together. A rule goes to
    every range its interval meets: the one its key falls into, those the interval
    covers, and no others; at a range's start the stack is filled by those rules."""
    ranges = ranges or max(8, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = parts(urls.select(F.col(url_id).alias("id"), F.col(url).alias("url")))
    keyed = named.select("id", "host", "path", host_key(F.col("host")).alias("key"), F.xxhash64("id").alias("salt"))
    cuts = _cuts(keyed, ranges)
    kind = keyed.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "path", "salt")))
            where = [bisect_right(cuts, row) for row in rows]
            yield batch.drop_columns(["salt"]).append_column("part", pa.array(where, pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts_ = [], []
            for i, key in enumerate(batch.column("key").to_pylist()):
                # Every key that extends "x." comes before "x/".
                for p in range(bisect_left(cuts, (key, "")), bisect_left(cuts, (key[:-1] + "/", "")) + 1):
                    rows.append(i)
                    parts_.append(p)
            yield batch.take(pa.array(rows, pa.int64())).append_column("part", pa.array(parts_, pa.int32()))

    asked = keyed.mapInArrow(placed, f"id {kind}, host string, path string, key string, part int").select(
        "part", "key", F.lit(1).alias("kind"), "path", "id", "host", F.lit(None).cast("string").alias("verdict"))
    host = lower_ascii(F.col("host"))
    known = rules.select(host.alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), "verdict").where("host <> ''").distinct()
    given = known.withColumn("key", host_key(F.col("host"))).select("host", "path", "key", "verdict").mapInArrow(
        spread, "host string, path string, key string, verdict string, part int").select(
        "part", "key", F.lit(0).alias("kind"), "path", F.lit(None).cast(kind).alias("id"), "host", "verdict")
    return (given.unionByName(asked).repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "key", "kind", "path")
            .mapInArrow(_swept(default), f"page_id {kind}, host string, path string, rule string, verdict string"))
