"""Turns packed into overlapping chunks of about ``target_tokens``.

What a chunk carries over depends on what the previous chunk held, which no
window expression says; it is one pass over a transcript's turns, so it runs as
an Arrow function on the row that holds them, without a shuffle.
"""

from __future__ import annotations

import re
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.settings import DEFAULTS, Settings

CHUNKS = T.ArrayType(T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("start_seconds", T.IntegerType()),
    T.StructField("end_seconds", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("is_sponsor", T.BooleanType()),
]))
AT_ONCE = 32  # transcripts that are Python objects at a time, however long a batch is
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str) -> int:
    return max(1, int(len(text.split()) * 1.3))


def pieces(turn: dict, target: int) -> list[dict]:
    """A turn over the target cut at sentence ends; a longer sentence stays whole."""
    if tokens(turn["text"]) <= target:
        return [turn]
    groups, room = [], 0
    for sentence in _SENTENCE_END.split(turn["text"]):
        cost = tokens(sentence)
        if not groups or cost > room:
            groups.append([])
            room = target
        groups[-1].append(sentence)
        room -= cost
    return [{**turn, "text": " ".join(g)} for g in groups]


def spans(costs: list[int], target: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open index ranges of the chunks over one run of turns. Every range
    takes in at least one new turn, then whole turns while they fit; the next
    one starts at the longest tail that fits the overlap."""
    total = [0, *accumulate(costs)]
    out, start, new = [], 0, 0
    while new < len(costs):
        end = new + 1
        while end < len(costs) and total[end + 1] - total[start] <= target:
            end += 1
        out.append((start, end))
        tail = end
        while tail > start and total[end] - total[tail - 1] <= overlap:
            tail -= 1
        start, new = tail, end
    return out


def pack(turns: list[dict], target: int, overlap: int) -> list[dict]:
    """Chunks in order. Advertisement and content never share one, and nothing is
    carried from one to the other."""
    chunks: list[dict] = []
    cut = [p for t in turns for p in pieces(t, target)]
    for is_sponsor, run in groupby(cut, key=lambda t: t["is_sponsor"]):
        run = list(run)
        for a, b in spans([tokens(t["text"]) for t in run], target, overlap):
            text = "\n\n".join(f"{t['speaker']}: {t['text']}" for t in run[a:b])
            chunks.append({
                "ordinal": len(chunks), "speaker": run[a]["speaker"],
                "start_seconds": run[a]["start_seconds"],
                "end_seconds": run[b - 1]["start_seconds"],
                "text": text, "token_count": tokens(text), "is_sponsor": is_sponsor})
    return chunks


def pack_chunks(df: DataFrame, *keys: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per chunk: ``keys`` and the chunk columns, from ``keys, turns``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(*keys, "turns")
    out = T.StructType([*[rows.schema[k] for k in keys], T.StructField("chunks", CHUNKS)])
    schema = to_arrow_schema(out)
    target, overlap = settings.target_tokens, settings.overlap_tokens

    return rows.mapInArrow(_per_batch(keys, schema, target, overlap), out).select(
        *keys, F.explode("chunks").alias("c")).select(*keys, "c.*")


def _per_batch(keys, schema: pa.Schema, target: int, overlap: int):
    def per_batch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                packed = [pack(t or [], target, overlap) for t in some.column("turns").to_pylist()]
                cols = [some.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(packed, schema.field("chunks").type)], schema=schema)

    return per_batch
