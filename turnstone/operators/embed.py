"""Passage and query vectors from a pluggable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import text as tx

MODEL_BATCH = 256


class HashedTerms:
    """Default encoder: term counts hashed into ``dim`` slots, unit length.

    A model encoder has the same shape: ``wants`` names its input (``terms`` or
    ``text``) and ``encode(inputs, mode)`` returns one row per input, where mode is
    ``passage`` or ``query`` for models that encode the two differently.
    """

    wants = "terms"

    def __init__(self, dim: int = 384):
        self.dim = dim
        self._slots: dict[str, int] = {}

    def slot(self, term: str) -> int:
        if (at := self._slots.get(term)) is None:
            if len(self._slots) > 200_000:
                self._slots.clear()
            at = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dim
            self._slots[term] = at
        return at

    def encode(self, inputs: list, mode: str) -> np.ndarray:
        out = np.zeros((len(inputs), self.dim))
        for row, terms in enumerate(inputs):
            np.add.at(out[row], [self.slot(t) for t in terms], 1.0)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def encoder_column(source: Column, make: Callable[[], object], mode: str) -> Column:
    """An ``array<float>`` column. The encoder is made once per Python worker; a
    null input costs nothing and stays null."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, kind = make(), pa.list_(pa.float32())
        for batch in batches:
            # Only so many inputs are Python objects at a time, however long a batch is.
            parts = [pa.array([], kind)]
            for start in range(0, len(batch), MODEL_BATCH):
                inputs = batch.slice(start, MODEL_BATCH).to_pylist()
                present = [i for i, v in enumerate(inputs) if v is not None]
                out = [None] * len(inputs)
                if present:
                    vectors = encoder.encode([inputs[i] for i in present], mode).astype("float32")
                    for i, v in zip(present, vectors, strict=True):
                        out[i] = v
                parts.append(pa.array(out, kind))
            yield pa.concat_arrays(parts)

    return encode(source)


def _input(df: DataFrame, text: str, make: Callable[[], object]) -> Column:
    if getattr(make, "wants", "terms") != "terms":
        return F.col(text)
    return F.col("terms") if "terms" in df.columns else tx.terms(F.col(text))


def embed_passages(chunks: DataFrame, make: Callable[[], object] = HashedTerms,
                   text: str = "text") -> DataFrame:
    """``chunks`` with ``embedding``; advertisements are never encoded."""
    source = _input(chunks, text, make)
    if "is_sponsor" in chunks.columns:
        source = F.when(~F.col("is_sponsor"), source)
    return chunks.withColumn("embedding", encoder_column(source, make, "passage"))


def embed_queries(queries: DataFrame, make: Callable[[], object] = HashedTerms,
                  text: str = "query") -> DataFrame:
    source = _input(queries, text, make)
    return queries.withColumn("vector", encoder_column(source, make, "query"))
