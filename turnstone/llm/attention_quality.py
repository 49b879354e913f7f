"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages. Each is encoded from its bytes; a gated attention
layer learns, from labels of whole documents only, how much each passage counts,
and a logistic layer scores the attention-weighted mean of the passages.

Cases. Null and empty texts are one empty passage and get a score. Long texts are
scored whole, passage by passage. Repeated rows are scored each. Without any
labelled row the score is 0.5; with one class only, that class's smoothed share.
Of labelled rows that share an id, one is learned from. The sample to learn from is
bounded in documents and in passages of each; neither bounds what is scored.
Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.llm.common import crc_mod, pieces, utf8

PASSAGE_BYTES = 1024
PAIR_BUCKETS = 256
SPAN = 6  # bytes of a span whose repeats inside a passage are counted
WIDTH = 256 + PAIR_BUCKETS + 1


def encode_passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of all texts, and the number of passages of each: square
    roots of the shares of bytes and of hashed byte pairs, each of unit length, and
    the share of its ``SPAN``-byte spans that repeat an earlier one."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-lengths // PASSAGE_BYTES))
    first = np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), WIDTH), np.float32)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw):
        start = np.cumsum(lengths) - lengths
        within = np.arange(len(raw)) - np.repeat(start, lengths)
        row = np.repeat(first, lengths) + within // PASSAGE_BYTES
        n = len(out)
        out[:, :256] = np.bincount(row * 256 + raw, minlength=n * 256).reshape(n, 256)
        same = row[1:] == row[:-1]
        pair = ((raw[:-1].astype(np.uint32) * 251 + raw[1:]) * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64)
        pairs = out[:, 256:256 + PAIR_BUCKETS]
        pairs[:] = np.bincount((row[:-1] * PAIR_BUCKETS + pair)[same], minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS)
        for part in (out[:, :256], pairs):
            np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1), out=part)
        out[:, -1] = _repeated(raw, row, n)
    return out, counts


def _repeated(raw: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    m = len(raw) - SPAN + 1
    if m <= 0:
        return np.zeros(n, np.float32)
    span = np.zeros(m, np.uint64)
    for k in range(SPAN):
        span = span * np.uint64(257) + raw[k:k + m]
    span = (span * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)  # 40 bits, the passage above them
    key = np.sort((span | row[:m].astype(np.uint64) << np.uint64(40))[row[:m] == row[SPAN - 1:]])
    again = key[1:][key[1:] == key[:-1]] >> np.uint64(40)
    total = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
    return (np.bincount(again.astype(np.int64), minlength=n) / np.maximum(total, 1)).astype(np.float32)


@dataclass(frozen=True)
class Plan:
    hidden: int = 32
    attention: int = 16
    epochs: int = 30
    batch: int = 64
    rate: float = 0.005
    decay: float = 1e-4
    sample_rows: int = 6000  # labelled documents the fit sees, at most
    sample_passages: int = 32  # passages of each of them, at most, at even distances over the whole text
    seed: int = 11


@dataclass
class Model:
    """h = relu(x W + b); weight = softmax of w.(tanh(h V) * sigmoid(h U)); score = sigmoid(c.z + d)."""

    layers: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.layers
        starts = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(h * a[:, None], starts)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"starts": starts, "bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return self.forward(x, counts)["s"].astype(float)


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, plan: Plan = Plan()) -> Model:
    """Fits all layers together by Adam on the documents' log loss."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(constant=float((labels.sum() + 1) / (len(labels) + 2)))
    rng = np.random.default_rng(plan.seed)

    def make(*shape):
        return (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)

    model = Model({"W": make(x.shape[1], plan.hidden), "b": np.zeros(plan.hidden, np.float32),
                   "V": make(plan.hidden, plan.attention), "U": make(plan.hidden, plan.attention),
                   "w": make(plan.attention), "c": make(plan.hidden), "d": np.zeros(1, np.float32)})
    p = model.layers
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    first, step = np.cumsum(counts) - counts, 0
    for _ in range(plan.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), plan.batch):
            docs = order[at:at + plan.batch]
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in docs])
            xb = x[rows]
            f = model.forward(xb, counts[docs])
            bag, h, t, g, a, z = (f[k] for k in ("bag", "h", "t", "g", "a", "z"))
            ds = ((f["s"] - labels[docs]) / len(docs)).astype(np.float32)
            dz = ds[:, None] * p["c"]
            dh = a[:, None] * dz[bag]
            da = (h * dz[bag]).sum(1)
            de = a * (da - np.add.reduceat(a * da, f["starts"])[bag])
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh += dt @ p["V"].T + dg @ p["U"].T
            dh *= h > 0
            grads = {"W": xb.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
                     "c": z.T @ ds, "d": ds.sum(keepdims=True)}
            step += 1
            for k, gr in grads.items():
                gr = gr + plan.decay * p[k]
                m, v = moments[k]
                m += 0.1 * (gr - m)
                v += 0.001 * (gr * gr - v)
                p[k] -= plan.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, fold: int | None = 5, plan: Plan = Plan(), doc_id: str = "doc_id",
        text: str = "text", label: str = "quality") -> Model:
    """Learns from labelled documents whose crc32(id) mod ``fold`` is not 0: of those
    the ``plan.sample_rows`` with the lowest hashed ids, and of each at most
    ``plan.sample_passages``: a bounded, documented sample."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("label is not null and doc_id is not null")
    if fold:
        known = known.where(crc_mod("doc_id", fold) != 0)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(plan.sample_rows)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), "doc_id")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x, counts = encode_passages(utf8(batch.column("text")))
            first = np.cumsum(counts) - counts
            raw = [x[a + _evenly(n, plan.sample_passages)].astype(np.float16).tobytes() for a, n in zip(first, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label").cast(pa.int32()), pa.array(raw, pa.binary())], names=["doc_id", "label", "x"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    bags = narrow.select("doc_id", "text", "label").mapInArrow(encoded, f"doc_id {kind}, label int, x binary")
    rows = sorted(bags.groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("least")).select("doc_id", "least.*").collect(),
                  key=lambda r: r.doc_id)
    if not rows:
        return Model(constant=0.5)
    parts = [np.frombuffer(r.x, np.float16).astype(np.float32).reshape(-1, WIDTH) for r in rows]
    return train(np.vstack(parts), np.array([len(p) for p in parts]), np.array([r.label for r in rows], np.float32), plan)


def _evenly(n: int, most: int) -> np.ndarray:
    """``most`` of n places, the first and the last among them; all where there are no more."""
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).astype(np.int64)


def _scored(model: Model):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = utf8(batch.column("_text"))
            scores = model.score(*encode_passages(texts)) if texts else np.zeros(0)
            rest = batch.select([n for n in batch.schema.names if n != "_text"])
            yield rest.append_column("score", pa.array(scores, pa.float64()))

    return step


def score(docs: DataFrame, model: Model, threshold: float = 0.3, fold: int = 5,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; map-only."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (crc_mod(doc_id, fold) == 0).alias("held_out"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows the classifier accepts, with their own columns."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            scores = model.score(*encode_passages(utf8(batch.column(batch.schema.get_field_index(text)))))
            yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(step, docs.schema)
