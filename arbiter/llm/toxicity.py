"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features: the distinct hashes of words, word pairs and pairs with one word
between, in 2**`bits` places. A word is a chunk between white space in lower
case without the characters that aren't letters or digits at its ends.

Training runs FTRL-proximal over at most `rows` labelled texts, the first by a
hash of their ids (the documented bound), in one task: a learning rate for each
coordinate, and L1, which leaves few weights that aren't 0. Those go to every
executor; they are at most 2**`bits` (4 MB).

Defined results
  null or empty text    the score of the bias alone
  no labels             score 0 (no weights, bias far below 0)
  repeated labels       an id is toxic if any of its labels says so
  null label            not learned from
  very long text        all of its features, in blocks
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.langid import held_out

BITS = 20
ROWS = 12_000
EPOCHS = 8
POSITIVE = 2  # times a toxic text is learned in an epoch
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 1.0
THRESHOLD = 0.7
BLOCK = 1 << 16
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class _Words(dict):
    """Chunk to the hash of its word; starts anew when full."""

    def __missing__(self, chunk: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[chunk] = zlib.crc32(_EDGE.sub("", chunk.lower()).encode("utf-8", "surrogatepass"))
        return h


_WORDS = _Words()


def hashes(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """The text's features with repeats, block by block."""
    chunks = (text or "").split()
    shift = np.uint64(64 - bits)
    a, b, c = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    for lo in range(0, len(chunks), BLOCK):
        part = chunks[max(0, lo - 2) : lo + BLOCK]
        h = np.fromiter(map(_WORDS.__getitem__, part), np.uint64, len(part)) + np.uint64(1)
        with np.errstate(over="ignore"):
            one, two, skip = h * a, (h[:-1] * a) ^ (h[1:] * b), (h[:-2] * b) ^ (h[2:] * c)
            yield np.concatenate(((one ^ one >> np.uint64(29)) * c >> shift, (two ^ two >> np.uint64(31)) * a >> shift, (skip ^ skip >> np.uint64(30)) * b >> shift)).astype(np.int64)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    parts = list(hashes(text, bits))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


class FTRL:
    """FTRL-proximal with per-coordinate rates; coordinate 2**bits is the bias, which has no L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        size = (1 << bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, size - 1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(self.z))
        w = self.weights(at)
        keep = np.flatnonzero(w)
        return keep, w[keep]


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, rows: int = ROWS, epochs: int = EPOCHS, positive: int = POSITIVE, **options) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that aren't 0, from documents (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    chosen = chosen.select(F.col("doc_id").alias("labelled"), "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))  # at most `rows` ids
    texts = texts.select("toxic", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(1)).alias("o"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(y, features(t, bits).astype(np.int32)) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        model = FTRL(bits, **options)
        for _ in range(epochs):
            for y, at in seen:
                for _ in range(positive if y > 0 else 1):
                    model.learn(at, int(y > 0))
        at, w = model.sparse() if seen else (np.array([1 << bits]), np.array([-35.0]))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    found = texts.repartition(1).sortWithinPartitions("o", "doc_id", F.xxhash64("text")).mapInArrow(run, "at long, w double").collect()
    if not found:  # a plan without rows may run no task at all
        return np.array([1 << bits]), np.array([-35.0])
    return np.array([r.at for r in found], np.int64), np.array([r.w for r in found])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, score) for every row of `docs`."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[at] = w
        bias = float(dense[1 << bits])
        for b in batches:
            out = []
            for t in b.column(1):
                hit = [h[dense[h] != 0] for h in hashes(t.as_py(), bits)]
                own = np.unique(np.concatenate(hit)) if hit else np.empty(0, np.int64)
                out.append(sigmoid(bias + float(dense[own].sum(dtype=np.float64))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out documents aren't used."""
    model = train(docs, labels.filter(~held_out(3, 1)), **options)
    out = score(docs, model)
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
