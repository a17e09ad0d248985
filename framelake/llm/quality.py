"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text's features are counts of its byte pairs (case and signs count, so noise, shouting and tables show), hashed
to ``FEATURES`` columns, damped and weighted by inverse document frequency, and the share of words that repeat the
word before. The space is the truncated singular
value decomposition of a bounded sample of labelled texts, whose vectors are broadcast: at most
``sample * DIMENSIONS`` numbers at any size of the corpus. Every document is then projected and compared with all
of them by blocked matrix products; the ``neighbours`` most similar vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textnum as tn
from .store import with_source

FEATURES = 2048
DIMENSIONS = 48
#: Labelled documents that the space and the vote are built from, drawn by a hash of doc_id.
SAMPLE = 6000
NEIGHBOURS = 9
BLOCK = 512
#: Weight of the share of repeated words beside the byte pairs, which have length 1.
REPEATS = 1.5

_PAIR = ((np.arange(256, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(256, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(
    np.int64
) % FEATURES


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES + 2) counts of byte pairs, of words like the word before, and of words."""
    n = len(offsets) - 1
    if len(data) < 2:
        return np.zeros((n, FEATURES + 2), np.float32)
    pair = _PAIR[data[:-1], data[1:]]
    text = np.repeat(np.arange(n), np.diff(offsets))
    same = text[:-1] == text[1:]
    cell = text[:-1][same] * FEATURES + pair[same]
    out = np.bincount(cell, minlength=n * FEATURES).astype(np.float32).reshape(n, FEATURES)
    words = tn.Words(data, offsets)
    like = np.zeros(len(words.hash) + 1, np.int64)
    if len(words.hash):
        like[1:] = np.concatenate([[False], words.hash[1:] == words.hash[:-1]])
        heads = words.first[:-1]
        like[heads[heads < len(words.hash)] + 1] = 0  # the first word of a text has none before it
    total = np.cumsum(like)
    return np.column_stack([out, total[words.first[1:]] - total[words.first[:-1]], words.count]).astype(np.float32)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, counts) of at most BLOCK texts."""
    for lo, hi, data, offsets in tn.chunks(column):
        for a in range(0, hi - lo, BLOCK):
            b = min(a + BLOCK, hi - lo)
            yield lo + a, lo + b, counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


class Model:
    def __init__(self, raw: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.neighbours = neighbours
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        seen = (raw[:, :FEATURES] > 0).sum(axis=0)
        self.weight = np.log((1 + len(raw)) / (1 + seen)).astype(np.float32) + 1
        x = self.damped(raw)
        # the leading right singular vectors, by subspace iteration from a fixed start
        self.basis = np.random.default_rng(0).standard_normal((x.shape[1], dimensions)).astype(np.float32)
        for _ in range(8 if len(raw) else 0):
            self.basis, _ = np.linalg.qr(x.T @ (x @ self.basis))
        self.vectors = self.project(raw)

    def damped(self, raw: np.ndarray) -> np.ndarray:
        out = np.empty((len(raw), FEATURES + 1), np.float32)
        x = out[:, :FEATURES]
        np.log1p(raw[:, :FEATURES], out=x)
        x *= self.weight
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        out[:, FEATURES] = REPEATS * raw[:, FEATURES] / np.maximum(raw[:, FEATURES + 1], 1)
        return out

    def project(self, raw: np.ndarray) -> np.ndarray:
        z = self.damped(raw) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled texts; the sample's share without any."""
        if not len(self.labels):
            return np.full(len(raw), self.prior)
        similar = self.project(raw) @ self.vectors.T
        k = min(self.neighbours, similar.shape[1])
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, near, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, x in blocks(batch.column(1)):
            some = [np.flatnonzero(r) for r in x]
            at = [a.astype("<u2").tobytes() for a in some]
            value = [r[a].astype("<f4").tobytes() for r, a in zip(x, some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "i", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents, those with the least hash of doc_id.

    Rows of ``labels`` without doc_id or label are left out; of several labels of a document the mean counts,
    rounded up at a half; of rows that share a doc_id the least text counts. Without any labelled document every score
    is 0.5.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    labels = labels.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    by_id = {r.doc_id: r.y for r in chosen.collect()}
    rows = sorted(texts.mapInArrow(_features, "doc_id long, i binary, x binary").collect(), key=lambda r: r.doc_id)
    raw = np.zeros((len(rows), FEATURES + 2), np.float32)
    for own, r in zip(raw, rows, strict=True):
        own[np.frombuffer(r.i, "<u2")] = np.frombuffer(r.x, "<f4")
    return Model(raw, np.array([by_id[r.doc_id] for r in rows], np.int64))


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1, higher where label 1 is likelier.

    All rows and columns stay (a column of that name is replaced). Null counts as empty; a text of fewer than two
    bytes has no features and gets the sample's share of label 1.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(to)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            for lo, hi, x in blocks(batch.column(batch.num_columns - 1)):
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own.score(x), pa.float64())], names=[*kept, to])

    return with_source(docs, kept, text).mapInArrow(run, docs.schema.add(to, "double"))
