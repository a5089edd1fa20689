"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated by a temperature.

Tokens are runs of letters and digits (lower-cased, marked if all capitals), runs of other signs, and one token for a word said
twice in a row. Each of ``2**vocabulary_bits`` hashed tokens has a sparse ternary index vector; its word vector is the sum of the
index vectors of its neighbours over all texts. These sums are integers: every task adds up its own, the shuffle adds them
together, and a table of a fixed size goes to the driver and back. A document is the mean and mean square of its word vectors.

The network (numpy, on the driver) learns from at most ``max_train`` labelled documents, drawn by hash; a part of them is kept
aside to fit the temperature. Scores use the text alone.

Nulls count as empty texts, which get the score of an all-zero vector. Rows that repeat are scored each. Null labels are not
used; several labels of a document count as the least. Without labels of both classes every score is the share of label 1 (0.5
without any). An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusradar.llm.common import array_parts, array_total, fold_bytes, span_hashes, text_blocks, whole_text


@dataclass(frozen=True)
class Settings:
    vocabulary_bits: int = 14
    dimensions: int = 32
    nonzeros: int = 4
    reach: int = 2
    hidden: int = 32
    max_train: int = 20_000
    epochs: int = 40
    seed: int = 7


_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 other signs
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_SAID_AGAIN = 0


def tokens(octets: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed token and row of every token of the texts."""
    n = len(octets)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = _KIND[octets]
    change = np.ones(n, bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    ink = kinds[starts] > 0
    starts, ends = starts[ink], ends[ink]
    hashes = span_hashes(fold_bytes(octets), starts, ends)
    upper = np.append(0, np.cumsum((octets >= 65) & (octets <= 90)))
    capitals = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    hashes ^= np.where(capitals, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0))
    rows = np.searchsorted(bounds, starts, side="right") - 1
    ids = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    again = np.zeros(len(ids), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    ids[again] = _SAID_AGAIN
    return ids, rows


def index_vectors(s: Settings) -> np.ndarray:
    """Sparse ternary vectors, a function of the seed alone."""
    draw = np.random.default_rng(s.seed)
    size = 1 << s.vocabulary_bits
    places = draw.random((size, s.dimensions)).argpartition(s.nonzeros, axis=1)[:, :s.nonzeros]
    vectors = np.zeros((size, s.dimensions), np.float32)
    np.put_along_axis(vectors, places, draw.choice(np.array([-1, 1], np.float32), (size, s.nonzeros)), axis=1)
    return vectors


def word_vectors(texts: DataFrame, s: Settings) -> np.ndarray:
    """Unit word vectors over all ``text``, less their mean over all tokens."""
    size = 1 << s.vocabulary_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = index_vectors(s), np.zeros((s.dimensions + 1, size))
        for batch in batches:
            for _, _, octets, bounds in text_blocks(batch.column(0), 1 << 19):
                ids, rows = tokens(octets, bounds, s.vocabulary_bits)
                own = vectors[ids]
                around = np.zeros_like(own)
                for step in range(1, s.reach + 1):
                    same = (rows[step:] == rows[:-step])[:, None]
                    around[step:] += own[:-step] * same
                    around[:-step] += own[step:] * same
                for d, column in enumerate(np.ascontiguousarray(around.T)):
                    sums[d] += np.bincount(ids, column, size)
                sums[-1] += np.bincount(ids, minlength=size)
        if sums[-1].any():
            yield pa.RecordBatch.from_arrays([*array_parts(np.rint(sums))], names=["slice", "part"])

    parts = texts.mapInArrow(run, "slice int, part binary")
    total = array_total(parts, size * (s.dimensions + 1)).reshape(s.dimensions + 1, size).astype(np.float64)
    vectors, counts = total[:-1].T, total[-1]
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    mean = counts @ vectors / max(counts.sum(), 1)
    return np.where(counts[:, None] > 0, vectors - mean, 0).astype(np.float32)


def pooled(octets: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, bits: int) -> np.ndarray:
    """Mean and mean square of the word vectors of each text; zeros for a text without tokens."""
    ids, rows = tokens(octets, bounds, bits)
    n, d = len(bounds) - 1, vectors.shape[1]
    out = np.zeros((n, 2 * d), np.float32)
    if len(ids):
        own = vectors[ids]
        firsts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        there, sizes = rows[firsts], np.diff(np.append(firsts, len(rows)))[:, None]
        out[there, :d] = np.add.reduceat(own, firsts, axis=0) / sizes
        out[there, d:] = np.add.reduceat(own * own, firsts, axis=0) / sizes
    return out


class Network:
    """tanh layer, then a logistic unit whose logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, s: Settings):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.constant = len(y) < 10 or y.min() == y.max()
        if self.constant:
            return
        draw = np.random.default_rng(s.seed)
        order = draw.permutation(len(y))
        aside, use = order[:len(y) // 5], order[len(y) // 5:]
        self.mean, self.scale = x[use].mean(0), x[use].std(0) + 1e-6
        self.temperature = 1.0
        z = (x - self.mean) / self.scale
        self.w = [draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], s.hidden)), np.zeros(s.hidden),
                  draw.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(s.epochs):
            rate = 0.01 * (1 - epoch / s.epochs) + 1e-4
            shuffled = draw.permutation(use)
            for at in range(0, len(shuffled), 256):
                part = shuffled[at:at + 256]
                inner = np.tanh(z[part] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-np.clip(inner @ self.w[2] + self.w[3], -40, 40))) - y[part]) / len(part)
                back = np.outer(error, self.w[2]) * (1 - inner * inner)
                slopes = [z[part].T @ back + 1e-4 * self.w[0], back.sum(0), inner.T @ error + 1e-4 * self.w[2], np.array([error.sum()])]
                step += 1
                for w, g, a, b in zip(self.w, slopes, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
        logits = self.logits(x[aside])
        choices = np.geomspace(0.25, 8, 61)
        losses = [np.mean(np.logaddexp(0, -np.where(y[aside] > 0, logits, -logits) / t)) for t in choices]
        self.temperature = float(choices[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        inner = np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1])
        return (inner @ self.w[2] + self.w[3]) / self.temperature

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.prior)
        # rounded, so that the order of additions in a larger or smaller batch does not show
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40))), 9)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    vectors: np.ndarray
    network: Network
    settings: Settings


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        settings: Settings = Settings()) -> Model:
    """Word vectors from every text of ``df``; the network from a bounded sample of labelled rows that are not held out."""
    texts = df.select(whole_text(text_col).alias("text"))
    vectors = word_vectors(texts, settings)
    drawn = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(id_col).agg(F.min(label_col).cast("double").alias("__y"))
             .orderBy(F.xxhash64(id_col), id_col).limit(settings.max_train))
    sample = df.select(id_col, whole_text(text_col).alias("text")).join(F.broadcast(drawn), id_col).select("text", F.col("__y").alias("y"))
    shared = df.sparkSession.sparkContext.broadcast(vectors)
    bits = settings.vocabulary_bits

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, octets, bounds in text_blocks(batch.column(0), 1 << 19):
                x = pooled(octets, bounds, shared.value, bits)
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary()), batch.column(1).slice(a, b - a)],
                                                 names=["x", "y"])

    rows = sorted((bytes(row["x"]), row["y"]) for row in sample.mapInArrow(features, "x binary, y double").collect())  # at most max_train
    x = np.array([np.frombuffer(a, np.float32) for a, _ in rows], np.float64).reshape(-1, 2 * settings.dimensions)
    return Model(vectors, Network(x, np.array([y for _, y in rows]), settings), settings)


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id, score, predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, octets, bounds in text_blocks(batch.column(1), 1 << 19):
                p = m.network.probabilities(pooled(octets, bounds, m.vectors, m.settings.vocabulary_bits).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                                 names=["id", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def query(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    return scored(documents, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
