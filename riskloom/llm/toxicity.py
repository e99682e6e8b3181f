"""Toxicity by logistic regression over hashed word n-grams and skip-grams, trained with FTRL-proximal.

Features of a text are its distinct words, word pairs and pairs with one word skipped, lower-cased and without ASCII
punctuation, hashed into ``2 ** BITS`` coordinates.  Training keeps a rate per coordinate and an L1 term, so most weights
are exactly 0 and the rest, at most one per coordinate, are small enough to ship with the scoring tasks.

Training uses at most ``TRAIN_ROWS`` labelled rows, those with the smallest digests of their ids, never one whose
``crc32(doc_id as text) mod 5`` is 0.  Scoring is one narrow pass over all texts.

Edge cases: a null or empty text has no features and gets the score of the bias alone; labels that are null or have no
document are left out, of several for one document the largest counts; without any labelled row all scores are 0; rows
that repeat a ``doc_id`` are scored each; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.wordhash import Block, blocks, mix

BITS = 18
#: Bound of the training sample.
TRAIN_ROWS = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.5
FOLDS = 5

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def features(block: Block) -> Iterator[np.ndarray]:
    """For each text its distinct coordinates, ascending."""
    plain = Block(_PLAIN[block.data], block.offsets, block.first)
    words = plain.hashes(lower=True)
    shift = np.uint64(64 - BITS)
    single = (mix(words) >> shift).astype(np.int32)
    pairs = [(mix(words[:-gap] * np.uint64(0xFF51AFD7ED558CCD) + words[gap:] + np.uint64(gap)) >> shift).astype(np.int32) if len(words) > gap else np.empty(0, np.int32)
             for gap in (1, 2)]
    for a, b in zip(plain.bounds, plain.bounds[1:], strict=False):
        yield np.unique(np.concatenate([single[a:b], *(p[a:max(a, b - gap)] for gap, p in enumerate(pairs, 1))]))


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; the last coordinate is the bias, free of L1."""

    def __init__(self, size: int, base_rate: float, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.start = float(np.log(base_rate / (1 - base_rate)))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def bias(self) -> float:
        return self.start - float(self.z[-1]) / ((self.beta + float(np.sqrt(self.n[-1]))) / self.alpha)

    def learn(self, at: np.ndarray, label: float) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g
        n = self.n[-1]
        self.z[-1] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * (b - self.start)
        self.n[-1] += g * g


def fit(rows: list[tuple[np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) with the coordinates whose weight is not 0."""
    if not rows:
        return np.empty(0, np.int32), np.empty(0), -np.inf
    positive = sum(y for _, y in rows)
    model = Ftrl(1 << BITS, min(max(positive, 0.5), len(rows) - 0.5) / len(rows) if len(rows) > 1 else 0.5)
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            model.learn(*rows[i])
    w = model.weights(slice(0, -1))
    kept = np.flatnonzero(w)
    return kept.astype(np.int32), w[kept], model.bias()


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for block in blocks(batch.column("text")):
            found = pa.array(list(features(block)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([c.slice(at, len(found)) for c in (batch.column("doc_id"), batch.column("toxic"))] + [found], ["doc_id", "toxic", "at"])
            at += len(found)


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        flat, ends = batch.column("at").flatten().to_numpy(), batch.column("at").offsets.to_numpy()
        ends = ends - ends[0]
        for k, y in enumerate(batch.column("toxic").to_pylist()):
            rows.append((int(batch.column("doc_id")[k].as_py()), flat[ends[k]:ends[k + 1]].copy(), int(y)))
    rows.sort(key=lambda r: (r[0], len(r[1])))
    at, w, bias = fit([r[1:] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int32())), pa.array([w], pa.list_(pa.float64())), pa.array([bias])], ["at", "w", "bias"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from a bounded sample of the labelled documents that are not held out; fitted in one task."""
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    truth = truth.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = truth.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
             .mapInArrow(_feature_rows, "doc_id long, toxic int, at array<int>")
             .repartition(1).mapInArrow(_train_rows, "at array<int>, w array<double>, bias double").head())
    if found is None:
        return fit([])
    return np.array(found["at"], np.int32), np.array(found["w"]), found["bias"]


def _score_rows(at: np.ndarray, w: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[at] = w
        for batch in batches:
            k = 0
            for block in blocks(batch.column("text")):
                sums = np.array([dense[f].sum() for f in features(block)]) + bias
                ids = batch.column("doc_id").slice(k, len(sums))
                k += len(sums)
                yield pa.RecordBatch.from_arrays([ids, pa.array(1 / (1 + np.exp(-np.clip(sums, -700, 700))) if np.isfinite(bias) else np.zeros(len(sums)))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per document ``held_out``, ``score`` (0 to 1) and ``predicted``; trains while it is called."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score_rows(*train(docs, labels, rows)), "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
