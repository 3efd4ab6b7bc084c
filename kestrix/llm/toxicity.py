"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and L1 sparsity leave a small set of non-zero weights. The model is
fitted on a bounded sample of labelled rows (`max_train`, smallest id hashes); its features
are made on the executors and stored, each epoch streams them past the driver a row at a time, and
scoring covers every document without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WORD, Workspace, documents, fold, lower, pick, training_ids

_MULT = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Row of a word in `table`: hashes of the word and of its stems (its first 3 to 6 characters), so
    that inflected forms share weights. Emptied when large, so a worker's memory stays bounded."""

    STEMS = (3, 4, 5, 6)

    def __init__(self):
        super().__init__()
        self.table = np.empty((1 << 12, 1 + len(self.STEMS)), np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        crc = lambda s, k: (crc32(s.encode("utf-8", "surrogatepass")) << 3) + k
        self.table[at] = [crc(word, 0), *(crc(word[:n], i) for i, n in enumerate(self.STEMS, 1))]
        self[word] = at
        return at


_words = _Words()


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def features(text: str, bits: int) -> np.ndarray:
    """Distinct hashed indices, sorted: words and their stems, word pairs, and pairs with one word skipped."""
    words = WORD.findall(lower(text))
    if len(_words) > 300_000:
        _words.clear()
    at = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    h = _words.table[at, 0]
    shift = np.uint64(64 - bits)
    parts = [(_words.table[_distinct(at)].ravel() + np.uint64(1)) * _MULT]
    if len(h) > 1:
        parts.append((h[:-1] * np.uint64(3) ^ (h[1:] << np.uint64(20))) * _MULT + _MULT)
    if len(h) > 2:
        parts.append((h[:-2] * np.uint64(5) ^ (h[2:] << np.uint64(24)) ^ np.uint64(0x5BD1E995)) * _MULT)
    return _distinct((np.concatenate(parts) * _MULT >> shift).astype(np.uint32))


@dataclass
class Ftrl:
    """FTRL-proximal (McMahan et al. 2013) with binary features; state z and n by coordinate."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 3

    def fit(self, rows: Callable[[], Iterable[tuple[np.ndarray, float]]], rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
        """Non-zero indices, their weights, and the bias (which L1 does not shrink). rows: gives the
        rows (distinct indices, label) anew for each epoch; rate: share of label 1, where the bias starts."""
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        bias, seen = np.log(rate / (1 - rate)), 1.0
        for _ in range(self.epochs):
            for idx, label in rows():
                w = self._weights(z[idx], n[idx])
                g = _sigmoid(bias + w.sum()) - label
                more = np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])
                z[idx] += g - more / self.alpha * w
                n[idx] += g * g
                seen += g * g
                bias -= self.alpha / (self.beta + np.sqrt(seen)) * g
        w = self._weights(z, n)
        keep = np.flatnonzero(w)
        return keep.astype(np.uint32), w[keep].astype(np.float32), float(bias)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        strong = np.abs(z) > self.l1
        return np.where(strong, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, y: str = "toxic", folds: int = 5, held: int = 0, max_train: int = 16_000, model: Ftrl | None = None):
    """Fit on at most `max_train` labelled rows outside the held-out fold.

    Labels repeated for an id: the largest counts; of rows that repeat an id one teaches. Null ids or labels
    teach nothing. A row of the sample has at most 2**bits indices, and the driver holds one at a time."""
    model = model or Ftrl()
    bits = model.bits
    taught = pick(labels, doc_id="bigint", **{y: "int"}).dropna().where(fold(F.col("doc_id"), folds) != held)
    sample = training_ids(taught.groupBy("doc_id").agg(F.max(y).alias("y")), max_train)

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t, bits).tobytes() for t in texts])

    found = documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.pandas_udf(extract, "binary")("text").alias("f"))
    ws = Workspace(docs.sparkSession, "toxicity")
    one = found.groupBy("doc_id", "y").agg(F.max("f").alias("f"))
    # dealt by a hash already: an order within each part is enough, and an epoch needs no shuffle
    stored = ws.save(one.sortWithinPartitions(F.crc32(F.col("doc_id").cast("string")), "doc_id"), "sample")
    rate = stored.agg(F.avg("y")).first()[0]

    def rows() -> Iterator[tuple[np.ndarray, float]]:
        for r in stored.toLocalIterator():
            yield np.frombuffer(r.f, np.uint32), r.y

    fitted = model.fit(rows, 0.5 if rate is None else rate)
    ws.drop()
    return fitted


def score_toxicity(docs: DataFrame, labels: DataFrame, y: str = "toxic", folds: int = 5, held: int = 0, max_train: int = 16_000, model: Ftrl | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, n_features (distinct ones).

    Null or empty text scores the bias alone; without any labelled row every score is 0.5.
    Null ids are not held out. Repeated rows each get their row."""
    model = model or Ftrl()
    bits = model.bits
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, y, folds, held, max_train, model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, w, bias = weights.value
        dense = np.zeros(1 << bits, np.float32)
        dense[index] = w
        for texts in batches:
            rows = [features(t, bits) for t in texts]
            yield pd.DataFrame({"score": [_sigmoid(bias + float(dense[f].sum())) for f in rows], "n_features": [len(f) for f in rows]})

    scored = documents(docs).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), F.pandas_udf(run, "score double, n_features bigint")("text").alias("r"))
    return scored.select("doc_id", "held_out", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.n_features")
