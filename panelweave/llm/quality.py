"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Each shard of the sample runs the per-coordinate updates over its documents in seeded order; the
shards' weights are averaged.  A score is a sparse dot product with the average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .features import BITS, ngrams, per_row

#: Labelled rows in the training sample, at most about.
SAMPLE = 24_000
SHARDS = 4
NGRAM = 2
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 1.0


def _values(number: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's features in order: first place (rows + 1), number and value.

    A value is the root of the feature's share of the row's n-grams; the bias is feature 0.
    """
    of, number, count = per_row(number, row)
    total = np.bincount(of, weights=count, minlength=rows)
    value = np.sqrt(count / np.maximum(total[of], 1))
    return np.searchsorted(of, np.arange(rows + 1)), of, number, value


class Leader:
    """FTRL-proximal state."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[np.ndarray, np.ndarray, int]] = []
    for part in slices(batches, "text"):
        first, _, number, value = _values(*ngrams(part.column("text"), NGRAM), part.num_rows)
        for i, y in enumerate(part.column("y").to_pylist()):
            a, b = first[i], first[i + 1]
            rows.append((np.append(0, number[a:b]).astype(np.int32), np.append(1.0, value[a:b]).astype(np.float32), y))
    if not rows:
        return
    leader = Leader()
    for _ in range(PASSES):
        for at, x, y in rows:
            leader.update(at, x, y)
    w = leader.weights(np.arange(1 << BITS))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["feature", "w"])


def fit(sample: DataFrame, seed: int = 5) -> np.ndarray:
    """Weights by feature number from ``sample`` (doc_id, text, y); all zero without rows.

    The shards' weights, at most 2 ** BITS each, are averaged before they reach the driver.
    """
    dealt = sample.repartition(SHARDS, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id"), "y")
    weights = dealt.select("text", "y").mapInArrow(_train, "feature long, w double").groupBy("feature").agg((F.sum("w") / SHARDS).alias("w"))
    out = np.zeros(1 << BITS)
    for feature, w in weights.collect():
        out[feature] = w
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; a text without tokens scores by the bias alone."""
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, of, number, value = _values(*ngrams(part.column("text"), NGRAM), part.num_rows)
            z = weights[0] + np.bincount(of, weights=weights[number] * value, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
