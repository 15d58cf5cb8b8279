"""Toxicity from confirmed examples and unlabelled text: non-negative positive-unlabelled learning.

With class prior p, the risk of a classifier is p R+(positives) + R-(unlabelled) - p R-(positives);
the last two estimate the negatives' risk and cannot be below zero, so a step that takes them there
goes back up instead.  The classifier is linear in the presence of words that stand in clearly
more of the confirmed documents than of the unlabelled ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .features import BITS, labelled, ngrams, per_row, picked
from .simhash import LOWER

#: Confirmed and unlabelled documents in the training sample, at most about.
POSITIVES, UNLABELLED = 8_000, 24_000
NGRAM = 1
#: Confirmed documents in which a feature must stand to count, as a number and as a share; its
#: excess among them in standard errors of the pooled share; the share of toxic ones among the
#: documents that hold it, by the prior.
LEAST_DOCS, LEAST_SHARE, LEAST_EXCESS, LEAST_PURITY = 4, 0.01, 4.0, 0.75
STEPS, RATE, L2 = 300, 0.3, 1e-6


class Rows:
    """Presence features of documents, flat."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        sizes = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in parts)]).astype(np.int64)
        self.n = len(sizes)
        self.flat = np.concatenate([np.zeros(0, np.int32), *(f for _, f in parts)])
        self.of = np.repeat(np.arange(self.n), sizes)

    def only(self, used: np.ndarray) -> Rows:
        """The same documents with the used features alone."""
        keep = used[self.flat]
        out = Rows([])
        out.n, out.flat, out.of = self.n, self.flat[keep], self.of[keep]
        return out

    def margin(self, w: np.ndarray, b: float) -> np.ndarray:
        return b + np.bincount(self.of, weights=w[self.flat], minlength=self.n)

    def slope(self, d: np.ndarray) -> np.ndarray:
        """Sum by feature of the slopes ``d`` of its documents."""
        return np.bincount(self.flat, weights=d[self.of], minlength=1 << BITS)


def telling(positive: Rows, unlabelled: Rows, prior: float) -> np.ndarray:
    """Features that clearly more confirmed documents hold, and mostly toxic ones at that prior."""
    a, b = (np.bincount(rows.flat, minlength=1 << BITS) for rows in (positive, unlabelled))
    n, m = max(1, positive.n), max(1, unlabelled.n)
    share = (a + b) / (n + m)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n + 1 / m))
    pure = prior * a / n >= LEAST_PURITY * b / m
    return (a >= max(LEAST_DOCS, LEAST_SHARE * n)) & ((a / n - b / m) >= LEAST_EXCESS * error) & pure


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(positive: Rows, unlabelled: Rows, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by AdaGrad over the non-negative risk with the logistic loss.

    The features speak for the class, so their weights stay at or above zero.
    """
    used = telling(positive, unlabelled, prior)
    positive, unlabelled = positive.only(used), unlabelled.only(used)
    w, b = np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    square, square_b = np.full(1 << BITS, 1e-6), 1e-6
    for _ in range(STEPS):
        zp, zu = positive.margin(w, b), unlabelled.margin(w, b)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Slopes by margin: of p R+ and - p R- on confirmed documents, of R- on unlabelled ones.
        up, down, rest = prior * (sp - 1) / positive.n, -prior * sp / positive.n, su / unlabelled.n
        dp, du = (up + down, rest) if negative >= 0 else (up - down, -rest)
        g = positive.slope(dp) + unlabelled.slope(du) + L2 * w
        gb = dp.sum() + du.sum()
        square += g * g
        square_b += gb * gb
        w = np.where(used, np.maximum(w - RATE * g / np.sqrt(square), 0.0), 0.0)
        b -= RATE * gb / np.sqrt(square_b)
    return w, b


def _features(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    of, number, _ = per_row(*ngrams(column, NGRAM, LOWER))
    return np.bincount(of, minlength=n), number.astype(np.int32)


def _train(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, list] = {0: [], 1: []}
        seen: set[tuple[int, int]] = set()  # copies of a text count once on each side
        for part in slices(batches, "text"):
            y = part.column("y").to_numpy(zero_copy_only=False)
            texts = part.column("h").to_pylist()
            new = np.array([(s, h) not in seen and not seen.add((s, h)) for s, h in zip(y.tolist(), texts)], bool)
            for side in (0, 1):
                rows = part.filter(pa.array(new & (y == side)))
                if rows.num_rows:
                    sides[side].append(_features(rows.column("text"), rows.num_rows))
        positive, unlabelled = Rows(sides[1]), Rows(sides[0])
        if not positive.n or not unlabelled.n:
            return
        w, b = train(positive, unlabelled, prior)
        w[0] = b
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["feature", "w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learns: Column, label: str = "toxic", seed: int = 11) -> np.ndarray:
    """Weights by feature number, the bias at 0, from rows for which ``learns`` holds.

    Confirmed examples are the labelled ones with label 1, the prior is their share among the
    labelled; unlabelled text is a sample of all documents.  Without either, all documents score
    by the prior alone.
    """
    ids = F.col("doc_id").isNotNull()
    known = labels.filter(F.col(label).isNotNull() & ids & learns).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("ones")).first()
    prior = min(0.99, max(0.001, (known["ones"] or 0) / max(1, known["n"])))
    confirmed = labelled(docs, labels.filter(F.col(label) == 1), label, learns, POSITIVES, seed)
    everything = docs.filter(learns & ids)
    share = min(1.0, UNLABELLED / max(1, everything.count()))
    plain = everything.filter(picked(F.col("doc_id"), seed + 1, share)).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("y"))
    both = confirmed.select("doc_id", "text", "y").unionByName(plain)
    # The sample is bounded, so one task trains on all of it.
    dealt = both.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(seed), "doc_id"), "y")
    out = np.zeros(1 << BITS)
    out[0] = np.log(prior / (1 - prior))
    for feature, w in dealt.select("text", "y", F.xxhash64("text").alias("h")).mapInArrow(_train(prior), "feature long, w double").collect():
        out[feature] = w
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; a text without tokens scores by the bias alone."""
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            of, number, _ = per_row(*ngrams(part.column("text"), NGRAM, LOWER))
            z = weights[0] + np.bincount(of, weights=weights[number], minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
