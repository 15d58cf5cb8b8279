"""Hashed n-gram features of texts as flat arrays, and bounded training samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, span_hash, utf8

BITS = 18
#: Hash of the pair of a token with itself, whichever token that is.
REPEAT = 0x5851F42D4C957F2D
#: Bytes by class: 0 white space and controls, 1 letters, digits and longer characters, 2 the rest.
KIND = np.full(256, 2, np.uint8)
KIND[:33] = 0
KIND[128:] = 1
KIND[48:58] = KIND[65:91] = KIND[97:123] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of one class (words and runs of signs), and each text's first (n + 1)."""
    kind = KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return span_hash(prefix_hash(data), starts, ends), np.searchsorted(starts, offsets)


def ngrams(column, size: int, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (1 up; 0 is the bias) and row of every n-gram of up to ``size`` tokens."""
    data, offsets = utf8(column)
    if fold is not None:
        data = fold[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, first = tokens(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, rows, gram = [hashes], [row], hashes
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) if size > 1 else []
    if len(again):  # a token said twice running is a pair like any other of its kind
        found.append(np.full(len(again), REPEAT, np.uint64))
        rows.append(row[again])
    for n in range(2, size + 1):
        gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[n - 1 :]
        same = row[: len(gram)] == row[n - 1 :]
        found.append(mix(gram[same]))
        rows.append(row[: len(gram)][same])
    number = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.maximum(number, 1), np.concatenate(rows)


def per_row(number: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs in order, with their counts."""
    key, count = np.unique(row << BITS | number, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), count


def labelled(docs: DataFrame, labels: DataFrame, label: str, learns: Column, limit: int, seed: int) -> DataFrame:
    """(doc_id, text, y) of at most about ``limit`` labelled rows for which ``learns`` holds.

    The sample's ids and labels, of bounded size, go to the documents; no text moves for that.
    Of contradicting labels the larger counts; null labels and ids count for nothing.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & learns).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, limit / max(1, rows.count()))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows.filter(picked(F.col("doc_id"), seed, share))), "doc_id")


def picked(key: Column, seed: int, share: float) -> Column:
    """A deterministic ``share`` of the keys."""
    if share >= 1:
        return F.lit(True)
    return F.xxhash64(F.lit(seed), key) < F.lit(int((2 * share - 1) * (1 << 63)))
