"""Language identification as mixture inference over hashed character trigrams.

A document's trigrams come from a mixture of languages.  Expectation-maximisation estimates the
proportions from each language's trigram likelihoods; the set of languages is the one whose
likelihood, less a penalty for each further language, is best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

BUCKETS = 4096
#: A model holds a row of BUCKETS per language; more languages than this are an error.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
ROUNDS = 12
#: The penalty for each language of a set beyond the first, in units of half the logarithm of the
#: trigram count.
PENALTY = 1.0
ROWS = 512

#: ASCII letters in lower case, other ASCII as blanks, bytes of longer characters as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 0x20
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    likelihood: np.ndarray  # languages x BUCKETS


def trigrams(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every trigram of bytes that is not all blanks."""
    data, offsets = utf8(column)
    data = FOLD[data]
    # Latin-1 capitals, two bytes each, in lower case.
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[upper] += 0x20
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    keep = (row[2:] == row[:-2]) & ((a | b | c) != 0x20)
    mixed = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(20)).astype(np.int64)[keep], row[:-2][keep]


def _count(language: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            codes = part.column(language).dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            bucket, row = trigrams(part.column("text"))
            names = codes.dictionary.to_pylist()
            found = np.bincount(which[row] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
            for name, counts in zip(names, found):
                totals[name] = totals[name] + counts if name in totals else counts
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "bucket", "n"])

    return run


def fit(docs: DataFrame, language: str = "lang") -> Model:
    """Trigram likelihoods of every language in ``docs`` (text, lang), over all its rows.

    Tasks send one row per language and bucket; rows without a language or text are left out.
    """
    known = docs.filter(F.col(language).isNotNull() & F.col("text").isNotNull()).select("text", F.col(language).alias("lang"))
    counts = known.mapInArrow(_count("lang"), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(names), BUCKETS), SMOOTHING)
    at = {name: i for i, name in enumerate(names)}
    for name, bucket, n in counts.collect():
        table[at[name], bucket] += n
    return Model(names, (table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def mixture(counts: np.ndarray, likelihood: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each row of ``counts`` from ``share`` on, and their log likelihoods.

    Languages with share zero stay out.
    """
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(ROUNDS):
        share = share * ((counts / np.maximum(share @ likelihood, 1e-30)) @ likelihood.T) / total
    score = np.einsum("dg,dg->d", counts, np.log(np.maximum(share @ likelihood, 1e-30)))
    return share, score


def select(counts: np.ndarray, likelihood: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions over the selected languages of each row, and over all languages."""
    d, languages = len(counts), len(likelihood)
    single = counts @ np.log(likelihood).T
    full, best_score = mixture(counts, likelihood, np.full((d, languages), 1 / languages, np.float32))
    order = np.argsort(-full, axis=1, kind="stable")
    chosen = np.zeros((d, languages), np.float32)
    top = single.argmax(axis=1)
    chosen[np.arange(d), top] = 1
    cost = PENALTY * 0.5 * np.log(np.maximum(counts.sum(axis=1), 2))
    best = single.max(axis=1)
    # No set beats the full mixture's likelihood, so rows it cannot lift over the penalty are done;
    # a set grows as long as that is possible.
    open_ = np.flatnonzero(best_score - cost > best)
    for size in range(2, languages + 1):
        open_ = open_[best_score[open_] - (size - 1) * cost[open_] > best[open_]]
        if not len(open_):
            break
        start = np.zeros((len(open_), languages), np.float32)
        rows = np.arange(len(open_))[:, None]
        start[rows, order[open_, :size]] = np.maximum(full[open_][rows, order[open_, :size]], 1e-3)
        start /= start.sum(axis=1, keepdims=True)
        share, score = mixture(counts[open_], likelihood, start)
        score -= (size - 1) * cost[open_]
        better = score > best[open_]
        chosen[open_[better]] = share[better]
        best[open_[better]] = score[better]
    return chosen, full


def _letters(column) -> np.ndarray:
    """Whether each text has a letter."""
    data, offsets = utf8(column)
    ascii_ = (data < 128) & (FOLD[data] != 0x20)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.bincount(row[ascii_], minlength=len(offsets) - 1) > 0
    wide = np.bincount(row[data >= 128], minlength=len(offsets) - 1) > 0
    for i in np.flatnonzero(wide & ~out):
        out[i] = any(ch.isalpha() for ch in bytes(data[offsets[i] : offsets[i + 1]]).decode())
    return out


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in slices(batches, "text"):
            for lo in range(0, chunk.num_rows, ROWS):
                part = chunk.slice(lo, ROWS)
                n = part.num_rows
                known = _letters(part.column("text")) & bool(model.languages)
                names, score, sets = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
                at = np.flatnonzero(known)
                if len(at):
                    bucket, row = trigrams(part.column("text"))
                    counts = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)[at].astype(np.float32)
                    chosen, full = select(counts, model.likelihood)
                    top = chosen.argmax(axis=1)
                    score[at] = np.clip(full[np.arange(len(at)), top], 0, 1)
                    for i, k, share in zip(at, top, chosen):
                        names[i] = model.languages[k]
                        sets[i] = [{"lang": model.languages[j], "share": float(share[j])} for j in np.flatnonzero(share > 0)]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names), pa.array(score), pa.array(sets, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    return run


def identify(docs: DataFrame, model: Model, key: Column | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row of ``docs``.

    ``languages`` are the selected ones with their shares, ``lang_pred`` the largest of them (the
    first by name on ties), ``score`` its share among all languages.  A text that is null or has no
    letter, and any text under a model without languages, is ``und`` with score 0.
    """
    key = F.col("doc_id") if key is None else key
    schema = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    return docs.select(key.cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), schema)
