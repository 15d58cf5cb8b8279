"""Vector code compression: product codes with exact integer arithmetic.

A component x becomes floor(256 x); a vector is cut into equal parts, each coded by the nearest entry
of its position's codebook.  Parts and entries are padded with zeros to a power of two, and turned by
the integer Walsh-Hadamard transform, which multiplies every squared distance by the padded size.
Squared differences are then added coefficient by coefficient in order of sequency (number of sign
changes), where most of a distance comes early: an entry whose partial sum exceeds the full distance
of another one is given up.  There is no floating point after the floor, so nothing is rounded and
results do not depend on how the rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components lie within this bound, so that squared distances fit in 64 bits.
LARGEST = 1 << 26
#: Rows that one step of numpy work takes.
ROWS = 4096


def hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows in order of sequency."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    return h[np.argsort(changes, kind="stable")]


@dataclass
class Codebooks:
    """Entries (parts x entries x width) as they are, and transformed."""

    entries: np.ndarray
    turned: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebooks:
        return cls(entries, transform(entries))

    def sha256(self) -> str:
        """Of all entries' components, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def transform(x: np.ndarray) -> np.ndarray:
    """The last axis padded with zeros to a power of two and transformed."""
    width = x.shape[-1]
    size = 1 << max(0, width - 1).bit_length()
    return x @ hadamard(size)[:, :width].T


def nearest(turned: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and scaled squared distance of the nearest transformed entry to each transformed row.

    Ties go to the lower index.  Live pairs of row and entry shrink from coefficient to coefficient.
    """
    n, k = len(turned), len(entries)
    part = (turned[:, :1] - entries[None, :, 0]) ** 2
    # The entry that leads after one coefficient gives a bound: its full distance.
    lead = part.argmin(axis=1)
    bound = ((turned - entries[lead]) ** 2).sum(axis=1)
    row, entry = np.nonzero(part <= bound[:, None])
    part = part[row, entry]
    for c in range(1, turned.shape[1]):
        part = part + (turned[row, c] - entries[entry, c]) ** 2
        live = part <= bound[row]
        row, entry, part = row[live], entry[live], part[live]
    # What is left has its full distance; the least one, then the lowest index, of each row.
    order = np.lexsort((entry, part, row))
    first = order[np.searchsorted(row[order], np.arange(n))]
    return entry[first], part[first]


def integers(column, dim: int) -> np.ndarray:
    """Rows of floor(256 x), shorter vectors padded with zeros to ``dim``; beyond LARGEST they stay there."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), dim), np.int64)
    flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _assigned(batches: Iterator[pa.RecordBatch], books: Codebooks, dim: int):
    """(batch, its integers by part, entry per part, squared distance per part)."""
    parts, _, width = books.entries.shape
    size = books.turned.shape[2]
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            x = integers(batch.column("v"), dim).reshape(-1, parts, width)
            turned = transform(x)
            entry, error = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
            for p in range(parts):
                entry[:, p], error[:, p] = nearest(turned[:, p], books.turned[p])
            yield batch, x, entry, error // size


def _sums(books: Codebooks, dim: int):
    """A task's sums per component of every entry, and its counts: 64 x dim rows at most."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, x, entry, _ in _assigned(batches, books, dim):
            slot = (entry + np.arange(parts) * entries).ravel()
            np.add.at(total, slot, x.reshape(-1, width))
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        cell = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))], names=["cell", "total", "count"])

    return run


def _codes(books: Codebooks, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, entry, error in _assigned(batches, books, dim):
            flat, n = entry.astype(np.uint8).tobytes(), entry.shape[1]
            codes = [flat[i : i + n] for i in range(0, len(flat), n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label")], pa.array(codes, pa.binary()), pa.array(error.sum(axis=1))], names=["id", "label", "code", "error"])

    return run


def kept_vectors(vectors: DataFrame, key: str, value: str, label: str) -> DataFrame:
    """(id, label, v): rows whose vector is not null and has finite components only."""
    v = F.col(value).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v")).filter(F.col("v").isNotNull()).filter(finite)


def train(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of ``rows`` (id, v): the vectors of the smallest ids, moved to their parts' means ``rounds`` times."""
    seeds = rows.filter("id is not null").orderBy("id", "v").limit(entries).select("v").toArrow()
    if not seeds.num_rows:
        return None
    books = Codebooks.of(np.ascontiguousarray(integers(seeds.column("v").combine_chunks(), dim).reshape(seeds.num_rows, parts, -1).swapaxes(0, 1)))
    for _ in range(rounds):
        wide = "decimal(38,0)"
        sums = rows.select("v").mapInArrow(_sums(books, dim), "cell long, total long, count long").groupBy("cell")
        # One row per component of an entry in use: entries x dim at most.
        moved = sums.agg(F.sum(F.col("total").cast(wide)).alias("total"), F.sum("count").alias("count")).collect()
        now = books.entries.copy()
        for r in moved:
            now.ravel()[r["cell"]] = int(r["total"]) // r["count"]
        books = Codebooks.of(now)
    return books


def compress(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code binary, error, label_error) of every kept vector, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out.  Shorter vectors than the
    longest are padded with zeros, as is a length that ``parts`` does not divide; components whose
    integer exceeds LARGEST (x beyond 262,144) count as LARGEST.  Rows that share an id are coded each;
    rows without an id are coded, but start no codebook.  ``label_error`` is the sum over rows of an equal
    label, nulls together.  An empty table, or one without an id, gives no rows and no codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code byte holds 1 to 256 entries")
    rows = staged(kept_vectors(vectors, key, value, label), "code-vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    dim = -(-longest // parts) * parts
    books = train(rows, dim, parts, entries, rounds)
    label_type = rows.schema["label"].dataType.simpleString()
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"id long, label {label_type}, code binary, error long, label_error long"), None
    coded = staged(rows.mapInArrow(_codes(books, dim), f"id long, label {label_type}, code binary, error long"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_of")))
    return out.select("id", "label", "code", "error", "label_error"), books
