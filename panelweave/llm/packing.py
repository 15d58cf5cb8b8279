"""Harmonic packing of tokenised documents into sequences of a power-of-two capacity.

Lengths are cut into reciprocal classes of the capacity, 1, 1/2, 1/4, ... 1/2048: whole sequences
first, then the binary digits of the rest.  A bin of class 1/k holds exactly k documents' pieces and
is full, so every task fills its own bins with nothing but a counter per class, without a shuffle.
What is left in a task's open bins goes into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefix_hash, slices, span_hash, utf8, word_spans

CAPACITY = 2048
END = 1
#: Distinct words whose ids a worker remembers before it forgets those that one chunk alone has held.
CACHE_WORDS = 400_000
#: Text bytes tokenised at a time.
TEXT_BYTES = 1 << 20
#: Stands between words that are tokenised together.
PARTING = "\U0010fffd\U0010fffc\U0010fffd"

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordIds:
    """Token ids of whitespace-separated words, each distinct word of a chunk looked up once.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids.  New
    words are tokenised as one string, parted by a token added for this, which belongs to no text.
    """

    def __init__(self, path: str):
        # Spark's tasks are the threads; the tokenizer's own would only contend with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.path, self.tokenizer = path, Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(PARTING, normalized=False, special=True)])
        self.parting = self.tokenizer.token_to_id(PARTING)
        self.place: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)  # of a word's ids in flat; the next entry ends them
        self.again = np.zeros(0, bool)  # words that a later chunk has asked for

    def _trim(self) -> None:
        """Keep the words that more than one chunk has held."""
        keep = np.flatnonzero(self.again[: len(self.place)])
        words = list(self.place)
        size = self.first[keep + 1] - self.first[keep]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.arange(total) + np.repeat(self.first[keep] - (ends - size), size)]
        self.place = {words[k]: n for n, k in enumerate(keep.tolist())}
        self.flat[:total] = flat
        self.first[1 : len(keep) + 1] = ends
        self.again[:] = False

    def _learn(self, words: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([PARTING.join(w.decode() for w in words)], add_special_tokens=False)[0].ids, np.uint32)
        parting = np.append(np.flatnonzero(ids == self.parting), len(ids))
        if len(parting) != len(words):  # a word holds the parting token itself
            each = [np.array(self._plain(w), np.uint32) for w in words]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        else:
            ids, ends = ids[ids != self.parting], parting - np.arange(len(words))
        n = len(self.place)
        for i, w in enumerate(words):
            self.place[w] = n + i
        while len(self.first) <= n + len(words):
            self.first = np.append(self.first, np.zeros_like(self.first))
        base = int(self.first[n])
        while len(self.flat) < base + len(ids):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[base : base + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(words)] = base + ends

    def _plain(self, word: bytes) -> list[int]:
        """Ids of a word by a tokenizer without the parting token."""
        from tokenizers import Tokenizer

        if not hasattr(self, "untouched"):
            self.untouched = Tokenizer.from_file(self.path)
        return self.untouched.encode(word.decode(), add_special_tokens=False).ids

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each text's with the end id after them, and where each text starts (n + 1)."""
        starts, ends, first = word_spans(data, offsets)
        code, distinct = pd.factorize(span_hash(prefix_hash(data), starts, ends)) if len(starts) else (np.zeros(0, np.int64), [])
        one = np.zeros(len(distinct), np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]  # the first place of each word
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
        if len(self.place) > CACHE_WORDS:
            self._trim()
        place, known = self.place, len(self.place)
        new = [w for w in words if w not in place]
        if new:
            self._learn(new)
        if len(self.again) < len(self.first):
            self.again = np.append(self.again, np.zeros(len(self.first) - len(self.again), bool))
        at = np.fromiter((place[w] for w in words), np.int64, len(words))
        self.again[at[at < known]] = True
        at = at[code]
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.arange(total) + np.repeat(self.first[at] - (ends - sizes), sizes)]
        bounds = np.append(0, ends)[first]
        return np.insert(out, bounds[1:], END), bounds + np.arange(len(bounds))


_tables: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of these lengths, in order: document, start and size."""
    classes = 1 << np.arange(capacity.bit_length() - 1, -1, -1)
    counts = np.stack([lengths // capacity, *((lengths & c) // c for c in classes[1:])], axis=1)
    size = np.repeat(np.tile(classes, len(lengths)), counts.ravel())
    doc = np.repeat(np.arange(len(lengths)), counts.sum(axis=1))
    before = np.cumsum(size) - size
    first = np.cumsum(lengths) - lengths
    return doc, before - first[doc], size


def tails(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of the last ``count`` pieces of a class, in bins that hold powers of two."""
    sizes = [1 << b for b in range(count.bit_length() - 1, -1, -1) if count >> b & 1]
    return np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])


def _pack(path: str, capacity: int):
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def batch(rows: dict, sequence: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        columns = [rows["doc_id"], *(pa.array(rows[c]) for c in ("start", "length", "doc_tokens")), pa.array(sequence), pa.array(place * rows["length"]), rows["ids"]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def take(rows: dict, at: np.ndarray) -> dict:
        return {c: x.take(pa.array(at)) if isinstance(x, pa.Array) else x[at] for c, x in rows.items()}

    def join(a: dict | None, b: dict) -> dict:
        if a is None:
            return b
        return {c: pa.concat_arrays([a[c], x]) if isinstance(x, pa.Array) else np.append(a[c], x) for c, x in b.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(path)
        base = TaskContext.get().partitionId() << 40
        filled: dict[int, int] = {}  # closed bins by piece size
        left: dict[int, dict] = {}  # pieces of the open bin by size
        number = lambda size: base + (size.bit_length() - 1 << 36)
        for part in slices(batches, "text", TEXT_BYTES):
            ids, bounds = ids_of.ids(*utf8(part.column("text")))
            lengths = np.diff(bounds)
            doc, start, size = cut(lengths, capacity)
            order = np.argsort(-size, kind="stable")
            doc, start, size = doc[order], start[order], size[order]
            lo = bounds[doc] + start
            stops = np.cumsum(size)
            raw = ids[np.arange(int(stops[-1])) + np.repeat(lo - (stops - size), size)].astype("<u4")
            column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, stops * 4).astype(np.int32)), pa.py_buffer(raw)])
            rows = {"doc_id": part.column("doc_id").take(pa.array(doc)), "start": start, "length": size, "doc_tokens": lengths[doc], "ids": column}
            for s in np.unique(size).tolist():
                mine = join(left.get(s), take(rows, np.flatnonzero(size == s)))
                each = capacity // s
                n = len(mine["start"]) // each * each
                at = np.arange(n)
                if n:
                    yield batch(take(mine, at), number(s) + filled.get(s, 0) + at // each, at % each)
                filled[s] = filled.get(s, 0) + n // each
                left[s] = take(mine, np.arange(n, len(mine["start"])))
        for s, rows in left.items():
            if len(rows["start"]):
                bins, place = tails(len(rows["start"]))
                yield batch(rows, number(s) + filled[s] + bins, place)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all rows of ``docs``.

    ``tokenizer``: path of a tokenizer file that every executor has.  ``ids``: the piece's ids as
    little-endian unsigned 32-bit numbers.  Every row is a document of its own, a null or empty
    text included: its ids and the end id.  Sequences are numbered by task, class and bin, and are
    all of length ``capacity`` or another power of two, so no id of padding is needed.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, capacity), SCHEMA)
