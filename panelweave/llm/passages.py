"""Repeated passages over a whole corpus: every window of L symbols that also starts earlier.

Symbols are bytes or words.  Exact copies of a whole text are settled first, by digest.  In the
other texts each window is owned by its anchor, a gram of ``gram`` symbols inside it that only the
window's content picks, so equal windows have equal anchors:

1. every text reports its anchors' hashes once per chunk, packed to a few bytes each; the hashes
   that more than one document (or place) reports are found in one shuffle by buckets of them;
2. the texts that hold such anchors send, for each, the context: the run of symbols that covers
   all windows which the anchor owns.  Equal contexts of a chunk travel once;
3. contexts meet by anchor.  Of equal contexts all but the first are covered at once; the rest
   form shards of bounded size, in which a matcher (suffix array or FM-index) finds the windows
   that start earlier.  An anchor with more contexts than a shard holds is dealt out again by
   single windows, so no anchor ever has to fit one task;
4. covered windows go back to their documents as ranges.

Texts are shuffled by document once, and that exchange is read again by every step; what else
moves is proportional to the anchors, a fifteenth of the bytes or an eighth of the words, and to
the repeated passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, parts_for, prefix_hash, slices, span_hash, utf8, word_spans

#: Bytes of contexts in a shard: one is closed at the first anchor past SHARD_BYTES, and an
#: anchor with more than GROUP_BYTES is dealt out by single windows.
SHARD_BYTES = 2 << 20
GROUP_BYTES = 6 << 20


#: Bytes of texts looked at in one step: a step holds about a hundred bytes for each.
TEXT_BYTES = 1 << 20
#: Anchors whose hashes are reported together, and buckets of hashes to a shuffle partition; a bucket
#: is settled in one piece, and a report has a row for each.
ANCHORS, BUCKETS = 1 << 20, 2


ONE = np.uint64(1)

#: Tags that tell apart texts which share an id.
TAGS = 1 << 20


def _pack(start, tid, owned):
    """First window, tag and number of windows (under 64) in one long, in this order."""
    return (start * TAGS + tid) * 64 + owned


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at // (64 * TAGS), at // 64 % TAGS, at % 64


@dataclass(frozen=True)
class Shard:
    """Contexts that meet: their symbols end to end, and each one's place in document order.
    Equal windows stand in contexts of one group."""

    data: np.ndarray  # bytes
    offsets: np.ndarray  # of contexts in data
    owned: np.ndarray  # windows that start in each context: its first ``owned`` symbols
    doc: np.ndarray
    start: np.ndarray
    group: np.ndarray  # the anchor, rows of one anchor together


@dataclass(frozen=True)
class Passages:
    """What counts as repeated.

    window, gram: symbols of a window and of an anchor.  pick: symbols of the smaller grams of
    which the one with the least hash places the anchor; its place modulo the window's number of
    grams counts, which makes fewer anchors than picking among the grams themselves, or the same
    if pick = gram.  words: symbols are words, else bytes.
    within: earlier places of the same document count too.  match: the windows of a shard, in
    order of context and start, that also start earlier in it.
    """

    window: int
    gram: int
    pick: int
    words: bool
    within: bool
    match: Callable[[Shard, Passages], np.ndarray]


@dataclass(frozen=True)
class Symbols:
    """A chunk of texts as symbols: ``data`` holds symbol i in [lo[i], hi[i])."""

    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray  # first symbol of each text, n + 1 entries
    prefix: np.ndarray  # prefix hash over symbols


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, each followed by one blank, and where each starts."""
    lengths = ends - starts + 1
    at = np.cumsum(lengths) - lengths
    out = np.full(int(lengths.sum()), 0x20, np.uint8)
    index = np.arange(len(out)) - np.repeat(at, lengths)
    body = index < np.repeat(lengths - 1, lengths)
    out[body] = data[(index + np.repeat(starts, lengths))[body]]
    return out, at


def symbols(column, words: bool) -> Symbols:
    data, offsets = utf8(column)
    if not words:
        at = np.arange(len(data) + 1)
        return Symbols(data, at[:-1], at[1:], offsets, prefix_hash(data))
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hash(prefix_hash(data), starts, ends)
    spaced, at = single_spaced(data, starts, ends)
    return Symbols(spaced, at, at + (ends - starts), first, prefix_hash(hashes))


def anchors(s: Symbols, p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its hash, its text's row, the first window that it owns, and how many."""
    window, n = p.window, len(s.prefix) - 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none.astype(np.uint64), none, none, none
    at = np.arange(n - p.pick + 1)
    bits = np.uint64(n.bit_length())
    low = (span_hash(s.prefix, at, at + p.pick) >> bits << bits) | at.astype(np.uint64)
    wide, span = window - p.pick + 1, 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    row = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
    starts = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    least = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    place = starts + (least - starts) % (window - p.gram + 1)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    heads = np.flatnonzero(new)
    # 38 bits, most of whose differences take three bytes: a chance meeting of two hashes only makes a candidate, which the match refutes.
    return span_hash(s.prefix, place[heads], place[heads] + p.gram) >> np.uint64(26), row[starts[heads]], starts[heads], np.diff(np.append(heads, len(starts)))


def _apart(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that take part: those with an id and a text that is no later copy."""
    out = pc.and_(pc.is_valid(batch.column("doc")), pc.invert(batch.column("copy")))
    return batch if pc.all(out).as_py() else batch.filter(out)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


_HASHES = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("first", pa.int64()), ("base", pa.int64()), ("width", pa.int8()), ("blob", pa.binary())])
_REPEATED = pa.schema([("doc", pa.int64()), ("h", pa.int64())])
_CONTEXTS = pa.schema([("h", pa.int64()), ("ctx", pa.binary()), ("doc", pa.int64()), ("at", pa.int64()), ("open", pa.int8())])
_RANGES = pa.schema([("doc", pa.int64()), ("at", pa.int64())])


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _width(values: np.ndarray) -> int:
    return max(1, -(-int(values.max(initial=0)).bit_length() // 8))


def _packed(h: np.ndarray, doc: np.ndarray, several: np.ndarray, bucket: np.ndarray, stride: int, kind: int) -> pa.RecordBatch:
    """A row per bucket: its hashes in order, as differences of h // stride and a bit for ``several``,
    each with its document's distance from the smallest, in as few whole bytes as the batch needs."""
    order = np.lexsort((h, bucket))
    h, doc, several, bucket = h[order] // np.uint64(stride), doc[order], several[order], bucket[order]
    head = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(h)]
    gap = np.append(np.uint64(0), np.diff(h))[: len(h)]
    gap[head] = 0
    gap = gap * np.uint64(2) + several.astype(np.uint64)
    base = int(doc.min(initial=0))
    own = (doc - np.int64(base)).view(np.uint64)
    wide = [_width(gap), _width(own)]
    records = np.ascontiguousarray(np.concatenate([_bytes(gap, wide[0]), _bytes(own, wide[1])], axis=1))
    ends = (np.append(head, len(h)) * records.shape[1]).astype(np.int32)
    blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(records)])
    n = len(head)
    return _batch(_HASHES, bucket[head].astype(np.int32), np.full(n, kind, np.int8), h[head].astype(np.int64), np.full(n, base), np.full(n, wide[0] * 16 + wide[1], np.int8), blobs)


def _hashes_of(row: dict, stride: int, rest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, documents and ``several`` of one packed row."""
    a, b = divmod(row["width"], 16)
    records = np.frombuffer(row["blob"], np.uint8).reshape(-1, a + b)
    whole = np.zeros((2, len(records), 8), np.uint8)
    whole[0, :, :a], whole[1, :, :b] = records[:, :a], records[:, a:]
    gap, own = whole.view(np.uint64)[:, :, 0]
    h = (np.cumsum(gap >> ONE) + np.uint64(row["first"])) * np.uint64(stride) + np.uint64(rest)
    return h.view(np.int64), own.view(np.int64) + row["base"], gap & ONE > 0


def _report(p: Passages, buckets: int):
    """Anchor hashes, each once for the texts of about ANCHORS anchors, packed by bucket (h modulo
    ``buckets``): kind 0 with a document that holds it, and whether these texts hold several places; of
    the latter every document's pair follows as kind 1, in any bucket."""

    def told(h: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(head, len(h)))
        several = size > 1 if p.within else doc[head] != doc[head + size - 1]
        yield _packed(h[head], doc[head], several, h[head] % np.uint64(buckets), buckets, 0)
        pair = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) & np.repeat(several, size)
        if pair.any():
            h, doc = h[pair], doc[pair]
            yield _packed(h, doc, np.zeros(len(h), bool), mix(h ^ doc.astype(np.uint64)) % np.uint64(buckets), 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for part in slices(map(_apart, batches), "text", TEXT_BYTES):
            h, row, _, _ = anchors(symbols(part.column("text"), p.words), p)
            if not len(h):
                continue
            kept.append((h, part.column("doc").to_numpy(zero_copy_only=False)[row]))
            held += len(h)
            if held >= ANCHORS:
                yield from told(*(np.concatenate(x) for x in zip(*kept)))
                kept, held = [], 0
        if kept:
            yield from told(*(np.concatenate(x) for x in zip(*kept)))

    return run


def _repeated(p: Passages, buckets: int):
    """Pairs (document, hash) of the hashes seen in more than one place; rows come sorted by bucket,
    of which one is held at a time."""

    def solved(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, doc, several = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, h))
        h, doc, several = h[order], doc[order], several[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(head, len(h)))
        repeated = np.logical_or.reduceat(several, head) | ((size > 1) if p.within else (doc[head] != doc[head + size - 1]))
        out = np.repeat(repeated, size) & ~several
        if out.any():
            yield _batch(_REPEATED, doc[out], h[out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    h, doc, _ = _hashes_of(row, 1, 0)
                    yield _batch(_REPEATED, doc, h)
                    continue
                if row["bucket"] != last and parts:
                    yield from solved(parts)
                    parts = []
                last = row["bucket"]
                parts.append(_hashes_of(row, buckets, last))
        if parts:
            yield from solved(parts)

    return run


def _gather(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The spans of ``data`` as an Arrow binary array."""
    sizes = hi - lo
    ends = np.cumsum(sizes)
    index = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - sizes), sizes)
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))])


def _contexts(p: Passages):
    """The contexts of the repeated anchors; open 0 marks windows that this chunk already found
    covered, which need no context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(map(_apart, batches), "text", TEXT_BYTES):
            s = symbols(part.column("text"), p.words)
            h, row, start, owned = anchors(s, p)
            wanted = part.column("hashes")
            flat = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.repeat(np.arange(part.num_rows), [0 if x is None else x for x in wanted.value_lengths().to_pylist()])
            salt = lambda x, r: mix(x + np.uint64(0x632BE59BD9B4E019) * (r + 1).astype(np.uint64))
            keep = np.isin(salt(h, row), salt(flat, of))
            h, row, start, owned = h[keep], row[keep], start[keep], owned[keep]
            if not len(h):
                continue
            doc = part.column("doc").to_numpy(zero_copy_only=False)[row]
            tid = part.column("tid").to_numpy(zero_copy_only=False)[row]
            local = start - s.first[row]
            same = span_hash(s.prefix, start, start + owned + p.window - 1)
            order = np.lexsort((local, doc, same, h))
            new = np.append(True, (h[order][1:] != h[order][:-1]) | (same[order][1:] != same[order][:-1]))
            head = np.flatnonzero(new)
            leader = np.empty(len(h), np.int64)
            leader[order] = order[np.repeat(head, np.diff(np.append(head, len(h))))]
            covered = (doc != doc[leader]) | (p.within & (local != local[leader]))
            at = _pack(local, tid, owned)
            if covered.any():
                first, size = _joined(row[covered], local[covered], owned[covered])
                mine = np.flatnonzero(covered)[first[0]]
                n = len(mine)
                yield _batch(_CONTEXTS, doc[mine], pa.nulls(n, pa.binary()), doc[mine], _pack(first[1], tid[mine], size), np.zeros(n, np.int8))
            sent = ~covered
            ctx = _gather(s.data, s.lo[start[sent]], s.hi[start[sent] + owned[sent] + p.window - 2])
            yield _batch(_CONTEXTS, h[sent].view(np.int64), ctx, doc[sent], at[sent], np.ones(int(sent.sum()), np.int8))

    return run


def _joined(row: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Ranges in order, with those that follow on each other joined, in pieces that ``_pack`` holds:
    an index of a range of the same text, first window and windows."""
    head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + size[:-1])))
    total = np.add.reduceat(size, head)
    pieces = -(-total // 63)
    of = np.repeat(np.arange(len(head)), pieces)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * 63
    return (head[of], start[head][of] + at), np.minimum(63, total[of] - at)


def _runs(flags: np.ndarray, owned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows: their context, first window in it, and length."""
    of = np.repeat(np.arange(len(owned)), owned)
    at = np.arange(len(flags)) - np.repeat(np.cumsum(owned) - owned, owned)
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    head = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])))
    return of[hit[head]], at[hit[head]], np.diff(np.append(head, len(hit)))


def _windows(p: Passages, data: np.ndarray, offsets: np.ndarray, owned: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Every window of the contexts as bytes, with its context and its place in it."""
    of = np.repeat(np.arange(len(owned)), owned)
    at = np.arange(int(owned.sum())) - np.repeat(np.cumsum(owned) - owned, owned)
    if p.words:
        starts, ends, first = word_spans(data, offsets)
        head = first[of] + at
        return _gather(data, starts[head], ends[head + p.window - 1]), of, at
    lo = offsets[of] + at
    return _gather(data, lo, lo + p.window), of, at


def _meet(p: Passages):
    """Contexts sorted by (h, ctx, doc, at) to covered ranges (open 0); windows of anchors too
    large for a shard come out one by one (open 1)."""

    def ranges(doc, at):
        n = len(doc)
        return _batch(_CONTEXTS, np.zeros(n, np.int64), pa.nulls(n, pa.binary()), doc, at, np.zeros(n, np.int8))

    def solved(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        data, offsets = utf8(part.column("ctx"))
        doc, at = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "at"))
        start, tid, owned = _unpack(at)
        group = part.column("h").to_numpy(zero_copy_only=False)
        ctx, first, size = _runs(p.match(Shard(data, offsets, owned, doc, start, group), p), owned)
        return ranges(doc[ctx], _pack(start[ctx] + first, tid[ctx], size))

    def dealt(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(iter([rows]), "ctx", SHARD_BYTES // 4):
            data, offsets = utf8(part.column("ctx"))
            doc, at = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "at"))
            start, tid, owned = _unpack(at)
            text, of, place = _windows(p, data, offsets, owned)
            n = len(of)
            yield _batch(_CONTEXTS, np.zeros(n, np.int64), text, doc[of], _pack(start[of] + place, tid[of], 1), np.ones(n, np.int8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []  # rows not yet in a shard
        held = 0  # their bytes
        dealing = None  # the anchor that is being dealt out
        last = None  # anchor and context of the last row; document and place of its first twin
        for batch in slices(batches, "ctx", SHARD_BYTES):
            shut = batch.column("open").to_numpy(zero_copy_only=False) == 0
            if shut.any():
                yield batch.filter(pa.array(shut))
                batch = batch.filter(pa.array(~shut))
            if not batch.num_rows:
                continue
            h, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "doc", "at"))
            texts = batch.column("ctx")
            new = np.append(True, (h[1:] != h[:-1]) | ~_equal_next(texts))
            head = np.flatnonzero(new)
            leader = np.repeat(head, np.diff(np.append(head, len(h))))
            lead_doc, lead_at = doc[leader], at[leader]
            if last is not None and last[0] == h[0] and last[1] == texts[0].as_py():
                own = leader == 0
                lead_doc, lead_at = np.where(own, last[2], lead_doc), np.where(own, last[3], lead_at)
            last = (h[-1], texts[-1].as_py(), lead_doc[-1], lead_at[-1])
            covered = (doc != lead_doc) | (p.within & (at // (64 * TAGS) != lead_at // (64 * TAGS)))
            if covered.any():
                yield ranges(doc[covered], at[covered])
                batch = batch.filter(pa.array(~covered))
                h = h[~covered]
            if dealing is not None and len(h):
                stop = int(np.searchsorted(h, dealing, "right"))
                yield from dealt(batch.slice(0, stop))
                batch, h = batch.slice(stop), h[stop:]
                dealing = dealing if not len(h) else None
            if not len(h):
                continue
            pending.append(batch)
            held += int(utf8(batch.column("ctx"))[1][-1])
            if held < SHARD_BYTES:
                continue
            whole = pa.Table.from_batches(pending).combine_chunks().to_batches()[0]
            keys = whole.column("h").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield solved([whole.slice(0, cut)])
            pending = [whole.slice(cut)]
            held = int(utf8(pending[0].column("ctx"))[1][-1])
            if held > GROUP_BYTES:
                yield from dealt(pending[0])
                pending, held, dealing = [], 0, keys[-1]
        if pending:
            yield solved(pending)

    return run


def _equal_next(texts: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it."""
    return pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False).astype(bool)


def _firsts(p: Passages):
    """Single windows sorted by (ctx, doc, at): all but the first place are covered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # window, and document and place of its first twin
        for batch in slices(batches, "ctx", SHARD_BYTES):
            doc, at, opened = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "at", "open"))
            done = opened == 0
            if done.any():
                yield _batch(_RANGES, doc[done], at[done])
                batch = batch.filter(pa.array(~done))
                doc, at = doc[~done], at[~done]
            if not len(doc):
                continue
            texts = batch.column("ctx")
            head = np.flatnonzero(np.append(True, ~_equal_next(texts)))
            leader = np.repeat(head, np.diff(np.append(head, len(doc))))
            lead_doc, lead_at = doc[leader], at[leader]
            if last is not None and last[0] == texts[0].as_py():
                lead_doc, lead_at = np.where(leader == 0, last[1], lead_doc), np.where(leader == 0, last[2], lead_at)
            last = (texts[-1].as_py(), lead_doc[-1], lead_at[-1])
            covered = (doc != lead_doc) | (p.within & (at // (64 * TAGS) != lead_at // (64 * TAGS)))
            if covered.any():
                yield _batch(_RANGES, doc[covered], at[covered])

    return run


def _with_copies(keyed: DataFrame) -> DataFrame:
    """``keyed`` (doc, text, ...) with ``tid``, a tag of the text for rows that share an id, and
    ``copy``, true for a text that a smaller document holds whole."""
    tag = F.xxhash64("text").bitwiseAND(F.lit(TAGS - 1)).alias("tid")
    texts = keyed.filter(F.col("doc").isNotNull() & F.col("text").isNotNull()).select("doc", tag, F.unhex(F.sha2("text", 256)).alias("digest"))
    leads = texts.groupBy("digest").agg(F.min("doc").alias("lead"))
    later = texts.join(leads, "digest").filter("doc > lead").groupBy("doc").agg(F.collect_set("tid").alias("copies"))
    marked = keyed.join(later.hint("shuffle_hash"), "doc", "left").withColumn("tid", tag)
    return marked.withColumn("copy", F.coalesce(F.array_contains("copies", F.col("tid")), F.lit(False))).drop("copies")


def _covered(marked: DataFrame, p: Passages) -> DataFrame:
    """(doc, at) of the windows that also start earlier, of texts that are no copies.

    ``at`` packs the first window, the text's tag and the number of windows, see ``_pack``.
    """
    n = parts_for(marked)
    buckets = n * BUCKETS
    hashes = marked.mapInArrow(_report(p, buckets), "bucket int, kind byte, first long, base long, width byte, blob binary")
    hashes = hashes.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")
    repeated = hashes.mapInArrow(_repeated(p, buckets), "doc long, h long").groupBy("doc").agg(F.collect_set("h").alias("hashes"))
    joined = marked.join(repeated.hint("shuffle_hash"), "doc", "left")
    contexts = joined.mapInArrow(_contexts(p), "h long, ctx binary, doc long, at long, open byte")
    met = contexts.repartition(n, "h").sortWithinPartitions("h", "ctx", "doc", "at").mapInArrow(_meet(p), contexts.schema)
    dealt = met.drop("h").repartition(n, F.when(F.col("open") == 1, F.xxhash64("ctx")).otherwise(F.col("doc")))
    return dealt.sortWithinPartitions("ctx", "doc", "at").mapInArrow(_firsts(p), "doc long, at long")


def _cut(p: Passages, own: list[str]):
    """Each text's symbols without the covered ones: counts, removed runs, and what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", TEXT_BYTES):
            s = symbols(part.column("text"), p.words)
            n, total = part.num_rows, len(s.lo)
            spans = part.column("spans")
            of = np.repeat(np.arange(n), [0 if x is None else x for x in spans.value_lengths().to_pylist()])
            start, tid, owned = _unpack(spans.flatten().to_numpy(zero_copy_only=False))
            mine = tid == part.column("tid").fill_null(-1).to_numpy(zero_copy_only=False)[of]
            begin, owned = s.first[of[mine]] + start[mine], owned[mine]
            edge = np.bincount(begin, minlength=total + 1) - np.bincount(begin + owned + p.window - 1, minlength=total + 1)
            row = np.repeat(np.arange(n), np.diff(s.first))
            copy = part.column("copy").to_numpy(zero_copy_only=False) & (np.diff(s.first) >= p.window)
            gone = (np.cumsum(edge[:total]) > 0) | copy[row]
            removed = np.bincount(row[gone], minlength=n)
            head = gone.copy()
            head[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
            first = np.flatnonzero(head)
            tail = gone.copy()
            tail[:-1] &= ~(gone[1:] & (row[1:] == row[:-1]))
            runs = np.bincount(row[first], minlength=n)
            bounds = pa.array(np.append(0, np.cumsum(runs)).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(first - s.first[row[first]]), pa.array(np.flatnonzero(tail) + 1 - s.first[row[first]])], names=["start", "stop"])
            stay = ~gone
            size = np.bincount(row[stay], minlength=n)
            if p.words:
                spaced, at = single_spaced(s.data, s.lo[stay], s.hi[stay])
                ends = np.append(at, len(spaced))[np.cumsum(size)]
                starts = np.append(0, ends[:-1])
                kept = _gather(spaced, starts, np.maximum(starts, ends - 1))
            else:
                ends = np.cumsum(size)
                kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(s.data[stay]))])
            names = [*own, "n_symbols", "n_removed", "runs", "kept"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(np.diff(s.first)), pa.array(removed), pa.ListArray.from_arrays(bounds, pairs), kept], names=names)

    return run


def remove_repeats(docs: DataFrame, p: Passages) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with ``n_symbols``, ``n_removed``, ``runs``
    (array of start, stop in symbols) and ``kept`` (binary) in place of clashing columns.

    A symbol goes if a window that covers it also starts earlier; windows are judged on the input.
    Rows without an id neither lose symbols nor make others lose any; a null text has none.
    """
    added = ["n_symbols", "n_removed", "runs", "kept"]
    own = [c for c in docs.columns if c.lower() not in added]
    names = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(own)]
    plain = docs.select(own).toDF(*names)
    marked = _with_copies(plain.withColumn("doc", F.col("doc_id").cast("long")))
    spans = _covered(marked, p).groupBy("doc").agg(F.collect_list("at").alias("spans"))
    joined = marked.join(spans.hint("shuffle_hash"), "doc", "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    schema = f"{fields}, n_symbols long, n_removed long, runs array<struct<start: long, stop: long>>, kept binary"
    return joined.mapInArrow(_cut(p, names), schema).toDF(*own, *added)
