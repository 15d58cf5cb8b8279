"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that share a key meet in a bucket.  A bucket is stored as bit planes: word w of
plane p holds bit p of 64 fingerprints.  A query's bit, spread over a word, gives 64 differences
at once; carry-save counters add them up, one bitwise step per plane, and a block of 64 leaves
the scan as soon as all its counts exceed the radius.  Blocks whose members are linked with the
query already are not compared again, so a dense bucket costs about one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, parts_for, slices, staged, utf8, word_spans
from .components import components
from .passages import single_spaced

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text bytes sketched at a time: shingles pass through Python lists.
TEXT_BYTES = 2 << 20
#: Members of a bucket beyond which its rows are dealt out by finer keys, where these lose no link.
BUCKET = 2048
#: Blocks compared in one step of numpy work.
PAIRS = 1 << 17

ONE, ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def _shingle_hashes(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the word shingles of lower-cased texts, and each text's first (n + 1)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    spaced, at = single_spaced(data, starts, ends)
    sizes = np.diff(first)
    count = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
    bounds = np.append(0, np.cumsum(count))
    row = np.repeat(np.arange(len(sizes)), count)
    head = first[row] + np.arange(bounds[-1]) - bounds[row]
    tail = head + np.minimum(width, sizes[row]) - 1
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    lo, hi = at[head].tolist(), (at[tail] + ends[tail] - starts[tail]).tolist()
    return np.fromiter((digest(raw[a:b], 42) for a, b in zip(lo, hi)), np.uint64, len(lo)), bounds


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text the bits that more than half of its hashes set; zero without hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    rows = np.flatnonzero(np.diff(bounds))
    step = 1 << 17  # hashes unpacked at a time
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(bounds[rows], bounds[rows[lo]] + step)))
        mine = rows[lo:hi]
        total = np.zeros((len(mine), 64), np.int64)
        for a in range(int(bounds[mine[0]]), int(bounds[mine[-1] + 1]), step):
            b = min(a + step, int(bounds[mine[-1] + 1]))
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cut = np.maximum(bounds[mine], a)
            part = cut < np.minimum(bounds[mine + 1], b)
            total[part] += np.add.reduceat(bits, cut[part] - a, axis=0, dtype=np.int32)
        set_ = total * 2 > np.diff(bounds)[mine][:, None]
        out[mine] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64)[:, 0]
        lo = hi
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the 64-bit SimHash over shingles of ``width`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = majority(*_shingle_hashes(part.column("text"), width))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes in order and once."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.ones(len(row), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[first], np.append(0, np.cumsum(np.bincount(row[first], minlength=len(bounds) - 1)))


def sketches(docs: DataFrame, route: int, width: int, words: int) -> DataFrame:
    """(doc_id, text_hash, route, f0, f1, ..., same, size) of docs (doc_id, text_hash, text): a routing
    fingerprint over ``route``-word shingles, ``words`` fingerprints of 64 bits over the distinct
    ``width``-word shingles, their hashes remixed from one XXH64, a hash of the set of these, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", TEXT_BYTES):
            routes = majority(*_distinct(*_shingle_hashes(part.column("text"), route)))
            hashes, bounds = _distinct(*_shingle_hashes(part.column("text"), width))
            cols = [majority(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)), bounds) for k in range(words)]
            total = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
            cols = [routes, *cols, total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *(pa.array(x.view(np.int64)) for x in cols)], names=names)

    names = ["doc_id", "text_hash", "route", *(f"f{k}" for k in range(words)), "same", "size"]
    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


# ------------------------------------------------------------------ bit-sliced comparison
def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above the radius."""
    above, equal = over.copy(), ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _near(planes: np.ndarray, valid: np.ndarray, words: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, block) with lanes within the radius, and these lanes as bits."""
    depth = max(1, (radius + 1).bit_length())
    counters = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    over = ~valid[block]
    for p in range(len(planes)):
        carry = planes[p][block] ^ (np.uint64(0) - (words[p >> 6][query] >> np.uint64(p & 63) & ONE))
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7 and p > radius:
            far = _exceeds(counters, over, radius)
            stay = far != ALL
            if not stay.all():
                query, block, over = query[stay], block[stay], over[stay]
                counters = [c[stay] for c in counters]
                if not len(query):
                    break
    return query, block, ~_exceeds(counters, over, radius)


def _settle(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def bucket_links(size: np.ndarray, words: list[np.ndarray], radius: int) -> np.ndarray:
    """Each member's first linked member, over buckets laid end to end."""
    n = int(size.sum())
    head = np.cumsum(size) - size
    bucket = np.repeat(np.arange(len(size)), size)
    at = np.arange(n) - head[bucket]
    blocks = -(-size // 64)
    first = np.cumsum(blocks) - blocks
    of = first[bucket] + at // 64
    lane = (at % 64).astype(np.uint64)
    heads = np.flatnonzero(at % 64 == 0)
    planes = np.stack([np.bitwise_or.reduceat((w >> np.uint64(p) & ONE) << lane, heads) for w in words for p in range(64)])
    valid = np.bitwise_or.reduceat(ONE << lane, heads)
    label = np.arange(n)
    # The first members of all buckets query first: in dense buckets they link nearly everything.
    order = np.argsort(at, kind="stable")
    ahead = blocks[bucket] - at // 64  # a query meets its own block and those after it
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(ahead[order[lo : lo + PAIRS]]), PAIRS, "right")) + lo)
        mine = order[lo:hi]
        query = np.repeat(mine, ahead[mine])
        block = of[query] + np.arange(len(query)) - np.repeat(np.cumsum(ahead[mine]) - ahead[mine], ahead[mine])
        low, high = np.minimum.reduceat(label, heads), np.maximum.reduceat(label, heads)
        open_ = (low[block] != label[query]) | (high[block] != label[query])
        query, block, near = _near(planes, valid, words, query[open_], block[open_], radius)
        rows, lanes = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = query[rows], heads[block[rows]] + lanes
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            label = _settle(label)
        lo = hi
    return label


def _meet(radius: int, words: int, finer):
    """Rows sorted by key to links (open 0), or to rows under finer keys where a bucket is too large (open 1)."""
    names = ["key", "fixed", "node", "route", *(f"f{k}" for k in range(words))]
    fields = [*names, "other", "open"]

    def batch(columns: dict, n: int) -> pa.RecordBatch:
        zero = np.zeros(n, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, zero)) for c in fields], names=fields)

    def solved(rows: dict) -> Iterator[pa.RecordBatch]:
        key = rows["key"]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        big = np.repeat(size > BUCKET, size)
        if big.any():
            yield dealt({c: x[big] for c, x in rows.items()})
        fit = np.repeat((size > 1) & (size <= BUCKET), size)
        if fit.any():
            node = rows["node"][fit]
            label = bucket_links(size[(size > 1) & (size <= BUCKET)], [rows[f"f{k}"][fit].view(np.uint64) for k in range(words)], radius)
            linked = label != np.arange(len(label))
            yield batch({"node": node[linked], "other": node[label[linked]]}, int(linked.sum()))

    def dealt(rows: dict) -> pa.RecordBatch:
        out = finer(rows)
        n = len(out["key"])
        return batch(out | {"open": np.ones(n, np.int64)}, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict | None = None  # rows of the last key
        dealing = None
        for part in batches:
            rows = {c: part.column(c).to_numpy(zero_copy_only=False) for c in names}
            if kept is not None:
                rows = {c: np.concatenate([kept[c], rows[c]]) for c in names}
            key = rows["key"]
            if not len(key):
                continue
            if dealing is not None:
                stop = int(np.searchsorted(key, dealing, "right"))
                if stop:
                    yield dealt({c: x[:stop] for c, x in rows.items()})
                    rows = {c: x[stop:] for c, x in rows.items()}
                    key, kept = rows["key"], None
                if not len(key):
                    continue
                dealing = None
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from solved({c: x[:cut] for c, x in rows.items()})
            kept = {c: x[cut:] for c, x in rows.items()}
            if len(key) - cut > BUCKET:
                yield dealt(kept)
                dealing, kept = key[-1], None
        if kept is not None:
            yield from solved(kept)

    return run, ", ".join(f"{c} long" for c in fields)


def links(rows: DataFrame, radius: int, words: int, finer) -> DataFrame:
    """Links (a, b) among rows (key, fixed, node, route, f0, ...) that share a key and lie within
    the radius, as spanning links per bucket; rows of large buckets go on under finer keys."""
    run, schema = _meet(radius, words, finer)
    found = []
    while True:
        met = staged(rows.repartition(parts_for(rows), "key").sortWithinPartitions("key").mapInArrow(run, schema), "buckets")
        found.append(met.filter("open = 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
        rows = met.filter("open = 1").select(*rows.columns)
        if rows.isEmpty():
            return reduce(DataFrame.union, found)


def _finer_exact(parts: int):
    """Keys on thirds of the bits that a bucket does not share yet: at most two differ, so one agrees."""

    def run(rows: dict) -> dict:
        out = []
        fixed = rows["fixed"].view(np.uint64)
        for value in np.unique(fixed):
            mine = fixed == value
            rest = [b for b in range(64) if not int(value) >> b & 1]
            for k, bits in enumerate(np.array_split(rest, parts)):
                m = np.uint64(sum(1 << int(b) for b in bits))
                part = {c: x[mine] for c, x in rows.items()}
                shared = part["route"].view(np.uint64) & m
                part["key"] = mix(part["key"].view(np.uint64) ^ mix(shared + np.uint64(k))).view(np.int64)
                part["fixed"] = np.full(len(shared), value | m, np.uint64).view(np.int64)
                out.append(part)
        return {c: np.concatenate([x[c] for x in out]) for c in rows}

    return run


def _pairs_of_blocks() -> Column:
    """The six keys of two 16-bit blocks each, with the bits that they fix."""
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        fixed = (0xFFFF << 16 * i) | (0xFFFF << 16 * j)
        fixed -= (1 << 64) if fixed >> 63 else 0
        keys.append(F.struct((F.lit(n << 32) + F.shiftleft(block[i], 16) + block[j]).alias("key"), F.lit(fixed).cast("long").alias("fixed")))
    return F.explode(F.array(*keys))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Spanning links (a, b) among the distinct fingerprints ``fp`` that differ in two bits or fewer.

    Two of four blocks of 16 bits agree in any such pair, so every pair meets in a bucket.
    """
    keyed = fps.select("fp").distinct().select("fp", _pairs_of_blocks().alias("k"))
    rows = keyed.select("k.key", "k.fixed", F.col("fp").alias("node"), F.col("fp").alias("route"), F.col("fp").alias("f0"))
    return links(rows, 2, 1, _finer_exact(3))


def _labelled(fps: DataFrame, node: str, members: DataFrame) -> DataFrame:
    """``members`` (node, least id) with the least id of each node's component."""
    root = F.coalesce(F.col("root"), F.col(node))
    joined = members.join(fps.withColumnRenamed("node", node), node, "left").select(node, "least", root.alias("root"))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.select(node, "root").join(best, "root").select(node, "component_id")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most two differing bits; a null
    or empty text has fingerprint zero and links like any other.  Copies share a fingerprint and
    are one node; a row without an id keeps its component's smallest id.
    """
    fps = staged(fingerprints(docs), "fingerprints")
    roots = components(fingerprint_links(fps))
    by_fp = _labelled(roots, "fp", fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


# ------------------------------------------------------------------ near copies at a similarity
#: Near copies: sets of 5-word shingles with a Jaccard similarity of ALIKE or more.
SHINGLE, ALIKE = 5, 0.8
#: Candidates: at 0.8 the angle between shingle sets is about 27 degrees, 39 of 256 bits with a
#: deviation of 6; the radius is three of these beyond.
SKETCH_WORDS = 4
RADIUS = 58
#: Keys sample this many bits of a 2-word fingerprint, in which near copies differ in 4 to 11 of 64.
ROUTE = 2
TABLES, KEY_BITS = 48, 14
#: Members and bytes of shingle hashes of a block; two blocks are compared in one task.
BLOCK_MEMBERS, BLOCK_BYTES = 512, 4 << 20
#: Shingles counted in one product of zeros and ones.
COLUMNS = 4096


def _samples(seed: int, tables: int, bits: int) -> list[int]:
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]


def _spanning(words: int, radius: int):
    """Rows sorted by key to spanning links (a, b) of each bucket: at most one a member."""
    names = ["key", "node", *(f"f{k}" for k in range(words))]

    def solved(parts: list[dict]) -> pa.RecordBatch:
        rows = {c: np.concatenate([x[c] for x in parts]) for c in names}
        head = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
        size = np.diff(np.append(head, len(rows["key"])))
        fit = np.repeat(size > 1, size)
        node = rows["node"][fit]
        label = np.arange(0) if not len(node) else bucket_links(size[size > 1], [rows[f"f{k}"][fit].view(np.uint64) for k in range(words)], radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []  # rows of the last key
        for part in batches:
            rows = {c: part.column(c).to_numpy(zero_copy_only=False) for c in names}
            if not len(rows["key"]):
                continue
            cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
            if cut or kept and kept[-1]["key"][-1] != rows["key"][0]:
                yield solved([*kept, {c: x[:cut] for c, x in rows.items()}])
                kept = []
            kept.append({c: x[cut:] for c, x in rows.items()})
        if kept:
            yield solved(kept)

    return run, "a long, b long"


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, root, own, blocks, shingles) of texts (node, root, own, blocks, text): the sorted hashes of the
    distinct shingles, once for a node's rows in a task."""
    names = ["node", "root", "own", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text", TEXT_BYTES):
            node = part.column("node").to_pylist()
            new = [k for k, x in enumerate(node) if x not in seen and not seen.add(x)]
            if len(new) < len(node):
                part = part.take(pa.array(new, pa.int64()))
            hashes, bounds = _distinct(*_shingle_hashes(part.column("text"), SHINGLE))
            raw = hashes.tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), sets], names=[*names, "shingles"])

    return texts.select(*names, "text").mapInArrow(run, "node long, root long, own int, blocks int, shingles binary")


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = often[column] > 1  # what one set alone holds is shared by none
    row, column = row[twice], column[twice]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.cumsum(np.append(0, np.diff(column[order]) != 0))[: len(order)]
    out = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        held = np.zeros((n, COLUMNS), np.float32)
        held[row[a:b], column[a:b] - lo] = 1
        out += held @ held.T
    return out


def _alike(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the links of one or two blocks: sets whose Jaccard similarity is ALIKE or more."""
    node, first = np.unique(t.column("node").to_numpy(), return_index=True)
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles").take(pa.array(first))]
    size = np.array([len(x) for x in sets])
    both = shared_shingles(sets)
    i, j = np.nonzero(np.triu(both >= ALIKE * (size[:, None] + size[None, :] - both) - 1e-6, 1))
    root = np.arange(len(node))
    while len(i):
        x, y = root[i], root[j]
        apart = x != y
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        root = _settle(root)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": node[linked], "b": node[root[linked]]})


def _near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, root) for every row of docs (doc_id, text_hash, text), where rows of
    one id and hash hold one text.

    Candidates share sampled bits of a 2-word SimHash and differ in at most RADIUS of 256 bits of the
    5-word SimHash.  Their components are loose groups: each is dealt out in blocks, every two blocks of it
    meet in a task, and all pairs of these are decided by their shingle sets, alike to 0.8 or not.  No pair
    leaves a task: buckets and blocks give spanning links.  Equal sets are one node.
    """
    bits = [f"f{k}" for k in range(SKETCH_WORDS)]
    node = F.xxhash64("same", "route", *bits).alias("node")
    sketch = staged(sketches(docs, ROUTE, SHINGLE, SKETCH_WORDS).select("doc_id", "text_hash", node, "route", *bits, "size"), "sketches")
    nodes = sketch.groupBy("node", "route", *bits, "size").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    nodes = staged(nodes.select("node", "route", *bits, "size", "best.*"), "nodes")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(signed(m)).cast("long").alias("m")) for k, m in enumerate(_samples(7, TABLES, KEY_BITS))))
    keyed = nodes.select("node", "route", *bits, F.explode(masks).alias("t"))
    rows = keyed.select(F.xxhash64("t.k", F.col("route").bitwiseAND(F.col("t.m"))).alias("key"), "node", *bits)
    run, schema = _spanning(SKETCH_WORDS, RADIUS)
    loose = components(rows.repartition(parts_for(rows), "key").sortWithinPartitions("key").mapInArrow(run, schema))

    members = staged(nodes.join(loose, "node").select("node", "root", "size", "doc_id", "text_hash"), "members")
    weight = F.greatest(F.sum("size") * 8 / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK_MEMBERS)
    groups = members.groupBy("root").agg(F.ceil(weight).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int")
    placed = members.join(groups, "root").select("node", "root", own.alias("own"), "blocks", "doc_id", "text_hash")
    # The texts move once, at any size, and their sets once to each tile that they are compared in.
    texts = docs.select("doc_id", "text_hash", "text").join(placed.hint("shuffle_hash"), ["doc_id", "text_hash"])
    dealt = _shingle_sets(texts).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.struct("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).alias("tile")
    met = dealt.select("node", tile, "shingles").repartition(parts_for(rows), "tile").groupBy("tile").applyInArrow(_alike, "a long, b long")
    roots = staged(components(met), "roots")
    return sketch.join(roots, "node", "left").select("doc_id", "text_hash", "node", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): groups of documents, linked where their 5-word shingles are alike to 0.8 or more."""
    own = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = _near_rows(own)
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest doc_id.

    Rows that share an id count by their texts; of those in one group the smallest hash of the whole
    row stays, so the choice is the same in every run.  Rows without a doc_id stay.
    """
    own = docs.filter(F.col("doc_id").isNotNull()).withColumn("_row", F.xxhash64(*docs.columns))
    rows = _near_rows(own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row").alias("text_hash"), "text"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("best")).select("best.doc_id", F.col("best.text_hash").alias("_row"))
    own = own.join(first.hint("shuffle_hash"), ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"])
    return own.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
