"""Suffix-array deduplication of bytes by longest-previous-factor arrays.

Within a shard of contexts that share anchors, the suffixes that start windows are sorted, with
the bytes that neighbours in this order share, up to a window.  The nearest suffixes from smaller
documents on either side (previous and next smaller position) hold the longest earlier matches:
the least shared length on the way to each, and the greater of the two is the position's longest
previous factor.  A window goes where that reaches the window's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .passages import Passages, Shard, remove_repeats

WINDOW_BYTES = 50
#: Bytes of an anchor, and of the grams that place it: longer anchors meet less often by chance.
GRAM_BYTES, PICK_BYTES = 28, 6


def _words8(data: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number."""
    padded = np.append(data, np.zeros(depth + 8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(data) + depth, np.uint64)
    for i in range(8):
        out |= padded[i : i + len(out)] << np.uint64(56 - 8 * i)
    return out


def shared_prefixes(keys: list[np.ndarray], steps: list[int], window: int) -> np.ndarray:
    """Bytes, up to a window, that each entry shares with the one before it; 0 for the first.
    ``keys`` holds, in suffix order, the eight bytes from each step on."""
    n = len(keys[0])
    out = np.full(n, window, np.int64)
    out[:1] = 0
    open_ = np.arange(1, n)
    for key, step in zip(keys, steps):
        apart = key[open_] ^ key[open_ - 1]
        hit = apart != 0
        # Leading zero bytes of the difference.
        same = sum((apart[hit] >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        out[open_[hit]] = step + same
        open_ = open_[~hit]
    return out


def previous_match(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Bytes shared with the nearest entry before that has a smaller place; 0 if none has.

    Every entry points to its neighbour and jumps on over entries that are not smaller, all at
    once, with the least shared length on its way; one that shares nothing any more stops.
    """
    at, low = np.arange(len(place)) - 1, shared.copy()
    live = np.flatnonzero((at >= 0) & (low > 0))
    low[:1] = 0
    while len(live):
        far = at[live]
        behind = place[far] >= place[live]
        live, far = live[behind], far[behind]
        at[live], low[live] = at[far], np.minimum(low[live], low[far])
        low[live[at[live] < 0]] = 0
        live = live[low[live] > 0]
    return low


def longest_previous_factors(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """In suffix order, the longest match of each entry with any entry of a smaller place."""
    back = previous_match(place, shared)
    ahead = previous_match(place[::-1], np.append(0, shared[:0:-1]))[::-1]
    return np.maximum(back, ahead)


def earlier_matches(shard: Shard, p: Passages) -> np.ndarray:
    of = np.repeat(np.arange(len(shard.owned)), shard.owned)
    at = np.arange(len(of)) - np.repeat(np.cumsum(shard.owned) - shard.owned, shard.owned)
    begin = shard.offsets[of] + at
    words = _words8(shard.data, p.window)
    steps = [*range(0, p.window - 7, 8)] + ([p.window - 8] if p.window % 8 else [])
    keys = [words[begin + step] for step in steps]
    order = np.lexsort(keys[::-1])
    shared = shared_prefixes([key[order] for key in keys], steps, p.window)
    _, place = np.unique(shard.doc, return_inverse=True)
    place = place[of].astype(np.int64)
    if p.within:
        start = shard.start[of] + at
        place = place * (int(start.max(initial=0)) + 1) + start
    out = np.zeros(len(order), bool)
    out[order] = longest_previous_factors(place[order], shared) >= p.window
    return out


BYTES = Passages(WINDOW_BYTES, GRAM_BYTES, PICK_BYTES, words=False, within=False, match=earlier_matches)


def dedup_bytes(docs: DataFrame, p: Passages = BYTES) -> DataFrame:
    """``docs`` with the bytes that repeat an earlier document's taken out; see ``remove_repeats``.

    Rows that share a doc_id are one document and do not remove each other's bytes.
    """
    return remove_repeats(docs, p)
