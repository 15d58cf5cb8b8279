"""Substring deduplication of words with a compressed FM-index per shard.

Of the contexts that share an anchor, earlier ones are indexed and later ones streamed.  The index
is the Burrows-Wheeler transform of the indexed contexts in a wavelet matrix: one packed bit row
per symbol bit, with counts every 64 bits.  A streamed context goes through backward search word
by word from the right.  Each word gets its matching statistic: the longest match, up to a window,
that starts there and stands in the index.  A match that cannot grow is cut at its end, to the
parent interval, until it can.  Where the statistic reaches a window, the window goes if the
earliest place of its interval is before its own.

One index would have to hold all that is earlier than a context.  A round per bit of the places in
a group does: places whose bit is 0 are indexed, those whose bit is 1 streamed.  Any two places
differ first in one bit, in which the earlier has 0, so each pair meets in a round; most groups
hold two contexts, which is one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import prefix_hash, span_hash, word_spans
from .passages import Passages, Shard, remove_repeats

WINDOW_WORDS = 20
#: Words of an anchor: fewer make fewer anchors, more make them rarer by chance.
GRAM_WORDS = 6


class WaveletMatrix:
    """Rank over an integer sequence, in a bit row for each bit of a symbol."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.rows = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            packed = np.zeros(-(-(len(values) + 1) // 64) * 8, np.uint8)
            row = np.packbits(bit, bitorder="little")
            packed[: len(row)] = row
            words = packed.view(np.uint64)
            counts = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
            self.rows.append((words, counts, len(values) - int(counts[-1])))
            values = np.concatenate([values[~bit], values[bit]])
        first = np.arange(1 << bits)
        self.first = self._walk(first, np.zeros(len(first), np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, (words, counts, zeros) in enumerate(self.rows):
            block = at >> 6
            below = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(below)
            at = np.where(symbol >> (self.bits - 1 - i) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, at) - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first ``depth`` symbols, by prefix doubling; the ranks of each round."""
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    span = 1
    while span < depth:
        rank = ranks[-1]
        second = np.zeros(len(rank), np.int64)
        second[: len(rank) - span] = rank[span:] + 1
        ranks.append(np.unique(rank * (int(rank.max()) + 2) + second, return_inverse=True)[1].astype(np.int64))
        span *= 2
    return np.argsort(ranks[-1], kind="stable"), ranks


class Index:
    """Backward search in end-marked word sequences, and its intervals down to ``depth`` words.

    ``words`` holds the sequences end to end, as numbers below ``alphabet``.  Interval [lo, hi) of
    ``order`` holds the suffixes that start with one match.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, alphabet: int, depth: int):
        n, self.depth = len(sizes), depth
        # Each sequence ends in a mark of its own, smaller than any word.
        text = np.empty(len(words) + n, np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(n), sizes)] = words + n
        text[np.cumsum(sizes) + np.arange(n)] = np.arange(n)
        self.order, ranks = suffix_order(text, depth + 1)
        symbol = np.where(text < n, 0, text - n + 1)
        bits = int(alphabet).bit_length()
        self.bwt = WaveletMatrix(symbol[self.order - 1], bits)
        self.smaller = np.append(0, np.cumsum(np.bincount(symbol, minlength=1 << bits)))
        # Words that neighbours in suffix order share; -1 on both outer sides.
        one, other = self.order[:-1], self.order[1:]
        shared = np.zeros(len(one), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            shared += (ranks[k][one + shared] == ranks[k][other + shared]).astype(np.int64) << k
        self.lcp = np.concatenate([[-1], np.minimum(shared, depth), [-1]])
        # Where the interval around an edge begins and ends once the edge falls.
        self.below, self.above = np.zeros(len(self.lcp), np.int64), np.full(len(self.lcp), len(text), np.int64)
        for d in range(depth + 1):
            at, less = np.flatnonzero(self.lcp == d), np.flatnonzero(self.lcp < d)
            spot = np.searchsorted(less, at)
            self.below[at], self.above[at] = less[spot - 1], less[spot]

    def grow(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with one word more on the left; empty where the index has no such match."""
        c = word + 1
        return self.smaller[c] + self.bwt.rank(c, lo), self.smaller[c] + self.bwt.rank(c, hi)

    def shrink(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parent intervals, and the words that their matches keep."""
        left, right = self.lcp[lo], self.lcp[hi]
        keep = np.maximum(left, right)
        return keep, np.where(left == keep, self.below[lo], lo), np.where(right == keep, self.above[hi], hi)

    def statistics(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of the streamed sequences: the words of the longest match that starts
        there, at most ``depth``, and where its interval begins.  All sequences go at once."""
        n, total = len(sizes), len(self.order)
        length, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ends = np.cumsum(sizes)
        lo, hi, have = np.zeros(n, np.int64), np.full(n, total, np.int64), np.zeros(n, np.int64)
        live = np.argsort(-sizes, kind="stable")  # the longest sequences stay longest
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = live[: int(np.searchsorted(-sizes[live], -step, "right"))]
            here = ends[live] - step
            known = self.smaller[words[here] + 2] > self.smaller[words[here] + 1]
            new = live[~known]
            lo[new], hi[new], have[new] = 0, total, 0
            todo = live[known]
            while len(todo):
                below, above = self.grow(words[ends[todo] - step], lo[todo], hi[todo])
                found = above > below
                lo[todo[found]], hi[todo[found]] = below[found], above[found]
                have[todo[found]] += 1
                todo = todo[~found]
                have[todo], lo[todo], hi[todo] = self.shrink(lo[todo], hi[todo])
            long = live[have[live] > self.depth]
            keep, below, above = self.shrink(lo[long], hi[long])
            wide = keep == self.depth
            lo[long[wide]], hi[long[wide]], have[long] = below[wide], above[wide], self.depth
            length[here], begin[here] = have[live], lo[live]
        return length, begin


def _take(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the words of some contexts, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(first - (ends - sizes), sizes)


def earlier_matches(shard: Shard, p: Passages) -> np.ndarray:
    w, n = p.window, len(shard.owned)
    starts, ends, first = word_spans(shard.data, shard.offsets)
    alphabet, word = np.unique(span_hash(prefix_hash(shard.data), starts, ends), return_inverse=True)
    sizes, first = np.diff(first), first[:-1]
    _, doc = np.unique(shard.doc, return_inverse=True)
    # Places in order; equal places (texts that share an id) are one.
    begin = shard.start if p.within else np.zeros(n, np.int64)
    order = np.lexsort((begin, doc, shard.group))
    fresh = np.append(True, np.diff(shard.group[order]) != 0)
    moved = fresh | np.append(True, (np.diff(doc[order]) != 0) | (np.diff(begin[order]) != 0))
    count, heads = np.cumsum(moved), np.flatnonzero(fresh)
    members = np.diff(np.append(heads, n))
    place, most = np.empty(n, np.int64), np.empty(n, np.int64)
    place[order] = count - np.repeat(count[heads], members)
    most[order] = np.repeat(np.maximum.reduceat(place[order], heads), members)

    of = np.repeat(np.arange(n), sizes)
    inside = np.arange(len(word)) - first[of] + begin[of] if p.within else np.zeros(len(word), np.int64)
    key = doc[of].astype(np.int64) * (int(inside.max(initial=0)) + 1) + inside
    gone = np.zeros(len(word), bool)
    for bit in range(int(most.max(initial=0)).bit_length()):
        side = place >> bit & 1
        meets = most >= 1 << bit
        held, sent = np.flatnonzero(meets & (side == 0)), np.flatnonzero(meets & (side == 1))
        at, spot = _take(first[held], sizes[held]), _take(first[sent], sizes[sent])
        index = Index(word[at], sizes[held], len(alphabet), w)
        # End marks stand behind each sequence; no match of a window starts at one.
        keys = np.full(len(index.order), np.iinfo(np.int64).max)
        keys[np.arange(len(at)) + np.repeat(np.arange(len(held)), sizes[held])] = key[at]
        edge = index.lcp[:-1] < w
        earliest = np.minimum.reduceat(keys[index.order], np.flatnonzero(edge))
        run = np.cumsum(edge) - 1
        length, begins = index.statistics(word[spot], sizes[sent])
        whole = length >= w
        gone[spot[whole]] |= earliest[run[begins[whole]]] < key[spot[whole]]
    return gone[_take(first, shard.owned)]


WORDS = Passages(WINDOW_WORDS, GRAM_WORDS, GRAM_WORDS, words=True, within=True, match=earlier_matches)


def dedup_words(docs: DataFrame, p: Passages = WORDS) -> DataFrame:
    """``docs`` with the words of repeated windows taken out; see ``remove_repeats``.

    ``kept`` holds the other words joined by one blank.  Rows that share a doc_id are one document
    told by place: equal places do not remove each other.
    """
    return remove_repeats(docs, p)
