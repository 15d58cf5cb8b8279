"""Periodic runs of words by grammar compression.

The word ids of a chunk of texts are compressed by Re-Pair, a round at a time: the pairs of symbols
within a factor of two of the most frequent one become nonterminals, in order of their frequency, and
pairs are counted anew, until none repeats within the texts.  What is left of a text is joined by a balanced tree of rules that occur
once.  A run that lies in a text crosses the boundary of the two halves of exactly one lowest rule that
contains it, so the runs across each rule's boundary are computed once, in the rule's first
expansion, and moved to all positions that the rule derives.  Intervals of one period that lie in
others are dropped; what remains are the maximal runs.

A run across a boundary that holds at least four periods has two of them on one side of it, so the
periods to try are those with a square right before or right behind the boundary; hashes of spans find
them and how far they reach, and every run is compared word by word in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, prefix_hash, slices, span_hash, utf8, word_spans

#: A run has at least so many words, and so many periods (four at least: see above).
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Text bytes that are compressed together, and candidate periods tried at a time.
CHUNK, TRIED = 2 << 20, 1 << 20


class Hashes:
    """Equality of spans of a sequence in constant time, and how far two spans agree."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.prefix = ids, prefix_hash(ids)

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, a, a + length) == span_hash(self.prefix, b, b + length)

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that agree from a and b on, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle) & open_
            low = np.where(same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that agree before a and b, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle) & open_
            low = np.where(same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low


def crossing(h: Hashes, start: np.ndarray, cut: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rule, from, to, period) of the runs within [start, end) that cross ``cut``, rule by rule."""
    found = []
    most = np.where(end - start >= LEAST_WORDS, (end - start) // LEAST_PERIODS, 0)
    # On either side at least two periods are needed.
    for side, room in ((0, end - cut), (1, cut - start)):
        tries = np.minimum(most, room // 2)
        bounds = np.concatenate([[0], np.cumsum(tries)])
        for lo in range(0, int(bounds[-1]), TRIED):
            flat = np.arange(lo, min(lo + TRIED, int(bounds[-1])))
            rule = np.searchsorted(bounds, flat, "right") - 1
            q = flat - bounds[rule] + 1
            at = cut[rule]
            hit = h.ids[at] == h.ids[at + q] if side == 0 else h.ids[at - 1] == h.ids[at - 1 - q]
            rule, q = rule[hit], q[hit]
            at = cut[rule]
            square = h.equal(at, at + q, q) if side == 0 else h.equal(at - q, at - 2 * q, q)
            rule, q = rule[square], q[square]
            if not len(rule):
                continue
            # The least period of a rule reaches so far; its multiples within that reach are not least.
            head = np.flatnonzero(np.concatenate([[True], rule[1:] != rule[:-1]]))
            least, at, most_of = q[head], cut[rule[head]], room[rule[head]]
            reach = h.forward(at, at + least, most_of - least) if side == 0 else h.backward(at, at - least, most_of - least)
            of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(rule))))
            idle = (q > least[of]) & (q % least[of] == 0) & (2 * q <= (reach + least)[of])
            rule, q = rule[~idle], q[~idle]
            # How far the words agree with those a period on, from the square to either side.
            at, lo_, hi = cut[rule], start[rule], end[rule]
            one, two = (at, at + q) if side == 0 else (at - q, at)
            first = one - h.backward(one, two, one - lo_)
            last = two + h.forward(one, two, hi - two)
            good = (first < at) & (at < last) & (last - first >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
            found.append(np.stack([rule[good], first[good], last[good], q[good]], axis=1))
    both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    return both[:, 0], both[:, 1], both[:, 2], both[:, 3]


def _pairs(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the neighbouring pairs within a text (-1 across texts), how often each occurs, and its name."""
    inside = text[1:] == text[:-1]
    code = np.full(len(symbols) - 1, -1, np.int64)
    code[inside], names = pd.factorize((symbols[:-1][inside] << 32) | symbols[1:][inside])
    return code, np.bincount(code[inside], minlength=len(names)), names


def _chosen(code: np.ndarray, often: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Places to replace, none overlapping: pairs at least half as frequent as the most frequent one, in
    order of frequency, each wherever no pair before it has taken a symbol."""
    frequent = np.flatnonzero(often >= max(2, int(often.max()) // 2))
    # Equally frequent pairs in an order of no pattern, or a copied passage would be taken pair by pair.
    place = np.zeros(len(often) + 1, np.int64)  # the last stands for the code -1
    place[frequent[np.lexsort((mix(names[frequent].astype(np.uint64)), often[frequent]))]] = np.arange(1, len(frequent) + 1)
    rank = np.zeros(len(code) + 2, np.int64)
    rank[1:-1] = place[code]
    live, taken = np.flatnonzero(rank), []
    while len(live):
        best = live[(rank[live] >= rank[live - 1]) & (rank[live] >= rank[live + 1])]
        # Equal neighbours (aaa) overlap: every second one of such a stretch, from its left.
        nth = np.arange(len(best))
        head = np.concatenate([[True], best[1:] != best[:-1] + 1])
        best = best[(nth - nth[head][np.cumsum(head) - 1]) % 2 == 0]
        taken.append(best)
        rank[best] = rank[best - 1] = rank[best + 1] = 0
        live = live[rank[live] > 0]
    return np.sort(np.concatenate(taken)) - 1 if taken else np.zeros(0, np.int64)


def _balanced(pos: np.ndarray, size: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, cut, end) of the rules that join each text's symbols two by two until one is left."""
    while len(pos):
        first = np.concatenate([[True], text[1:] != text[:-1]])
        place = np.arange(len(pos)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        left = np.flatnonzero((place[:-1] % 2 == 0) & ~first[1:]) if len(pos) > 1 else np.zeros(0, np.int64)
        if not len(left):
            return
        yield pos[left], pos[left + 1], pos[left + 1] + size[left + 1]
        size = size.copy()
        size[left] += size[left + 1]
        stay = place % 2 == 0
        pos, size, text = pos[stay], size[stay], text[stay]


def rules(ids: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Re-Pair of the sequence ``ids``, texts apart: per round (start, cut, end) of each new rule's first
    expansion, and (rule, position) of all places that it derives; then the balanced rules."""
    symbols = ids.astype(np.int64)
    pos, size, text = np.arange(len(ids)), np.ones(len(ids), np.int64), text.copy()
    names = int(symbols.max()) + 1 if len(symbols) else 0
    while len(symbols) > 1:
        code, often, pairs = _pairs(symbols, text)
        at = _chosen(code, often, pairs) if len(often) else np.zeros(0, np.int64)
        if not len(at):
            break
        rule, _ = pd.factorize(code[at])
        head = np.full(int(rule.max()) + 1, -1, np.int64)
        head[rule[::-1]] = at[::-1]  # the first place of each
        yield pos[head], pos[head + 1], pos[head + 1] + size[head + 1], rule, pos[at]
        symbols = symbols.copy()
        symbols[at], size[at] = names + rule, size[at] + size[at + 1]
        names += len(head)
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, pos, size, text = symbols[stay], pos[stay], size[stay], text[stay]
    for start, cut, end in _balanced(pos, size, text):
        yield start, cut, end, np.arange(len(start)), start


def runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of the texts that begin at ``first`` (n + 1 bounds), by start, then period."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h, starts, ends, periods = Hashes(ids.astype(np.uint64)), [], [], []
    for begin, cut, end, rule, place in rules(ids, text):
        of, lo, hi, q = crossing(h, begin, cut, end)
        if not len(of):
            continue
        # To all places of the rule: places in order of rule, then every run times its rule's places.
        order = np.argsort(rule, kind="stable")
        count = np.bincount(rule, minlength=len(begin))
        base = np.cumsum(count) - count
        times = count[of]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        to = place[order][np.repeat(base[of], times) + nth]
        shift = to - np.repeat(begin[of], times)
        starts.append(np.repeat(lo, times) + shift)
        ends.append(np.repeat(hi, times) + shift)
        periods.append(np.repeat(q, times))
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return maximal(ids, np.concatenate(starts), np.concatenate(ends), np.concatenate(periods))


def maximal(ids: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals that lie in no other of their period and have no smaller one, compared word by word."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    # Furthest end so far within the period.
    wide = len(ids) + 1
    far = np.maximum.accumulate(end + period * wide) - period * wide
    keep = np.ones(len(start), bool)
    keep[1:] = (period[1:] != period[:-1]) | (end[1:] > far[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    good = np.ones(len(start), bool)
    open_: list[int] = []  # runs that reach beyond the place at hand
    for k in range(len(start)):
        s, e, q = int(start[k]), int(end[k]), int(period[k])
        open_ = [o for o in open_ if end[o] > s]
        same_start = []
        j = k + 1
        while j < len(start) and start[j] == s:
            same_start.append(j)
            j += 1
        covered = any(period[o] < q and q % period[o] == 0 and end[o] >= e for o in [*open_, *same_start])
        good[k] = not covered and bool((ids[s : e - q] == ids[s + q : e]).all())
        open_.append(k)
    return start[good], end[good], period[good]


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Small ids of the words, equal for equal words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return pd.factorize(span_hash(prefix_hash(data), starts, ends))[0].astype(np.int64)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, a blank after each, and the n + 1 bounds of the words in it."""
    size = ends - starts + 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)
    out = np.append(data, np.uint8(0))[np.minimum(at, len(data))]
    out[bounds[1:] - 1] = 0x20
    return out, bounds


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run (start, length, period) of the greatest length / period, exactly; then start, then period."""
    best = found[0]
    for run in found[1:]:
        ours, theirs = run[1] * best[2], best[1] * run[2]
        if ours > theirs or ours == theirs and (run[0], run[2]) < (best[0], best[2]):
            best = run
    return best


RUN = "struct<start:long,length:long,period:long>"
FIELDS = ["n_words", "runs", "best", "collapsed"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in slices(batches, "text", CHUNK):
        data, offsets = utf8(batch.column("text"))
        starts, ends, first = word_spans(data, offsets)
        ids = word_ids(data, starts, ends)
        lo, hi, q = runs(ids, first)
        gone = np.zeros(len(ids) + 1, np.int64)
        np.add.at(gone, lo + q, 1)
        np.add.at(gone, hi, -1)
        stay = np.cumsum(gone[:-1]) == 0
        kept, bounds = joined(data, starts[stay], ends[stay])
        cut = np.concatenate([[0], np.cumsum(stay)])[first]
        doc = np.searchsorted(first, lo, "right") - 1
        per = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        found, best, rest = [], [], []
        for d in range(batch.num_rows):
            a, b = per[d], per[d + 1]
            mine = [(int(s - first[d]), int(e - s), int(p)) for s, e, p in zip(lo[a:b], hi[a:b], q[a:b])]
            found.append([dict(zip(("start", "length", "period"), r)) for r in mine])
            best.append(dict(zip(("start", "length", "period"), _best(mine))) if mine else None)
            rest.append(kept[bounds[cut[d]] : max(bounds[cut[d]], bounds[cut[d + 1]] - 1)].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(first)), pa.array(found, pa.list_(run_type)), pa.array(best, run_type), pa.array(rest, pa.binary())],
            names=["doc_id", *FIELDS],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) of every row of ``docs`` (doc_id, text).

    A run is a maximal stretch of words whose smallest period q fits in it four times or more, of six
    words at least; ``runs`` has (start, length, period) by start, then period, ``best`` the one of the
    greatest length / period (null without runs).  ``collapsed`` has the words, joined by one blank, less
    those that a run holds past its first period.

    A null or empty text has no words, no runs and an empty ``collapsed``.  Rows are independent: those
    that share an id or have none are treated each.  Texts of any length are taken whole, one that exceeds
    CHUNK on its own.  Other columns are not read.  Nothing is shuffled.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, best {RUN}, collapsed binary"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)

