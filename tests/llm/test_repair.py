import hashlib
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import repair
from panelweave.llm.queries import QUERIES

from .brute import WORD

SF = "/root/testdata/sf0.001"


def brute(words):
    """All maximal runs (start, length, period) by comparing every word with every period on."""
    n, out = len(words), []
    x = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2], edge[1::2]):
            length = int(e - s) + q
            if length >= max(6, 4 * q) and not any(q % p == 0 and (x[s : s + length - p] == x[s + p : s + length]).all() for p in range(1, q)):
                out.append((int(s), length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == {d: expected(d, t) for d, t in docs} and sum(r[0] for r in got.values()) > 10


def of(texts):
    """Runs per text by the operator's core, all texts in one chunk."""
    ids = np.array([w for t in texts for w in t], np.int64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = [[] for _ in texts]
    for s, e, q in zip(*repair.runs(ids, first)):
        d = int(np.searchsorted(first, s, "right")) - 1
        out[d].append((int(s - first[d]), int(e - s), int(q)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5))
def test_few_words(texts):
    assert of(texts) == [brute(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=6), st.integers(1, 4))
def test_nested_repeats(blocks, times):
    text = [w for unit, n, cut in blocks for w in (unit * n)[: len(unit) * n - cut]] * times
    assert of([text, text[1:], text[::-1]]) == [brute(text), brute(text[1:]), brute(text[::-1])]


def test_fibonacci_words_and_powers():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    texts = [b, [1] * 300, [0, 1] * 100 + [0], ([0] * 6 + [1]) * 9, [], [5] * 5, [5] * 6]
    assert of(texts) == [brute(t) for t in texts]


def test_every_rule_is_a_repair_rule():
    rng = np.random.default_rng(1)
    ids, text = rng.integers(0, 4, 3000), np.repeat([0, 1, 2], 1000)
    covered = 0
    for start, cut, end, rule, place in repair.rules(ids, text):
        assert ((start < cut) & (cut < end)).all() and len(start) == rule.max() + 1
        length = (end - start)[rule]
        assert all((ids[p : p + n] == ids[s : s + n]).all() and text[p] == text[p + n - 1] for p, n, s in zip(place, length, start[rule]))
        covered = max(covered, int(length.max()))
    assert covered == 1000  # each text ends as one symbol


def test_rows_and_edges(spark, make, edge, monkeypatch):
    rows = [*edge, (20, "a b " * 9 + "x"), (20, "a b " * 9), (21, "é ß é ß é ß é ß"), (22, "c " * 40_000 + "d"), (23, "\n".join(["to be", "or not"] * 7))]
    got = repair.periodic_runs(make(rows, clashes=True)).collect()
    assert len(got) == len(rows)
    want = []
    for d, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = brute(words) if len(words) < 5000 else [(0, 40_000, 1)] if d == 22 else None
        if runs is None:  # the long text of the fixture
            continue
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((-1 if d is None else d, len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    have = [(-1 if r.doc_id is None else r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in got if r.doc_id != 9]
    assert sorted(have) == sorted(want)
    long = next(r for r in got if r.doc_id == 9)
    assert long.n_words == 60_000 and long.runs == []
    assert repair.periodic_runs(make(rows).limit(0)).count() == 0


def test_texts_longer_than_a_chunk(spark, make, monkeypatch):
    text = " ".join(f"w{i}" for i in range(400_000)) + " z y x" * 50
    assert len(text) > repair.CHUNK
    (row,) = repair.periodic_runs(make([(1, text)])).collect()
    assert [tuple(r) for r in row.runs] == [(400_000, 150, 3)] and row.collapsed == text.encode()[: text.index(" z y x") + 6]
