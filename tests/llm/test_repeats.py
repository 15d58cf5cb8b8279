import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from panelweave.llm import fmindex, lpf, passages
from panelweave.llm.lpf import BYTES

from .brute import removed_bytes, removed_words


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    shared = [" ".join(rng.choice(vocab) for _ in range(rng.randint(8, 90))) for _ in range(6)]
    rows = []
    for d in range(docs):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 4))]
        parts += rng.sample(shared, rng.randint(0, 3)) * rng.choice([1, 1, 2])
        rng.shuffle(parts)
        rows.append((d * 3 % 101, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, rows[1][1][:-1]), (203, None), (204, "")]
    return rows


def by_id(df):
    return {r.doc_id: (r.n_symbols, r.n_removed, len(r.runs), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(make, seed):
    rows = corpus(seed)
    assert by_id(lpf.dedup_bytes(make(rows))) == removed_bytes(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_words_match_brute_force(make, seed):
    rows = corpus(seed)
    got = {d: (n, r, k) for d, (n, r, _, k) in by_id(fmindex.dedup_words(make(rows))).items()}
    assert got == removed_words(rows)


def test_an_anchor_too_large_for_a_shard_is_dealt_out(make, monkeypatch):
    rows = corpus(5)
    p = passages.Passages(50, 8, 8, words=False, within=False, match=lpf.earlier_matches)
    monkeypatch.setattr(passages, "SHARD_BYTES", 100)
    monkeypatch.setattr(passages, "GROUP_BYTES", 100)
    docs = make(rows).repartition(3)
    # The limits are read where the tasks run, so the steps run here, on one batch.
    import pyarrow as pa

    runs = passages._meet(p)
    texts = [b"x" * 50, b"x" * 50, b"y" * 30 + b"x" * 60, b"z" * 100]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * 4), pa.array(sorted(texts), pa.binary()), pa.array([1, 2, 3, 4]), pa.array([passages._pack(0, 0, len(t) - 49) for t in sorted(texts)]), pa.array([1] * 4, pa.int8())],
        schema=passages._CONTEXTS,
    )
    out = pa.Table.from_batches(list(runs(iter([batch] * 1)))).to_pylist()
    opened = [r for r in out if r["open"]]
    assert all(len(r["ctx"]) == 50 for r in opened) and any(not r["open"] and r["doc"] == 2 for r in out)
    firsts = sorted(opened, key=lambda r: (r["ctx"], r["doc"], r["at"]))
    back = passages._firsts(p)(iter([pa.RecordBatch.from_pylist([{k: r[k] for k in ("ctx", "doc", "at", "open")} for r in firsts], schema=pa.schema([f for f in passages._CONTEXTS if f.name != "h"]))]))
    found = {(r["doc"], passages._unpack(__import__("numpy").array([r["at"]]))[0][0]) for b in back for r in b.to_pylist()}
    # "z" windows repeat inside one document only, and "x" windows already stand in document 1.
    assert found == {(3, s) for s in range(30, 41)}
    assert docs.count() == len(rows)


def test_edges(make, edge):
    docs = make(edge, clashes=True)
    for run in (lpf.dedup_bytes, fmindex.dedup_words):
        out = run(docs)
        rows = out.collect()
        assert len(rows) == len(edge)
        assert [c for c in out.columns if c not in ("n_symbols", "n_removed", "runs", "kept")] == [c for c in docs.columns if c not in ("runs", "kept")]
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
        assert by[4][0].n_removed == 0 and by[5][0].n_removed == by[5][0].n_symbols == by[13][0].n_removed
        assert by[1][0].n_symbols == by[1][0].n_removed == 0 and bytes(by[1][0].kept) == b""
        assert by[None][0].n_removed == 0  # a row without an id takes no part
        assert [r.n_removed for r in by[7]] == [0, 0]  # one document, told by place
        assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("low, high", [(0, 1), (-5, 300), (-(1 << 63), (1 << 63) - 1)])
def test_packed_hashes_come_back(low, high):
    rng = np.random.default_rng(11)
    h = np.unique(rng.integers(0, 1 << 38, 5000, dtype=np.uint64))
    doc, several = rng.integers(low, high, len(h), dtype=np.int64), rng.random(len(h)) < 0.1
    rows = passages._packed(h, doc, several, h % np.uint64(24), 24, 0)
    assert rows.get_total_buffer_size() < (13 if high > 300 else 6) * len(h) + 4000  # a row of three longs took 24 bytes for each
    back = [np.concatenate(x) for x in zip(*(passages._hashes_of(r, 24, r["bucket"]) for r in rows.to_pylist()))]
    order = np.argsort(back[0])
    assert all((x[order] == y).all() for x, y in zip(back, (h.view(np.int64), doc, several)))


def test_a_step_over_texts_stays_small():
    """A worker's arrays for one step: about a hundred bytes for each byte of text."""
    import tracemalloc

    rng = np.random.default_rng(12)
    texts = pa.array(["".join(rng.choice(list("abcdefgh "), 4000)) for _ in range(1500)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts, pa.array([False] * len(texts))], names=["doc", "text", "copy"])
    tracemalloc.start()
    told = list(passages._report(BYTES, 16)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r.num_rows for r in told) and peak < 200e6
