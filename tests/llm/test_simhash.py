import random
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from panelweave.llm import simhash
from panelweave.llm.components import components

from .brute import WORD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, width=3):
    w = WORD.findall((text or "").translate(LOW))
    s = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=2):
    root = {k: k for k in fps}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in fps}


def near_texts(seed, n=40):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    rows = []
    for d in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 400))]
        rows.append((d, " ".join(w)))
        for c in range(rng.choice([0, 0, 1, 3])):
            x = list(w)
            for _ in range(rng.randint(0, 2)):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append((1000 + d * 10 + c, " ".join(x).upper() if c == 1 else "\n".join(x)))
    return rows + [(5000, None), (5001, ""), (5002, "one"), (5003, "One"), (5004, "one two")]


def test_fingerprints_and_components_match_brute_force(make):
    rows = near_texts(1)
    fps = {d: fingerprint(t) for d, t in rows}
    want = brute_components(fps)
    got = simhash.near_components(make(rows)).collect()
    assert {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in got} == {d: (fps[d], want[d]) for d in fps}
    assert len(set(want.values())) < len(rows)


@pytest.mark.parametrize("words,radius", [(1, 2), (4, 45)])
def test_bucket_links_are_the_components_of_each_bucket(words, radius):
    rng = np.random.default_rng(2)
    size = np.array([1, 2, 3, 200, 70, 64, 65])
    n = int(size.sum())
    centre = rng.integers(0, 1 << 63, (9, words), dtype=np.int64).view(np.uint64)
    fps = centre[rng.integers(0, 9, n)]
    for _ in range(radius // 2 + 1):
        fps[np.arange(n), rng.integers(0, words, n)] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    label = simhash.bucket_links(size, [fps[:, k] for k in range(words)], radius)
    head = 0
    for s in size:
        mine = {i: reduce(lambda a, k: a << 64 | int(fps[i, k]), range(words), 0) for i in range(head, head + s)}
        assert {i: int(label[i]) for i in mine} == brute_components(mine, radius)
        head += s


def test_large_buckets_are_dealt_out_without_losing_links(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        f = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 3)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = {c: np.array(v) for c, v in (("key", [5] * 120), ("fixed", [0] * 120), ("node", signed), ("route", signed), ("f0", signed))}
    got = simhash._finer_exact(3)(rows)
    meet = {}
    for key, f in zip(got["key"].tolist(), got["node"].tolist()):
        meet.setdefault(key, set()).add(f)
    pairs = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    u = lambda x: x & (1 << 64) - 1
    together = {(a, b) for s in meet.values() for a in map(u, s) for b in map(u, s) if a < b}
    assert pairs and pairs <= together


def test_a_bucket_of_one_route_is_compared_whole():
    rng = np.random.default_rng(4)
    n = simhash.BUCKET + 500
    fps = np.repeat(rng.integers(0, 1 << 63, (1, 4)), n, axis=0)
    for k in range(10):  # two copies differ in at most 20 bits
        fps[np.arange(n), rng.integers(0, 4, n)] ^= 1 << rng.integers(0, 63, n)
    rows = {"key": np.append(np.full(n, 5), [6, 7, 7]), "node": np.arange(n + 3), **{f"f{k}": np.append(fps[:, k], fps[:3, k]) for k in range(4)}}
    table = pa.table({c: pa.array(x.astype(np.int64)) for c, x in rows.items()})
    out = [(r["a"], r["b"]) for b in simhash._spanning(4, 20)[0](iter(table.to_batches(max_chunksize=700))) for r in b.to_pylist()]
    assert sorted(out) == [(i, 0) for i in range(1, n)] + [(n + 2, n + 1)]


def test_shared_shingles_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = random.Random(3)
    sets = [sorted(rng.sample(range(60), rng.randrange(40))) for _ in range(25)] + [[], [1 << 63]]
    got = simhash.shared_shingles([np.array(x, np.uint64) for x in sets])
    assert all(got[i, j] == len(set(a) & set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_components_of_chains_stars_and_self_links(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 140)] + [(139, 100)]
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + [(500, 500)], "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_keep_one_of_each_group(make):
    rng = random.Random(9)
    vocab = [f"u{i}" for i in range(2000)]
    rows, groups = [], {}
    for g in range(30):
        w = [rng.choice(vocab) for _ in range(250)]
        for c in range(rng.choice([1, 1, 2, 4])):
            x = list(w)
            for _ in range(c):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            groups[g * 10 + c] = g
            rows.append((g * 10 + c, " ".join(x)))
    kept = [r.doc_id for r in simhash.drop_near_copies(make(rows)).collect()]
    assert sorted(groups[d] for d in kept) == sorted(set(groups.values())) and all(d % 10 == 0 for d in kept)


def test_edges(make, edge):
    docs = make(edge, clashes=True)
    got = simhash.near_components(docs).collect()
    assert len(got) == len(edge)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and all(r.fp == 0 for r in got if r.doc_id in (1, 2, 3))
    kept = simhash.drop_near_copies(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(7) == 1 and ids.count(None) == 1 and {4, 9, 10} <= set(ids) and not {5, 13} & set(ids)
    assert simhash.near_components(docs.limit(0)).count() == simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_are_held_to_the_similarity(make):
    rng = random.Random(21)
    vocab = [f"u{i}" for i in range(3000)]
    rows = []
    for g in range(150):
        w = [rng.choice(vocab) for _ in range(300)]
        x = list(w)
        for i in rng.sample(range(300), rng.randint(2, 16)):  # about 0.6 to 0.97
            x[i] = rng.choice(vocab)
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(x))]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(296)} for d, t in rows}
    alike = {d: len(sets[d] & sets[d - 1]) / len(sets[d] | sets[d - 1]) for d in sets if d % 2}
    kept = {r.doc_id for r in simhash.drop_near_copies(make(rows)).collect()}
    assert {d for d in alike if d not in kept} == {d for d, s in alike.items() if s >= 0.8}
    assert sum(0.7 <= s < 0.8 for s in alike.values()) > 20 < sum(0.8 <= s < 0.9 for s in alike.values())


@pytest.mark.parametrize("block", [512, 7])
def test_a_group_is_decided_whole_however_it_is_dealt_out(make, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", block)
    rng = random.Random(22)
    vocab = [f"u{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(300)]
    rows = []
    for d in range(60):  # each alike to the next, not to the others
        for i in range(4 * d, 4 * d + 4):
            base[i * 7 % 300] = rng.choice(vocab)
        rows.append((d, " ".join(base)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(296)} for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(make(rows)).collect()}
    assert got == root


def test_rows_of_one_id_are_decided_by_their_texts(make):
    rng = random.Random(23)
    one, two, three = (" ".join(f"q{rng.randrange(900)}" for _ in range(80)) for _ in range(3))
    rows = [(7, one), (7, two), (7, two.upper()), (8, two + " end"), (9, three), (9, one + " end")]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(make(order)).collect())
        assert len(got) == 3 and (7, one) in got and (9, three) in got
        same = [t for d, t in got if d == 7 and t != one]
        assert order is rows or same == first
        first = same


def test_a_row_that_comes_twice_into_a_tile_links_to_others_alone():
    sets = [np.arange(20, dtype=np.uint64), np.arange(1, 21, dtype=np.uint64), np.arange(50, 70, dtype=np.uint64)]
    t = pa.table({"node": [3, 1, 2, 3], "shingles": [sets[0].tobytes(), sets[1].tobytes(), sets[2].tobytes(), sets[0].tobytes()]})
    assert simhash._alike((), t).to_pylist() == [{"a": 3, "b": 1}]
