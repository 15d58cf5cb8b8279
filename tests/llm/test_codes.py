import hashlib

import numpy as np

from panelweave.llm import codes
from panelweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, parts=16, entries=64, rounds=2):
    """{id: (code, error, label_error)} and the codebooks' digest, by plain integers; ids are unique."""
    x = {i: [int(np.floor(256 * c)) for c in v] for i, _, v in rows}
    label = {i: g for i, g, _ in rows}
    width = len(next(iter(x.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in x.items()}
    books = [[cut[i][p] for i in sorted(x)[:entries]] for p in range(parts)]

    def pick(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            near = {}
            for i in x:
                near.setdefault(pick(cut[i][p], books[p])[0], []).append(cut[i][p])
            books[p] = [[sum(c) // len(near[e]) for c in zip(*near[e])] if e in near else old for e, old in enumerate(books[p])]
    chosen = {i: [pick(cut[i][p], books[p]) for p in range(parts)] for i in x}
    error = {i: sum(d for _, d in c) for i, c in chosen.items()}
    groups = {}
    for i in x:
        groups[label[i]] = groups.get(label[i], 0) + error[i]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for e, _ in chosen[i]), error[i], groups[label[i]]) for i in x}, digest


def test_the_query_against_plain_integers(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op11_vector_codes"](spark, SF).collect()
    want, digest = brute(rows)
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}


def test_the_transform_scales_distances_and_orders_by_sequency():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-9999, 9999, (50, 5)), rng.integers(-9999, 9999, (50, 5))
    assert (((codes.transform(x) - codes.transform(y)) ** 2).sum(axis=1) == 8 * ((x - y) ** 2).sum(axis=1)).all()
    h = codes.hadamard(8)
    assert (h @ h.T == 8 * np.eye(8)).all() and ((h[:, 1:] != h[:, :-1]).sum(axis=1) == np.arange(8)).all()


def test_the_early_end_changes_nothing():
    rng = np.random.default_rng(2)
    x, e = rng.integers(-40, 40, (3000, 8)), rng.integers(-40, 40, (64, 8))
    e[40:50] = e[:10]
    x[:500] = x[500]
    e[5], e[33] = x[500] + 1, x[500] - 1  # an exact tie
    d = ((x[:, None] - e[None]) ** 2).sum(axis=2)
    entry, error = codes.nearest(codes.transform(x), codes.transform(e))
    assert (entry == d.argmin(axis=1)).all() and (error == 8 * d.min(axis=1)).all()


def test_edges(spark):
    v = [0.5, -0.001, 0.25, 1.0]
    rows = [(1, 1, v), (2, None, [-x for x in v]), (3, None, None), (4, 1, [float("nan")] * 4), (5, 1, [None, 1.0, 1.0, 1.0]), (6, 1, [float("-inf")] * 4), (7, 2, v), (7, 2, v),
            (None, None, [0.1] * 4), (8, 3, []), (9, 3, [1e300] * 3), (10, 3, [0.0, 0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string")
    out, books = codes.compress(df, parts=4, entries=3, rounds=2)
    got = out.collect()
    assert books.entries.shape == (4, 3, 2)  # the longest vector has five components: padded to eight
    assert sorted((r.id is None, r.id) for r in got if r.id) == [(False, i) for i in (1, 2, 7, 7, 8, 9, 10)] and len(got) == 8
    byid = {r.id: r for r in got}
    assert byid[1].code == byid[7].code and byid[2].label_error == byid[None].label_error == byid[2].error + byid[None].error
    assert all(r.error >= 0 and len(r.code) == 4 for r in got)
    empty, none = codes.compress(df.limit(0))
    assert empty.count() == 0 and none is None
    few, books = codes.compress(df.filter("vec_id = 1"), parts=4)
    assert books.entries.shape == (4, 1, 1) and [(bytes(r.code), r.error) for r in few.collect()] == [(bytes(4), 0)]
