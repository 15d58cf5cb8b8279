import numpy as np
import pytest

from panelweave.llm import tiles
from panelweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(ids, x, t=0.95):
    """{id: (links, component)} by all cosines in double precision."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= t
    np.fill_diagonal(near, False)
    comp = np.array(ids)
    while True:
        least = np.array([min(comp[i], comp[near[i]].min(initial=comp[i])) for i in range(len(ids))])
        if (least == comp).all():
            return {i: (int(near[k].sum()), int(comp[k])) for k, i in enumerate(ids)}
        comp = least


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_the_query_against_brute_force(spark):
    vec = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = QUERIES["op13_embedding_near_dedup"](spark, SF).collect()
    want = brute([r[0] for r in vec], np.array([r[1] for r in vec], float))
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_bounds_hold_and_leave_few_pairs_in_doubt():
    rng = np.random.default_rng(3)
    x = tiles.unit(np.concatenate([rng.normal(size=(300, 64)), np.eye(64)[:20], rng.normal(size=(20, 64)) ** 9]))
    x = np.concatenate([x, tiles.unit(x + 0.03 * rng.normal(size=x.shape))])
    side = tiles.Side(np.arange(len(x)), np.ones(len(x), np.int64), *tiles.quantise(x))
    true, sure, doubt = x @ x.T, set(), set()
    for i, j, s in tiles.doubtful(side, side, 0.95, True):
        sure |= set(zip(i[s].tolist(), j[s].tolist()))
        doubt |= set(zip(i[~s].tolist(), j[~s].tolist()))
    links = {(i, j) for i, j in zip(*np.nonzero(true >= 0.95)) if i < j}
    assert sure <= links <= sure | doubt and sure and len(doubt) < len(links)


def test_products_of_wide_codes_are_exact():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-127, 128, (5, 3000)).astype(np.int8), np.full((4, 3000), 127, np.int8)
    assert (tiles.code_products(a, b) == a.astype(int) @ b.astype(int).T).all()


@pytest.mark.parametrize("spread", [0.02, 0.35])
def test_many_tiles_pivots_and_a_dense_group(spark, monkeypatch, spread):
    monkeypatch.setattr(tiles, "TILE", 64)
    monkeypatch.setattr(tiles, "ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(12, size=300)] + spread * rng.normal(size=(300, 16)), centres[0] + 0.05 * rng.normal(size=(200, 16)), np.repeat(centres[1:2], 150, axis=0), rng.normal(size=(60, 16))])
    # Scaled copies are links, not copies.
    x[450:500] *= 3
    ids = rng.permutation(5 * len(x))[: len(x)]
    assert result(tiles.near_vectors(frame(spark, ids, x))) == brute(ids.tolist(), x)


def test_a_chain_over_many_tiles_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 8)
    angle = np.arange(60) * 0.3
    x = np.stack([np.cos(angle / 3), np.sin(angle / 3), np.full(60, 1e-3)], axis=1)
    assert result(tiles.near_vectors(frame(spark, range(60), x))) == brute(list(range(60)), x)


def test_edges(spark):
    e, inf = [1.0, 0.0, 0.0], float("inf")
    rows = [(1, e), (2, [5.0, 0.0, 0.0]), (3, e), (4, [1.0, 0.3, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [inf, 0.0, 0.0]),
            (10, [1.0]), (11, [2.0]), (None, e), (3, e), (12, []), (13, [1e-300, 0.0, 0.0]), (14, [1e300, 0.0, 0.0]), (15, [-1.0, 0.0, 0.0]), (16, [0.95, (1 - 0.95**2) ** 0.5 - 1e-9, 0.0]), (17, [0.95, (1 - 0.95**2) ** 0.5 + 1e-9, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, node int, n_links string")
    got = result(tiles.near_vectors(df))
    assert got[1] == got[2] == got[3] == got[13] == got[14] == (6, 1)  # with 4 and 16
    assert got[4] == (7, 1) and got[16] == (7, 1) and got[17] == (2, 1)
    assert got[10] == got[11] == (1, 10)
    assert all(got[i] == (0, i) for i in (5, 6, 7, 8, 9, 12, 15)) and len(got) == 17
    assert tiles.near_vectors(df.limit(0)).count() == 0
    assert result(tiles.near_vectors(df.filter("vec_id in (5, 6)"))) == {5: (0, 5), 6: (0, 6)}
