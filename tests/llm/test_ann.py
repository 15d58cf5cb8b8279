import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import ann
from panelweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(ids, x, query, k=5):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x[list(ids).index(query)]
    return [ids[i] for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != query][:k]


def test_recall_against_brute_force(spark):
    vec = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in vec]), np.array([r[1] for r in vec], float)
    got = {}
    for r in QUERIES["op4_dimension_scan"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {i for i in ids if i % 50 == 0}
    hits = [len({v for _, v in got[q]} & set(brute(ids, x, q))) for q in got]
    assert sum(hits) >= 0.9 * 5 * len(got) and all([r for r, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())


def test_the_scan_gives_up_far_candidates_and_keeps_near_ones():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(64, 5000))
    x /= np.linalg.norm(x, axis=0)
    q = x[:, 7] + 0.01 * rng.normal(size=64)
    d = ((x - q[:, None]) ** 2).sum(axis=0)
    live = ann.scan(x, q, np.partition(d, 5)[5], 5)
    assert len(live) < 50 and set(np.argsort(d)[:4]) <= set(live)


def test_edges(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(0, e), (50, [0.0, 1.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, e), (3, e), (4, [1.0, 1.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]),
            (8, [None, 1.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [1.0]), (None, e), (2, e), (11, []), (12, [1e-300, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = [tuple(r) for r in ann.nearest(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 12), (0, 5, 4), (50, 1, 4), (50, 2, 0), (50, 3, 1), (50, 4, 2), (50, 5, 3)]
    assert abs(got[0][3] - 1) < 1e-15
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = ann.nearest(df.filter("vec_id in (0, 1)"), F.col("id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 1)]
