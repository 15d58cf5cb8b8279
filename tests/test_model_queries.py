"""The fold models on panels with a known answer."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import ensemble
from panelweave.operators import models as md
from panelweave.plans import model_queries as mq

SF = "/root/testdata/sf0.001"
SMALL = md.ModelConfig(min_train=120, step=20, calibration=60, oos_start="2020-01-01", trees=20, depth=3, fit_rows=3000, cal_rows=1500)


def test_model_queries_run_the_full_job(spark):
    full = md.ModelConfig()
    assert (mq.CFG.step, mq.CFG.trees, mq.CFG.depth) == (full.step, full.trees, full.depth) and mq.HORIZONS == (21, 63, 126)
    assert len(mq.fx.feature_columns(mq.model_panel(spark, SF))) > 20


def test_fold_audit_has_all_folds_of_a_horizon(spark):
    days = "explode(sequence(date'1995-01-01', date'1995-01-01' + 1199)) AS ts"
    panel = spark.range(1).selectExpr("'A' AS entity", days, "1.0 AS x", "1.0 AS target_21d")
    got = mq.fold_bounds(panel, ["x"], "target_21d", 21).collect()
    assert len(got) == 5 and {(r.entity, r.horizon) for r in got} == {("A", 21)}  # from day 1096, every 21 of 1200


# ------------------------------------------------------------------ the members
def logit_data(n=4000, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, (sum_of(x) + rng.logistic(size=n) > 0).astype(float)


def sum_of(x):
    return 2 * x[:, 0] - x[:, 1]


def test_logistic_is_the_minimum_of_its_loss():
    x, y = logit_data()
    x, penalty = ensemble.with_constant(x), np.append(np.ones(6), 0.0)
    w = ensemble.fit_logistic(x, y, penalty, 0.1)
    loss = lambda w: 0.1 * np.log1p(np.exp(np.where(y > 0, -1, 1) * (x @ w))).sum() + 0.5 * (penalty * w**2).sum()
    for k in range(7):
        step = np.eye(7)[k] * 1e-4
        assert loss(w) <= min(loss(w + step), loss(w - step))


def grown(x, g, h, depth, rows, bins):
    """One tree by trying every split of every node: the leaf value of each row."""
    out = np.zeros(len(x))

    def go(mine, left):
        if not left or not len(mine):
            return leaf(mine)
        best, parts = 1e-9, None
        for j in range(x.shape[1]):
            for t in bins[j]:
                r = x[mine, j] >= t
                a, b = mine[~r], mine[r]
                a, b = a[np.isin(a, rows)], b[np.isin(b, rows)]
                if h[a].sum() < ensemble.LEAST_HESSIAN or h[b].sum() < ensemble.LEAST_HESSIAN:
                    continue
                both = np.concatenate([a, b])
                gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - g[both].sum() ** 2 / h[both].sum()
                if gain > best + 1e-9:
                    best, parts = gain, (mine[~r], mine[r])
        if parts is None:
            return leaf(mine)
        go(parts[0], left - 1)
        go(parts[1], left - 1)

    def leaf(mine):
        own = mine[np.isin(mine, rows)]
        out[mine] = -g[own].sum() / max(h[own].sum(), 1e-12)

    go(np.arange(len(x)), depth)
    return out


def test_a_tree_is_the_greedy_one_over_all_splits(monkeypatch):
    monkeypatch.setattr(ensemble, "COLUMN_SHARE", 1.0)
    x, y = logit_data(300, 3, 2)
    start, feature, threshold, leaf = ensemble.fit_trees(x, y, 1, 3, 1.0, 1.0)
    p = ensemble.sigmoid(np.full(300, start))
    bins = [np.unique(np.quantile(x[:, j], np.arange(1, ensemble.BINS) / ensemble.BINS)) for j in range(3)]
    assert np.allclose(ensemble.tree_sums(x, feature, threshold, leaf), grown(x, p - y, p * (1 - p), 3, np.arange(300), bins))


def test_boosting_learns_an_interaction_that_a_linear_member_cannot():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = ensemble.fit(x[:4000], y[:4000], x[4000:5000], y[4000:5000], 60, 4, 0.2, 0.8, 0.1)

    p = ensemble.calibrated(ensemble.raw_probability(x[5000:], m), m)
    assert ((p >= 0.5) == y[5000:]).mean() > 0.93 and np.corrcoef(x[5000:, 0], y[5000:])[0, 1] < 0.1


def test_one_class_leaves_out_members():
    x, y = logit_data(500)
    m = ensemble.fit(x, np.ones(500), x, y, 3, 2, 0.1, 0.8, 0.1)
    assert not len(m["coef"]) and ensemble.raw_probability(x, m).min() > 0.9
    m = ensemble.fit(x, y, x, np.zeros(500), 3, 2, 0.1, 0.8, 0.1)
    assert m["slope"] is None and len(m["coef"])


# ------------------------------------------------------------------ the walk
def panel(spark, entities=12, days=420, seed=4):
    """Targets follow the sign of ``good`` in three of four rows; ``noise`` says nothing.  The newest rows have none."""
    rng = np.random.default_rng(seed)
    start, rows = dt.date(2019, 1, 1), []
    for e in range(entities):
        for t in range(days):
            good, noise = rng.normal(size=2)
            up = (good > 0) == (rng.random() < 0.75)
            bad = float("inf") if (e, t) == (0, 5) else None if (e, t) == (0, 6) else float(noise)
            rows.append((f"E{e:02d}", "US", start + dt.timedelta(days=t), 10.0, float(10.0 + good), float(good), bad, None if t >= days - 10 else int(up)))
    return spark.createDataFrame(rows, "entity string, region string, ts date, open double, close double, good double, noise double, target_10d int")


@pytest.fixture(scope="module")
def walked(spark):
    df = panel(spark)
    return df, md.walk_forward(df, ["good", "noise"], "target_10d", SMALL, 10).cache()


def test_predictions_follow_the_planted_signal(walked):
    df, out = walked
    rows = out.collect()
    tested = df.where("target_10d is not null and ts >= '2020-01-01'").count()
    assert len(rows) == tested and len({(r.entity, r.ts) for r in rows}) == tested
    assert np.mean([r.pred == r.actual for r in rows]) > 0.7
    strong = [r for r in rows if abs(r.close - 10) > 0.3]
    assert np.mean([(r.prob_raw > 0.5) == (r.close > 10) for r in strong]) > 0.97
    assert all(0.05 <= r.prob_cal <= 0.95 for r in rows) and 0.55 < np.mean([r.prob_cal for r in rows if r.close > 10.3]) < 0.6  # six of twenty-one parts evidence


def test_folds_are_purged_and_every_row_lies_in_its_own(walked):
    rows = walked[1].collect()
    for r in rows:
        assert r.train_end < r.cal_start and r.cal_end < r.test_start <= r.ts <= r.test_end
        assert (r.cal_start - r.train_end).days > 10 and (r.test_start - r.cal_end).days > 10


def test_later_rows_change_no_earlier_prediction(spark, walked):
    df, out = walked
    cut = dt.date(2020, 1, 21)
    early = md.walk_forward(df.where(F.col("ts") <= F.lit(cut)), ["good", "noise"], "target_10d", SMALL, 10)
    want = {(r.entity, r.ts): (r.prob_raw, r.prob_cal) for r in out.collect()}
    got = {(r.entity, r.ts): (r.prob_raw, r.prob_cal) for r in early.collect()}
    assert got and all(np.allclose(v, want[k]) for k, v in got.items() if k[1] <= dt.date(2020, 1, 20))


def test_fits_stay_within_their_bound_and_scores_cover_all(spark):
    df = panel(spark, entities=30)
    frame = md._framed(df.where("target_10d is not null"), ["good", "noise"], "target_10d", ["entity", "region", "ts"])
    fold = {"fold": 1, "train_start": dt.date(2019, 1, 1), "train_end": dt.date(2019, 10, 1), "cal_start": dt.date(2019, 10, 20), "cal_end": dt.date(2019, 12, 18)}
    fold = md._shares(md._per_date(frame), fold, SMALL)
    base = fold.pop("base")
    (model,) = md.fit_folds(frame, [fold], SMALL).collect()
    window = frame.where("ts between '2019-10-20' and '2019-12-18'")
    assert base == window.agg(F.avg("y")).first()[0]
    assert 0.9 * SMALL.fit_rows < model.n_train < 1.1 * SMALL.fit_rows and 0.9 * SMALL.cal_rows < model.n_cal < 1.1 * SMALL.cal_rows


def test_current_signal_knows_the_newest_rows(spark):
    df = panel(spark)
    got = {r.entity: r for r in md.current_signal(df, ["good", "noise"], "target_10d", SMALL, 10).collect()}
    newest = {r.entity: r for r in df.orderBy("ts").collect()}
    assert set(got) == set(newest) and {r.ts for r in got.values()} == {dt.date(2019, 1, 1) + dt.timedelta(days=419)}
    sure = [e for e in got if abs(newest[e].good) > 0.3]
    assert len(sure) > 5 and all(got[e].prediction == ("UP" if newest[e].good > 0 else "DOWN") for e in sure)
    assert all((got[e].prob_up > 0.5) == (newest[e].good > 0) and (got[e].prob_up_raw > 0.5) == (newest[e].good > 0) for e in sure)
    assert md.current_signal(df.limit(0), ["good", "noise"], "target_10d", SMALL, 10).count() == 0
    assert md.current_signal(df.where("ts < '2019-04-01'"), ["good", "noise"], "target_10d", SMALL, 10).count() == 0
