"""Date arithmetic, ranks, rolling primitives against pandas and brute force."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelweave.functions import dates, ranks, stats, timewin
from panelweave.operators import market
from tests.util import bars, date, walk


def test_bday_add_matches_pandas_including_weekends(spark):
    days = pd.date_range("2023-12-25", periods=21)
    rows = [(d.date(), n, (d + pd.tseries.offsets.BDay(n)).date()) for d in days for n in (0, 1, 2, 4, 5, 6, 10, 21, 63, 252)]
    df = spark.createDataFrame(rows, "d date, n int, want date").withColumn("got", dates.bday_add(F.col("d"), F.col("n")))
    assert df.where("got <> want").count() == 0


def test_bday_count_matches_pandas(spark):
    days = pd.date_range("2023-12-25", periods=15)
    rows = [(a.date(), b.date(), len(pd.bdate_range(a, b))) for a in days for b in days if a <= b]
    df = spark.createDataFrame(rows, "a date, b date, want long").withColumn("got", dates.bday_count(F.col("a"), F.col("b")))
    assert df.where("got <> want").count() == 0


def test_percentile_rank_averages_ties_ignores_nulls_and_survives_a_hot_tie(spark):
    rng = random.Random(3)
    values = [rng.choice([None, -1.5, 0.0, 0.0, 1e-9, 3.25, rng.gauss(0, 1)]) for _ in range(400)] + [7.0] * 300
    rows = [("g", i, v) for i, v in enumerate(values)] + [("h", 0, 5.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = ranks.percentile_rank(df, ["k"], ["v"], digits=None, ids=["i"]).where("k = 'g'").orderBy("i").toPandas()["v_pct"]
    want = pd.Series(values, dtype=float).rank(pct=True) * 100
    assert np.allclose(got.astype(float), want, equal_nan=True)


def test_order_bucket_is_monotone(spark):
    vs = sorted([0.0, 1e-300, -1e-300, 1e300, -1e300] + [random.Random(i).uniform(-5, 5) * 10 ** (i % 9 - 4) for i in range(500)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double").withColumn("b", ranks.order_bucket("v"))
    b = [r.b for r in df.orderBy("i").collect()]
    assert b == sorted(b)


def test_weighted_and_plain_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 3.0), ("b", 1.0, 1.0), ("b", 3.0, 1.0), ("c", 5.0, 0.0)], "k string, v double, w double")
    got = {r.k: r.m for r in ranks.weighted_median(df, ["k"], "v", "w", "m").collect()}
    assert got == {"a": 9.0, "b": 1.0, "c": None}
    med = {r.k: r.m for r in ranks.group_median(df, ["k"], "v", "m").collect()}
    assert med == {"a": 2.0, "b": 2.0, "c": 5.0}


def test_full_window_guard(spark):
    df = bars(spark, {"A": [1, 2, None, 4, 5, 6]}).withColumn("m", timewin.roll_mean("close", 3))
    assert [r.m for r in df.orderBy("ts").collect()] == [None, None, None, None, None, 5.0]


def test_ewm_matches_adjusted_pandas_across_blocks_and_gaps(spark):
    cs = walk(2600, seed=5)
    for i in (0, 7, 1023, 1024, 1500):
        cs[i] = None
    df = timewin.with_blocks(bars(spark, {"A": cs}, start="2000-01-03"))
    got = timewin.ewm_mean(df, {"f": ("close", 9), "s": ("close", 26)}).orderBy("ts").toPandas()
    s = pd.Series(cs, dtype=float)
    assert np.allclose(got.f.astype(float), s.ewm(span=9).mean(), rtol=1e-11, equal_nan=True)
    assert np.allclose(got.s.astype(float), s.ewm(span=26).mean(), rtol=1e-11, equal_nan=True)


def test_rolling_drawdown_matches_brute_force(spark):
    cs = walk(150, seed=9)
    df = timewin.rolling_drawdown(timewin.with_position(bars(spark, {"A": cs})), "close", 20, "dd")
    got = [r.dd for r in df.orderBy("ts").collect()]
    want = []
    for i in range(len(cs)):
        w = np.array(cs[max(0, i - 19): i + 1])
        want.append((w / np.maximum.accumulate(w) - 1).min())
    assert np.allclose(got, want)


def test_null_not_nan(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 1.0), (None, 1.0)], "a double, b double")
    rows = df.select(stats.ratio("a", "b").alias("r"), stats.finite("a").alias("f"), stats.dead_band_sign("a", 0.5).alias("s")).collect()
    assert rows[0].r is None and rows[1].f is None and [r.s for r in rows] == [1, 0, 0]


def test_wilson_and_shrink(spark):
    r = spark.range(1).select(
        stats.wilson_lower(F.lit(0), F.lit(0)).alias("w0"), stats.wilson_lower(F.lit(8), F.lit(10)).alias("w"),
        stats.shrink(F.lit(1.0), F.lit(0.55), 25.2).alias("hi"), stats.shrink(F.lit(0.0), F.lit(0.55), 25.2).alias("lo"),
        stats.shrink(F.lit(0.9), F.lit(0.5), 5.0).alias("weak"), stats.shrink(F.lit(0.9), F.lit(0.5), 500.0).alias("strong")).first()
    assert r.w0 == 0.0 and 0.47 < r.w < 0.5
    assert r.hi <= 0.95 and r.lo >= 0.05 and r.weak < r.strong <= 0.9


def test_last_day_helper(spark):
    assert spark.range(1).select(dates.month_end(F.lit("2024-02-10").cast("date")).alias("d")).first().d == date("2024-02-29")


def test_ewm_repeats_its_mean_over_long_gaps_and_takes_any_span(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(100, 5, 5200)
    x[700:3400] = np.nan  # over two blocks without a value
    s = pd.Series(x)
    rows = [("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = timewin.with_blocks(spark.createDataFrame(rows, "entity string, ts int, close double"))
    spans = [2, 9, 26, 80, 400]
    got = timewin.ewm_mean(df, {f"s{n}": ("close", n) for n in spans}).orderBy("ts").toPandas()
    for n in spans:
        want = s.ewm(span=n, ignore_na=False).mean()
        assert np.allclose(got[f"s{n}"].astype(float), want, rtol=1e-9, equal_nan=True), n


def test_the_rank_plan_does_not_grow_with_the_columns(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as entity", *[f"rand({c}) as c{c}" for c in range(5)])
    plan = lambda columns: ranks.percentile_rank(df, ["k"], columns)._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert plan(["c0"]) == plan([f"c{c}" for c in range(5)]) <= 12


def test_buckets_spread_values_that_lie_near_one_number(spark):
    df = spark.range(1000).select((F.lit(100.0) + F.col("id") / 500).alias("v"))
    assert df.select(ranks.order_bucket("v")).distinct().count() > 20


def test_halves_of_rounded_differences_round_as_in_sql(spark):
    import duckdb

    rng = random.Random(5)
    pairs = [(rng.randint(-3000, 3000) / 100, rng.randint(-3000, 3000) / 100) for _ in range(3000)] + [(8.15, 1.1), (None, 1.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    got = df.select("i", *[stats.round_even(F.col("a") - F.col("b"), d).alias(f"d{d}") for d in (0, 1, 2, 4)]).toPandas().sort_values("i")  # noqa: F841
    rows = df.toPandas()  # noqa: F841
    apart = duckdb.sql("SELECT count(*) FROM rows JOIN got USING (i) WHERE " + " OR ".join(f"round_even(a - b, {d}) IS DISTINCT FROM d{d}" for d in (0, 1, 2, 4)))
    assert apart.fetchall() == [(0,)]


def test_tilt_rounds_a_difference_beside_a_half_as_its_sql_does(spark):
    rows = [(date("2024-01-31"), "KR", 28.45, 1.0), (date("2024-01-31"), "US", 1.1, 0.0)]
    (r,) = market.tilt(spark.createDataFrame(rows, "as_of date, region string, ret_3m double, ret_6m double")).collect()
    assert 28.45 - 1.1 == 27.349999999999998 and (r.d3, r.tilt) == (27.4, "KR")
