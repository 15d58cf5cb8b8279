import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelweave.functions.asof import asof_merge


@pytest.mark.parametrize("bucket", [1, 30, 5000])
def test_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    day = lambda: dt.date(1969, 6, 1) + dt.timedelta(days=rng.randrange(900))
    # Releases in no order of their observations, ties, nulls, and keys that one side alone has.
    right = [(rng.choice("abc"), i % 150, None if rng.random() < 0.05 else day(), rng.choice([None, float(i)])) for i in range(400)]
    left = [(rng.choice("abcd"), day(), i) for i in range(300)]
    seen = spark.createDataFrame(right, "k string, obs int, since date, x double")
    got = asof_merge(spark.createDataFrame(left, "k string, at date, n int"), seen, ["k"], "at", F.col("since"), "obs", bucket).collect()
    want = {}
    for k, at, n in left:
        rows = [(obs, since, (x is not None, x)) for key, obs, since, x in right if key == k and since is not None and since <= at]
        if rows:
            want[n] = (k, at, *(lambda r: (r[0], r[1], r[2][1]))(max(rows)))
    assert {r.n: (r.k, r["at"], r.obs, r.since, r.x) for r in got} == want and len(got) == len(want)


def test_the_plan_has_no_row_per_day(spark):
    from panelweave.operators import regime as rg

    obs = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0)], "indicator string, obs_date date, value double")
    asofs = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2023, 1, 31),)], "as_of date")
    out = rg.asof_visible(obs, asofs, F.col("obs_date"))
    assert [(r.as_of, r.value) for r in out.collect()] == [(dt.date(2024, 1, 31), 1.0)]
    plan = out._jdf.queryExecution().toString()
    assert "sequence(" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_side_that_is_partitioned_by_its_key_already(spark):
    from pyspark.sql import Window

    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=d), float(d)) for k, step in (("rare", 31), ("daily", 1)) for d in range(0, 570, step)]
    obs = spark.createDataFrame(rows, "k string, at date, x double")
    obs = obs.withColumn("chg", F.col("x") - F.lag("x").over(Window.partitionBy("k").orderBy("at")))
    asks = obs.select("k").distinct().withColumn("day", F.explode(F.expr("sequence(date'2020-01-31', date'2021-09-30', interval 1 month)")))
    got = [(r.k, r.day, r["at"]) for r in asof_merge(asks, obs, ["k"], "day", F.col("at"), "at").collect()]
    want = [(k, day, max(at for key, at, _ in rows if key == k and at <= day)) for k, day in {(g[0], g[1]) for g in got}]
    assert sorted(got) == sorted(want) and len(got) == asks.count()
