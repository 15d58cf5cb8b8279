"""Market-level readings: breadth, sentiment, allocation direction, style factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import group_median
from ..functions.stats import TRADING_DAYS, clip, round_even
from ..functions.timewin import pct_change, roll_std
from .diagnosis import trailing_return

TARGET_VOL_PCT = 12.0


def breadth(screened: DataFrame, keys: list[str] = ["as_of", "region"]) -> DataFrame:
    """Share of names above their trend lines, share in Bull, median 60-row momentum."""
    share = lambda cond: 100 * F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    base = screened.groupBy(*keys).agg(
        share(F.col("above_ma200")).alias("breadth_200"),
        share(F.col("above_ma50")).alias("breadth_50"),
        share(F.col("regime") == "Bull").alias("bull_pct"),
    )
    mid = group_median(screened.select(*keys, "mom60"), keys, "mom60", "_mid")
    return base.join(mid, keys, "left").withColumn(
        "median_momentum", F.coalesce(F.col("_mid") * 100, F.lit(0.0))
    ).drop("_mid")


def sentiment(breadth_df: DataFrame, macro: DataFrame) -> DataFrame:
    """Score 0-100 per region and date from breadth and that region's macro gauges.

    ``macro`` has one row per as-of date with nullable vix, hy_spread,
    yield_curve, usd_krw, usd_krw_chg, korea_10y, korea_3m.
    """
    df = breadth_df.join(macro, "as_of", "left")
    pts = lambda cond, yes, no=0: F.when(cond, yes).otherwise(no)
    base = (
        50.0 + (F.col("breadth_200") - 50) * 0.4 + (F.col("breadth_50") - 50) * 0.1
        + pts(F.col("median_momentum") > 0, 8, -8) + (F.col("bull_pct") - 50) * 0.1
    )
    us = (
        F.when(F.col("vix") > 25, -10).when(F.col("vix") < 16, 5).otherwise(0)
        + pts(F.col("hy_spread") > 5, -10) + pts(F.col("yield_curve") < 0, -8)
    )
    kr = (
        pts(F.col("usd_krw") > 1400, -10) + pts(F.col("usd_krw_chg") > 3, -6)
        + pts(F.col("korea_10y") - F.col("korea_3m") < 0, -8)
    )
    score = clip(base + F.when(F.col("region") == "US", us).otherwise(kr), 0, 100)
    df = df.withColumn("_score", score)
    s = F.col("_score")
    return df.select(
        "as_of", "region",
        round_even(s, 0).cast("int").alias("score"),
        F.when(s >= 60, "bullish").when(s < 40, "bearish").otherwise("neutral").alias("label"),
        F.when(s < 25, "extreme fear").when(s < 45, "fear").when(s < 55, "neutral").when(s < 75, "greed").otherwise("extreme greed").alias("fear_greed"),
        round_even("breadth_200", 0).cast("int").alias("breadth_200"),
    )


# ------------------------------------------------------------------ direction
def horizon_returns(closes: DataFrame) -> DataFrame:
    """3, 6 and 12-month percent returns per row, two decimals."""
    r = lambda k: round_even(trailing_return("close", k), 2)
    return closes.select("*", r(63).alias("ret_3m"), r(126).alias("ret_6m"), r(252).alias("ret_12m"))


def dual_momentum(returns: DataFrame) -> DataFrame:
    """Best risk asset by 12-month return against the cash hurdle and zero, else the
    best defensive asset.  Input: as_of, entity, kind (risk/defense/cash), position, ret_12m."""
    best = lambda kind: F.max(
        F.when(
            (F.col("kind") == kind) & F.col("ret_12m").isNotNull(),
            F.struct(F.col("ret_12m").alias("r"), (-F.col("position")).alias("p"), F.col("entity").alias("e")),
        )
    )
    cash = F.min(F.when(F.col("kind") == "cash", F.struct(F.col("position").alias("p"), F.col("ret_12m").alias("r"))))
    g = returns.groupBy("as_of").agg(best("risk").alias("_risk"), best("defense").alias("_def"), cash.alias("_cash"))
    risk, hurdle = F.col("_risk.r"), F.col("_cash.r")
    win = F.coalesce((risk > 0) & (hurdle.isNull() | (risk > hurdle)), F.lit(False))
    return g.select(
        "as_of", win.alias("equities_win"),
        F.when(win, F.col("_risk.e")).otherwise(F.coalesce("_def.e", "_risk.e")).alias("winner"),
        hurdle.alias("cash_12m"),
    )


def vol_target(benchmark: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Exposure that brings the last 21 returns' volatility to target, per row."""
    w = Window.partitionBy(*keys).orderBy("ts")
    df = benchmark.where(F.col("close").isNotNull()).withColumn("_r", pct_change("close", 1, w))
    df = df.withColumn("_v", roll_std("_r", 21, w) * (TRADING_DAYS ** 0.5) * 100).where(F.col("_v") > 0)
    return df.select(
        *keys, "ts",
        round_even("_v", 1).alias("realized_vol"),
        round_even(clip(F.lit(TARGET_VOL_PCT) / F.col("_v") * 100, 20, 100), 0).cast("int").alias("exposure_pct"),
    )


def tilt(returns: DataFrame) -> DataFrame:
    """KR against US relative strength over 3 and 6 months; null when either is unknown.
    Input: as_of, region, ret_3m, ret_6m."""
    at = lambda r, c: F.max(F.when(F.col("region") == r, F.col(c)))
    g = returns.groupBy("as_of").agg(
        round_even(at("KR", "ret_3m") - at("US", "ret_3m"), 1).alias("d3"),
        round_even(at("KR", "ret_6m") - at("US", "ret_6m"), 1).alias("d6"),
    ).where(F.col("d3").isNotNull() & F.col("d6").isNotNull())
    label = F.when((F.col("d3") > 2) & (F.col("d6") > 0), "KR").when((F.col("d3") < -2) & (F.col("d6") < 0), "US").otherwise("neutral")
    return g.withColumn("tilt", label)


def direction(asofs: DataFrame, dual: DataFrame, trend: DataFrame, mood: DataFrame, vol: DataFrame, stance: DataFrame | None = None) -> DataFrame:
    """Composite stance per as-of date.

    ``trend`` is (as_of, above_200d) per index, ``mood`` (as_of, region, score),
    ``vol`` (as_of, exposure_pct), ``stance`` optionally (as_of, region, stance).
    An absent input simply adds no points.
    """
    share = trend.where(F.col("above_200d").isNotNull()).groupBy("as_of").agg(F.avg(F.col("above_200d").cast("double")).alias("_frac"))
    mean = mood.groupBy("as_of").agg(F.avg("score").alias("_mood"))
    df = asofs.select("as_of").distinct()
    for side in (dual.select("as_of", "equities_win"), share, mean, vol.select("as_of", "exposure_pct")):
        df = df.join(side, "as_of", "left")
    points = F.lit(0)
    if stance is not None:
        # Points per stance.
        table = F.create_map(*[F.lit(x) for kv in {"Stable": 3, "Caution": -4, "Risk-off": -10}.items() for x in kv])
        side = stance.groupBy("as_of").agg(F.sum(F.try_element_at(table, F.col("stance"))).alias("_stance"))
        df = df.join(side, "as_of", "left")
        points = F.coalesce(F.col("_stance"), F.lit(0))
    e = F.col("exposure_pct")
    known = F.col("equities_win").isNotNull() | F.col("_frac").isNotNull() | F.col("_mood").isNotNull() | e.isNotNull()
    score = clip(
        50.0
        + F.when(F.col("equities_win"), 15).when(~F.col("equities_win"), -15).otherwise(0)
        + F.coalesce((F.col("_frac") - 0.5) * 30, F.lit(0.0))
        + F.coalesce((F.col("_mood") - 50) * 0.3, F.lit(0.0))
        + points
        + F.when(e < 50, -8).when(e > 90, 4).otherwise(0),
        0, 100,
    )
    df = df.where(known).withColumn("_s", score)
    s = F.col("_s")
    mult = F.when(s >= 60, 1.0).when(s >= 45, 0.8).otherwise(0.5)
    equity = round_even(F.coalesce(e, F.lit(70)) * mult / 5, 0) * 5
    equity = F.least(F.greatest(equity, F.lit(10.0)), F.lit(100.0)).cast("int")
    return df.select(
        "as_of", round_even(s, 0).cast("int").alias("score"),
        F.when(s >= 60, "add risk").when(s >= 45, "hold").otherwise("defend").alias("stance"),
        equity.alias("equity_pct"), (100 - equity).alias("cash_pct"),
    )


def factor_excess(styles: DataFrame, benchmark: DataFrame, on: list[str]) -> DataFrame:
    """1, 3 and 6-month return of each style over the benchmark's own, latest row first by 3M.

    ``styles`` is (entity, ts, close, ...) and ``benchmark`` (ts, bench[, keys]).
    """
    group = [k for k in on if k != "ts"]
    bw = Window.partitionBy(*(group or [F.lit(0)])).orderBy("ts")
    spans = {"ex_1m_pct": 21, "ex_3m_pct": 63, "ex_6m_pct": 126}
    last = lambda df, w: df.withColumn("_next", F.lead("ts").over(w)).where(F.col("_next").isNull()).drop("_next")
    sw = Window.partitionBy("entity").orderBy("ts")
    s = last(styles.select("*", *[trailing_return("close", k).alias(f"_s_{n}") for n, k in spans.items()]), sw)
    b = last(benchmark.select(*on, *[(pct_change("bench", k, bw) * 100).alias(f"_b_{n}") for n, k in spans.items()]), bw).drop("ts")
    if group:
        df = s.join(b, group, "left")
    else:
        df = s.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one", "left")
    df = df.select("entity", *group, *[round_even(F.col(f"_s_{n}") - F.col(f"_b_{n}"), 1).alias(n) for n in spans])
    return df.dropna(how="all", subset=list(spans)).orderBy(F.col("ex_3m_pct").desc_nulls_last(), "entity")
