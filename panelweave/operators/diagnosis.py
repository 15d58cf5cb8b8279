"""Per-entity trend, risk and entry readings, for every date of history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import change, ratio, round_even
from ..functions.timewin import (
    axis, back, ffill, pct_change, roll_mean, rolling_drawdown, trailing, with_position,
)


def carry_forward(df: DataFrame, columns: list[str]) -> DataFrame:
    """As-of view: each column's latest non-null value, independently per column."""
    return df.withColumns({c: ffill(c) for c in columns})


def latest_values(df: DataFrame, columns: list[str], key: str = "entity", ts: str = "ts") -> DataFrame:
    """One row per entity with each column's latest non-null value."""
    return df.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns]
    )


def max_drawdown(df: DataFrame, n: int = 252, out: str = "max_dd") -> DataFrame:
    """Worst percent fall from a running peak inside the last n closes."""
    df = df if "pos" in df.columns else with_position(df)
    return rolling_drawdown(df, "close", n, "_dd").withColumn(out, F.col("_dd") * 100).drop("_dd")


def volume_surge(df: DataFrame, short: int = 5, long: int = 60) -> DataFrame:
    """Mean volume of the last 5 rows over the last 60, two decimals; null before row 60."""
    recent = F.avg("volume").over(trailing(short))
    return df.withColumn("volume_surge", round_even(ratio(recent, F.nullif(roll_mean("volume", long), F.lit(0.0))), 2))


def adverse_moves(df: DataFrame, days: int = 20, gaps: int = 10) -> DataFrame:
    """Worst close-to-close day of the last 20 and worst opening gap of the last 10, in percent."""
    df = df.select("*", pct_change("close").alias("_r"), change("open", back("close", 1)).alias("_g"))
    return df.select(
        "*",
        (F.min("_r").over(trailing(days)) * 100).alias("max_adverse"),
        (F.min("_g").over(trailing(gaps)) * 100).alias("gap_down"),
    ).drop("_r", "_g")


READINGS = ["close", "ma50", "ma200", "volatility_20d", "rsi_14", "rel_momentum", "price_52w_high", "momentum_60d"]


def risk_flags(last_close, ma200, vol_pct, drawdown, rel, rsi):
    """Names of the active risk flags, in fixed order."""
    return F.filter(
        F.array(
            F.when(last_close < ma200, "SMA200"),
            F.when(vol_pct > 30, "Volatility"),
            F.when(drawdown < -15, "Drawdown"),
            F.when(rel < 0, "Relative Strength"),
            F.when(rsi > 75, "RSI"),
        ),
        lambda x: x.isNotNull(),
    )


def diagnose(features: DataFrame) -> DataFrame:
    """Trend regime, risk readings and flags per (entity, ts).

    A reading is the latest non-null value up to that date.  Comparisons use
    exact values; the published readings are rounded half to even.
    """
    df = max_drawdown(features.select(*[c for c in ("entity", "region", "sector", "ts") if c in features.columns], *READINGS))
    df = carry_forward(df, READINGS)
    c, m50, m200 = F.col("close"), F.col("ma50"), F.col("ma200")
    false = F.lit(False)
    above200 = F.coalesce(c > m200, false)
    below200 = F.coalesce(c < m200, false)
    golden = F.coalesce(m50 > m200, false)
    vol = F.col("volatility_20d") * 100
    keep = [k for k in ("entity", "region", "sector", "ts") if k in df.columns]
    return df.select(
        *keep,
        F.when(above200 & golden, "Bull").when(below200 & ~golden, "Bear").otherwise("Transition").alias("regime"),
        round_even(c, 2).alias("last_close"),
        round_even(m50, 2).alias("ma50"),
        round_even(m200, 2).alias("ma200"),
        round_even(vol, 1).alias("realized_vol"),
        round_even("rsi_14", 1).alias("rsi14"),
        round_even("max_dd", 1).alias("max_drawdown_252d"),
        round_even(F.col("rel_momentum") * 100, 1).alias("rel_momentum"),
        round_even(F.col("price_52w_high") * 100, 1).alias("pct_52w_high"),
        F.coalesce(c > m50, false).alias("above_ma50"),
        above200.alias("above_ma200"),
        F.col("momentum_60d").alias("mom60"),
        risk_flags(c, m200, vol, F.col("max_dd"), F.col("rel_momentum"), F.col("rsi_14")).alias("risk_flags"),
    )


ENTRY_READINGS = ["close", "ma20", "ma50", "ma200", "rsi_14", "volatility_20d", "volatility_60d", "momentum_60d"]


def entry_features(features: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    """Entry-timing readings per (entity, ts), rounded as the classifier expects them.

    ``earnings`` optionally holds (entity, ts, earnings_in_days).
    """
    keep = [k for k in ("entity", "region", "sector", "ts") if k in features.columns]
    df = volume_surge(adverse_moves(features))
    df = carry_forward(df, ENTRY_READINGS + ["volume_surge"])
    above = lambda ma: F.coalesce((F.col("close") != 0) & (F.col(ma) != 0) & (F.col("close") > F.col(ma)), F.lit(False))
    vol20, vol60 = F.nullif(F.col("volatility_20d"), F.lit(0.0)), F.col("volatility_60d")
    out = df.select(
        *keep,
        above("ma20").alias("above_ma20"),
        above("ma50").alias("above_ma50"),
        above("ma200").alias("above_ma200"),
        round_even(change(F.nullif(F.col("close"), F.lit(0.0)), F.nullif(F.col("ma200"), F.lit(0.0))) * 100, 1).alias("dist200_pct"),
        round_even("rsi_14", 1).alias("rsi14"),
        round_even(F.col("volatility_20d") * 100, 1).alias("vol20_pct"),
        round_even(F.when(vol60 > 0, ratio(vol20, vol60)), 2).alias("vol_spike"),
        round_even(F.col("momentum_60d") * 100, 1).alias("mom60_pct"),
        round_even("max_adverse", 1).alias("max_adverse_pct"),
        round_even("gap_down", 1).alias("gap_down_pct"),
        "volume_surge",
    )
    if earnings is None:
        return out.withColumn("earnings_in_days", F.lit(None).cast("int"))
    return out.join(earnings.select("entity", "ts", "earnings_in_days"), ["entity", "ts"], "left")


def trailing_return(c: str, k: int, w=None):
    """Percent change over k rows, null when too short or the base is 0."""
    return pct_change(c, k, w) * 100


def trailing_change(c: str, k: int, w=None):
    return F.col(c) - back(c, k, w)


# ------------------------------------------------------------- index summaries
def index_summary(closes: DataFrame, spark_points: int = 63, min_rows: int = 30) -> DataFrame:
    """Market-tape row per entity from its whole close history (needs 30 rows).

    Year-to-date starts from the last close of the prior year, else from the
    first close.  The spark line is the last 63 closes.
    """
    w = axis()
    df = closes.where(F.col("close").isNotNull()).select("entity", "ts", "close")
    df = with_position(df)
    # Only the rows that end up in a spark line are collected.
    left = F.count(F.lit(1)).over(Window.partitionBy("entity")) - F.col("pos")
    df = df.withColumn("_left", left)
    df = df.select(
        "*",
        back("close", 1).alias("_prev"),
        back("close", 21).alias("_m1"),
        F.max("close").over(trailing(252)).alias("_hi"),
        roll_mean("close", 200).alias("_ma200"),
        F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_first"),
        F.collect_list(F.when(F.col("_left") < spark_points, F.col("close")))
        .over(trailing(spark_points))
        .alias("_spark"),
    )
    # Last close of every year, carried into the next one.
    turn = F.when(F.year("ts") != F.year(back("ts", 1)), back("close", 1))
    df = df.withColumn("_turn", turn)
    df = df.withColumn("_base", F.coalesce(ffill("_turn"), F.col("_first")))
    pct = lambda base: round_even(change("close", base) * 100, 2)
    return df.where((F.col("_left") == 0) & (F.col("pos") >= min_rows)).select(
        "entity",
        F.col("ts").alias("as_of"),
        round_even("close", 2).alias("last"),
        pct("_prev").alias("chg_1d_pct"),
        pct("_m1").alias("chg_1m_pct"),
        pct("_base").alias("ytd_pct"),
        pct("_hi").alias("from_52w_high_pct"),
        (F.col("close") >= F.col("_ma200")).alias("above_200d"),
        F.transform("_spark", lambda x: round_even(x, 2)).alias("spark"),
    )


# -------------------------------------------------------------------- rotation
def quadrant(rs_ratio, rs_mom):
    """Leading / Weakening / Improving / Lagging; zero counts as the upper side."""
    return (
        F.when(rs_ratio >= 0, F.when(rs_mom >= 0, "Leading").otherwise("Weakening"))
        .when(rs_ratio < 0, F.when(rs_mom >= 0, "Improving").otherwise("Lagging"))
    )


def rotation(bars: DataFrame, benchmark: DataFrame, on: list[str], mean_rows: int = 63, mom_rows: int = 21) -> DataFrame:
    """Relative-rotation reading of every entity on every date.

    The relative-strength line exists on dates with a benchmark value carried
    forward; it needs more than mean_rows + mom_rows points.
    """
    df = bars.join(benchmark.select(*on, "bench"), on, "left").withColumn("bench", ffill("bench"))
    df = df.withColumns(
        {"ret_1m_pct": round_even(trailing_return("close", 21), 1), "ret_3m_pct": round_even(trailing_return("close", 63), 1)}
    )
    df = df.withColumn("_rs", ratio("close", "bench")).where(F.col("_rs").isNotNull())
    df = with_position(df)
    df = df.withColumns(
        {
            "_ratio": change("_rs", F.nullif(roll_mean("_rs", mean_rows), F.lit(0.0))) * 100,
            "_mom": pct_change("_rs", mom_rows) * 100,
        }
    ).where((F.col("pos") > mean_rows + mom_rows) & F.col("_ratio").isNotNull() & F.col("_mom").isNotNull())
    keep = [k for k in ("entity", "region", "ts") if k in df.columns]
    return df.select(
        *keep,
        round_even("_ratio", 2).alias("rs_ratio"),
        round_even("_mom", 2).alias("rs_mom"),
        quadrant(F.col("_ratio"), F.col("_mom")).alias("quadrant"),
        "ret_1m_pct",
        "ret_3m_pct",
    )


def detail_table(diagnosed: DataFrame) -> DataFrame:
    """Per-entity detail row; momentum is scaled to percent only here."""
    keep = [c for c in ("volume_surge", "model_score") if c in diagnosed.columns]
    return diagnosed.select(
        "entity", "region", F.col("ts").alias("as_of"), "regime", "last_close", "ma50", "ma200", "rsi14",
        "realized_vol", "max_drawdown_252d", "rel_momentum", "pct_52w_high",
        round_even(F.col("mom60") * 100, 1).alias("mom60_pct"), "risk_flags", *keep,
    )
