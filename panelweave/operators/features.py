"""Per-entity feature engineering over the long bar panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import TRADING_DAYS, change, ratio
from ..functions.timewin import (
    axis, back, ewm_mean, ffill, pct_change, roll_max, roll_mean, roll_min, roll_std,
    with_blocks,
)

# Daily series that are public the same day and may become features.
SAME_DAY_PUBLIC = [
    "Treasury_10Y", "Treasury_2Y", "Yield_Curve", "FedFunds", "HY_Spread", "IG_Spread",
    "Real_10Y", "Breakeven_10Y", "Broad_Dollar", "WTI", "USD_KRW", "Korea_10Y", "Korea_3M", "RRP",
]
# What a whole absent series is replaced by.
NEUTRAL = {"vix": 20.0, "Treasury_10Y": 3.0, "Yield_Curve": 0.5, "rel_ratio": 1.0, "rel_momentum": 0.0}

MA_PERIODS = (5, 10, 20, 50, 100, 200)
VOL_PERIODS = (5, 10, 20, 60)
MOMENTUM_PERIODS = (5, 10, 20, 60)
RSI_PERIODS = (14, 28)


# ------------------------------------------------------------ exogenous inputs
def pit_allowlist(macro: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Point-in-time guard: only same-day-public daily series may become features."""
    return macro.where(F.col("indicator").isin(allowed or SAME_DAY_PUBLIC))


def align_ffill(bars: DataFrame, series: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Exact-date left join to the entity's own calendar, then forward fill.

    This is not an as-of join: an observation on a date the entity has no bar
    for is lost.
    """
    joined = bars.join(series.select(*on, *columns), on, "left")
    for c in columns:
        joined = joined.withColumn(c, ffill(c))
    return joined


def lag_exog(df: DataFrame, columns: list[str], rows: int = 1) -> DataFrame:
    """Publication lag of aligned exogenous columns, in rows of the entity."""
    for c in columns:
        df = df.withColumn(c, back(c, rows))
    return df


def with_macro(bars: DataFrame, macro: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Allowed daily series as columns: aligned, forward filled, one row late.

    A series without a single observation gets no column, so that it is absent for what follows.
    Of several values for a date the largest counts.
    """
    usable = pit_allowlist(macro, allowed).where(F.col("value").isNotNull())
    found = {r[0] for r in usable.select("indicator").distinct().collect()}  # at most the allow-list
    names = [n for n in allowed or SAME_DAY_PUBLIC if n in found]
    if not names:
        return bars
    wide = usable.groupBy(F.col("obs_date").alias("ts")).pivot("indicator", names).agg(F.max("value"))
    return lag_exog(align_ffill(bars, wide, ["ts"], names), names, 1)


def with_benchmark(bars: DataFrame, closes: DataFrame, routing: dict[str, str]) -> DataFrame:
    """Attach each region's benchmark close; the benchmark itself gets none.

    ``closes`` holds (entity, ts, close); ``routing`` maps region to benchmark entity.
    """
    target = F.create_map(*[F.lit(x) for kv in routing.items() for x in kv])
    side = closes.where(F.col("entity").isin(*routing.values())).select(
        F.col("entity").alias("_bench"), "ts", F.col("close").alias("bench")
    )
    routed = bars.withColumn("_bench", F.element_at(target, F.col("region"))).withColumn(
        "_bench", F.when(F.col("_bench") != F.col("entity"), F.col("_bench"))
    )
    return routed.join(side, ["_bench", "ts"], "left").drop("_bench").withColumn("bench", ffill("bench"))


def with_neutral_defaults(df: DataFrame) -> DataFrame:
    """Constants for exogenous columns the panel lacks altogether (never per row)."""
    for name in ("vix", "Treasury_10Y", "Yield_Curve"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(NEUTRAL[name]))
    return df


# ------------------------------------------------------------------- features
def returns(df: DataFrame) -> DataFrame:
    """Simple returns pad interior gaps in close; log returns do not."""
    df = df.withColumn("_px", ffill("close"))
    return df.select(
        "*",
        pct_change("_px").alias("returns"),
        F.ln(ratio("close", back("close", 1))).alias("log_returns"),
        ratio("high", "low").alias("high_low_ratio"),
        ratio("close", "open").alias("close_open_ratio"),
    ).drop("_px")


def moving_averages(df: DataFrame, periods=MA_PERIODS) -> DataFrame:
    df = df.select("*", *[roll_mean("close", n).alias(f"ma{n}") for n in periods])
    return df.select("*", *[ratio("close", f"ma{n}").alias(f"ma{n}_ratio") for n in periods])


def rolling_vol(df: DataFrame, periods=VOL_PERIODS) -> DataFrame:
    scale = F.sqrt(F.lit(float(TRADING_DAYS)))
    return df.select("*", *[(roll_std("returns", n) * scale).alias(f"volatility_{n}d") for n in periods])


def volume_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("volume_ratio", ratio("volume", roll_mean("volume", n)))


def momentum(df: DataFrame, periods=MOMENTUM_PERIODS) -> DataFrame:
    df = df.withColumn("_px", ffill("close"))
    return df.select("*", *[pct_change("_px", n).alias(f"momentum_{n}d") for n in periods]).drop("_px")


def rsi(df: DataFrame, periods=RSI_PERIODS) -> DataFrame:
    """Simple-mean RSI; a missing step counts as no move, all-gain reads 100."""
    step = F.coalesce(F.col("close") - back("close", 1), F.lit(0.0))
    df = df.withColumn("_gain", F.greatest(step, F.lit(0.0))).withColumn(
        "_loss", F.greatest(-step, F.lit(0.0))
    )
    out = []
    for n in periods:
        gain, loss = roll_mean("_gain", n), roll_mean("_loss", n)
        out.append(
            F.when(loss > 0, 100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
            .when(gain > 0, 100.0)
            .alias(f"rsi_{n}")
        )
    return df.select("*", *out).drop("_gain", "_loss")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ewm_mean(with_blocks(df), {"_fast": ("close", fast), "_slow": ("close", slow)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ewm_mean(df, {"macd_signal": ("macd", signal)})
    return df.withColumn("macd_diff", F.col("macd") - F.col("macd_signal")).drop(
        "_fast", "_slow", "_slot", "_blk", "pos"
    )


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    df = df.withColumn("_mid", roll_mean("close", n)).withColumn("_band", roll_std("close", n) * k)
    return df.select(
        "*",
        ratio(2 * F.col("_band"), "_mid").alias("bb_width"),
        ratio(F.col("close") - (F.col("_mid") - F.col("_band")), 2 * F.col("_band")).alias("bb_position"),
    ).drop("_mid", "_band")


def vix_features(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        ratio("vix", roll_mean("vix", 20)).alias("vix_ratio"),
        pct_change("vix").alias("vix_change"),
        ratio("vix", roll_mean("vix", 60)).alias("vix_short_long"),
    )


def relative_strength(df: DataFrame, n: int = 20) -> DataFrame:
    """Close relative to the benchmark and its momentum; neutral when there is none."""
    if "bench" not in df.columns:
        return df.withColumn("rel_ratio", F.lit(NEUTRAL["rel_ratio"])).withColumn(
            "rel_momentum", F.lit(NEUTRAL["rel_momentum"])
        )
    df = df.withColumn("rel_ratio", ratio("close", "bench")).withColumn("_rel", ffill("rel_ratio"))
    return df.withColumn("rel_momentum", pct_change("_rel", n)).drop("_rel")


def macro_stress(df: DataFrame) -> DataFrame:
    curve = F.col("Yield_Curve")
    return df.select(
        "*",
        ratio("Treasury_10Y", roll_mean("Treasury_10Y", 60)).alias("treasury_stress"),
        (curve - back("Yield_Curve", 20)).alias("yield_curve_change"),
        (
            F.col("vix_ratio") * 0.4
            + F.col("vix_short_long") * 0.3
            + ratio(F.lit(1.0), curve + 2) * 0.3
        ).alias("risk_score"),
    )


def trend_position(df: DataFrame, n: int = 252) -> DataFrame:
    return df.select(
        "*",
        ratio("ma50", "ma200").alias("ma50_ma200"),
        ratio("close", roll_max("close", n)).alias("price_52w_high"),
        ratio("close", roll_min("close", n)).alias("price_52w_low"),
    )


def calendar_features(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.month("ts").alias("month"),
        F.weekday("ts").alias("day_of_week"),
        F.quarter("ts").alias("quarter"),
    )


def build_features(
    bars: DataFrame,
    benchmark: DataFrame | None = None,
    vix: DataFrame | None = None,
    macro: DataFrame | None = None,
    macro_columns: list[str] | None = None,
) -> DataFrame:
    """The full feature panel.

    ``benchmark`` has (ts, bench) and optionally region; ``vix`` has (ts, vix);
    ``macro`` is long (indicator, obs_date, value).
    """
    df = bars
    if benchmark is not None:
        on = [k for k in ("region", "ts") if k in benchmark.columns]
        df = align_ffill(df, benchmark, on, ["bench"])
    if vix is not None:
        df = align_ffill(df, vix, ["ts"], ["vix"])
    if macro is not None:
        df = with_macro(df, macro, macro_columns)
    df = with_neutral_defaults(df)
    df = returns(df)
    df = moving_averages(df)
    df = rolling_vol(df)
    df = volume_ratio(df)
    df = momentum(df)
    df = rsi(df)
    df = macd(df)
    df = bollinger(df)
    df = vix_features(df)
    df = relative_strength(df)
    df = macro_stress(df)
    df = trend_position(df)
    df = calendar_features(df)
    return df.drop("bench")


def add_targets(df: DataFrame, horizons=(10, 21, 63, 126)) -> DataFrame:
    """Forward return per horizon and whether it is positive; the tail stays null."""
    out = []
    for h in horizons:
        fwd = change(F.lead("close", h).over(axis()), "close")
        out.append(fwd.alias(f"forward_return_{h}d"))
    df = df.select("*", *out)
    return df.select(
        "*",
        *[
            (F.col(f"forward_return_{h}d") > 0).cast("double").alias(f"target_{h}d")
            for h in horizons
        ],
    )


# ------------------------------------------------------------ column selection
_RAW = {"open", "high", "low", "close", "volume", "vix"}
_KEYS = {"entity", "ts", "region", "sector", "as_of", "pos"}


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: everything but keys, raw bars, forward returns and targets."""
    return [
        c for c in df.columns
        if c not in _RAW | _KEYS and not c.startswith(("forward_return", "target_"))
    ]


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def min_history(df: DataFrame, n: int, key: str = "entity") -> DataFrame:
    """Keep entities with at least n rows (counted by partial aggregation)."""
    enough = df.groupBy(key).count().where(F.col("count") >= n).select(key)
    return df.join(enough, key, "left_semi")
