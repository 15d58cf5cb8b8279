"""Macro regime from release-lagged indicators, for every as-of date at once.

All transforms are causal, so they are computed once per observation with
windows over an indicator's own series (one row per indicator and day, so a
group is bounded by the calendar) and looked up as of each date afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.asof import asof_merge
from ..functions.dates import bday_add
from ..functions.stats import change, dead_band_sign, ratio, round_even

# Indicator, axis, sign, release lag in business days, transform.
REGISTRY = [
    ("CFNAI", "growth", 1, 20, "recent_level_change"),
    ("Payrolls", "growth", 1, 5, "monthly_change_3m_average"),
    ("Unemployment", "growth", -1, 5, "three_month_average_change"),
    ("Initial_Claims", "growth", -1, 5, "four_week_average_change"),
    ("Core_CPI", "inflation", 1, 12, "inflation_rate_yoy_and_3m_annualized"),
    ("Core_PCE", "inflation", 1, 28, "inflation_rate_yoy_and_3m_annualized"),
    ("Breakeven_10Y", "inflation", 1, 1, "recent_level_change"),
    ("WTI", "inflation", 1, 1, "three_month_price_return"),
    ("Fed_Assets", "liquidity", 1, 6, "thirteen_week_growth_rate"),
    ("RRP", "liquidity", -1, 1, "recent_level_change"),
    ("TGA", "liquidity", -1, 3, "recent_level_change"),
    ("M2", "liquidity", 1, 30, "yoy_growth_rate"),
    ("NFCI", "financialConditions", -1, 4, "recent_level_change"),
    ("ANFCI", "financialConditions", -1, 4, "recent_level_change"),
    ("HY_Spread", "financialConditions", -1, 1, "level_zscore_and_recent_change"),
    ("IG_Spread", "financialConditions", -1, 1, "level_zscore_and_recent_change"),
    ("Real_10Y", "financialConditions", -1, 1, "recent_level_change"),
    ("Broad_Dollar", "financialConditions", -1, 1, "recent_level_change"),
    ("VIX", "riskAppetite", -1, 0, "level_zscore_and_recent_change"),
    ("Yield_Curve", "earningsCredit", 1, 0, "level_and_steepening_change"),
]
AXES = ["growth", "inflation", "liquidity", "financialConditions", "riskAppetite", "earningsCredit"]
STALE_DAYS = 120
MIN_CONFIDENCE = 0.34
MIN_DIRECTION = 0.15
# Base equity range per regime.
BUDGET = {
    "Goldilocks": (70, 90),
    "Reflation": (60, 80),
    "Stagflation": (30, 55),
    "Deflation/Slowdown": (25, 50),
    "Transition/Low confidence": (45, 70),
}


def registry(spark: SparkSession, rows=REGISTRY) -> DataFrame:
    """The indicator registry as a dimension table; ``position`` is its order."""
    values = ", ".join(
        f"('{n}', '{a}', {s}, {lag}, '{m}', {i})" for i, (n, a, s, lag, m) in enumerate(rows)
    )
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(indicator, axis, sign, lag_bdays, method, position)")


# ---------------------------------------------------------------- as-of joins
def asof_visible(observed: DataFrame, asofs: DataFrame, visible_from: Column, keys=("indicator",), order="obs_date") -> DataFrame:
    """For each as-of date the newest row already visible, per key.

    Every key asks once per as-of date, which are the rows of the result; nothing is laid out by day.
    """
    dates = asofs.agg(F.sort_array(F.collect_set("as_of"))).scalar()  # calendar-sized
    asks = observed.select(*keys).distinct().withColumn("as_of", F.explode(dates))
    return asof_merge(asks, observed, list(keys), "as_of", visible_from, order)


def asof_release(macro: DataFrame, indicators: DataFrame, asofs: DataFrame) -> DataFrame:
    """Latest published observation per indicator and as-of date (release day included)."""
    df = macro.where(F.col("value").isNotNull()).join(indicators.select("indicator", "lag_bdays"), "indicator")
    return asof_visible(df, asofs, bday_add(F.col("obs_date"), F.col("lag_bdays")))


# ------------------------------------------------------------------ transforms
def by_indicator() -> WindowSpec:
    return Window.partitionBy("indicator").orderBy("obs_date")


def so_far() -> WindowSpec:
    return by_indicator().rowsBetween(Window.unboundedPreceding, 0)


def collapse_repeats(macro: DataFrame) -> DataFrame:
    """Keep value changes only (a forward-filled frame back to its observations)."""
    prev = F.lag("value").over(by_indicator())
    return (
        macro.where(F.col("value").isNotNull())
        .withColumn("_prev", prev)
        .where(F.col("_prev").isNull() | (F.col("value") != F.col("_prev")))
        .drop("_prev")
    )


def _expanding_z(c: str) -> Column:
    n, sd = F.count(c).over(so_far()), F.stddev_pop(c).over(so_far())
    return F.when(n >= 24, F.try_divide(F.col(c) - F.avg(c).over(so_far()), F.nullif(sd, F.lit(0.0))))


def expanding_z(macro: DataFrame) -> DataFrame:
    """z of each value against the history up to it (population deviation, 24 values)."""
    return macro.withColumn("z", _expanding_z("value"))


def _stepped(n: Column, c: str, long_step: int) -> Column:
    """The value a step back: long_step rows in a long series, else up to three."""
    at = lambda k: F.lag(c, k).over(by_indicator())
    return F.when(n > 400, at(long_step)).when(n >= 4, at(3)).when(n == 3, at(2)).when(n == 2, at(1))


def _full_mean(c: str, k: int) -> Column:
    frame = by_indicator().rowsBetween(-(k - 1), 0)
    return F.when(F.count(c).over(frame) == k, F.avg(c).over(frame))


def macro_transform(macro: DataFrame, indicators: DataFrame, collapse: bool = True) -> DataFrame:
    """Per observation: transformed value, change, z, direction by the indicator's method.

    Repeated values carry the reading of the change they repeat.
    """
    df = macro.where(F.col("value").isNotNull()).join(indicators.select("indicator", "method"), "indicator")
    df = df.withColumn("_prev", F.lag("value").over(by_indicator()))
    fresh = F.col("_prev").isNull() | (F.col("value") != F.col("_prev"))
    df = df.withColumn("_fresh", fresh if collapse else F.lit(True)).drop("_prev")

    s = df.where("_fresh").drop("_fresh")
    lag = lambda c, k: F.lag(c, k).over(by_indicator())
    s = s.withColumns(
        {
            "_n": F.count(F.lit(1)).over(so_far()),
            "_diff": F.col("value") - lag("value", 1),
            "_yoy": change("value", lag("value", 12)) * 100,
            "_g13": change("value", lag("value", 13)) * 100,
            "_ann3": (F.pow(ratio("value", lag("value", 3)), 4) - 1) * 100,
            "_m3": _full_mean("value", 3),
            "_m4": _full_mean("value", 4),
            "_zl": _expanding_z("value"),
        }
    )
    s = s.withColumns(
        {
            "_d3": _full_mean("_diff", 3),
            "_zr": _expanding_z("_yoy"),
            "_step21": F.col("value") - _stepped(F.col("_n"), "value", 21),
            "_ret63": change("value", _stepped(F.col("_n"), "value", 63)),
        }
    )
    m = F.col("method")
    cpi = m == "inflation_rate_yoy_and_3m_annualized"
    level = m.isin("level_zscore_and_recent_change", "level_and_steepening_change")
    # Smoothed level and how many rows back its change looks.
    choice = {
        "inflation_rate_yoy_and_3m_annualized": ("_yoy", 3),
        "monthly_change_3m_average": ("_d3", 3),
        "three_month_average_change": ("_m3", 3),
        "four_week_average_change": ("_m4", 4),
        "yoy_growth_rate": ("_yoy", 3),
        "thirteen_week_growth_rate": ("_g13", 4),
    }
    transformed, delta = None, None
    for name, (c, k) in choice.items():
        d = F.col(c) - lag(c, k)
        transformed = F.when(m == name, F.col(c)) if transformed is None else transformed.when(m == name, F.col(c))
        delta = F.when(m == name, d) if delta is None else delta.when(m == name, d)
    price = m == "three_month_price_return"
    s = s.withColumns(
        {
            "transformed": transformed.when(price, F.col("_ret63")).otherwise(F.col("value")),
            "change": delta.when(price, F.col("_ret63")).otherwise(F.col("_step21")),
            "z": F.when(cpi, F.col("_zr")).otherwise(F.col("_zl")),
            "annualized_3m": F.when(cpi, F.col("_ann3")),
        }
    )
    both = (dead_band_sign("z", 0.25) + dead_band_sign("change")) / 2
    s = s.withColumn(
        "direction",
        F.when(cpi, dead_band_sign("change", 0.05))
        .when(level, dead_band_sign(both, 0.25))
        .otherwise(dead_band_sign("change")),
    )
    reading = F.struct("transformed", "change", "z", "annualized_3m", "direction")
    s = s.select("indicator", "obs_date", reading.alias("_r"))
    out = df.join(s, ["indicator", "obs_date"], "left") if collapse else df.join(s, ["indicator", "obs_date"])
    out = out.withColumn("_r", F.last("_r", ignorenulls=True).over(so_far()))
    return out.select("indicator", "obs_date", "value", "_r.*")


def indicator_reads(macro: DataFrame, indicators: DataFrame, asofs: DataFrame) -> DataFrame:
    """The published reading of every indicator on every as-of date."""
    df = macro_transform(macro, indicators).join(
        indicators.select("indicator", "axis", "sign", "lag_bdays", "position"), "indicator"
    )
    seen = asof_visible(df, asofs, bday_add(F.col("obs_date"), F.col("lag_bdays")))
    days = F.datediff("as_of", "obs_date")
    return seen.select(
        "as_of", "indicator", "axis", "sign", "position", "obs_date",
        round_even("value", 4).alias("latest"),
        round_even("transformed", 4).alias("transformed"),
        round_even("change", 4).alias("change"),
        round_even("annualized_3m", 4).alias("annualized_3m"),
        round_even("z", 2).alias("z"),
        "direction",
        (F.col("sign") * F.col("direction")).alias("contribution"),
        days.alias("freshness_days"),
        (days > STALE_DAYS).alias("stale"),
    )


# --------------------------------------------------------------- axes, regime
def axis_summary(reads: DataFrame, indicators: DataFrame, asofs: DataFrame) -> DataFrame:
    """Value, coverage, freshness, agreement and confidence per (as_of, axis).

    Axes without any reading appear with a null value and zero confidence.
    """
    expected = indicators.groupBy("axis").agg(F.count(F.lit(1)).alias("expected"))
    grid = asofs.select("as_of").distinct().withColumn("axis", F.explode(F.array(*[F.lit(a) for a in AXES])))
    got = reads.groupBy("as_of", "axis").agg(
        F.count(F.lit(1)).alias("n_indicators"),
        F.avg(F.when(F.col("contribution") != 0, F.col("contribution"))).alias("_mean"),
        F.count_if(~F.col("stale")).alias("_fresh"),
    )
    df = grid.join(got, ["as_of", "axis"], "left").join(expected, "axis", "left")
    n = F.coalesce("n_indicators", F.lit(0))
    value = F.when(n > 0, F.coalesce("_mean", F.lit(0.0)))
    cover = F.least(F.lit(1.0), ratio(n.cast("double"), F.coalesce("expected", F.lit(3)).cast("double")))
    fresh = F.coalesce(F.try_divide(F.col("_fresh").cast("double"), n.cast("double")), F.lit(0.0))
    agree = F.coalesce(F.abs(value), F.lit(0.0))
    return df.select(
        "as_of", "axis",
        round_even(value, 2).alias("value"),
        F.when(value > MIN_DIRECTION, "positive").when(value < -MIN_DIRECTION, "negative").when(value.isNotNull(), "flat").alias("direction"),
        F.when(n > 0, round_even(cover * fresh * (0.5 + 0.5 * agree), 2)).otherwise(0.0).alias("confidence"),
        round_even(F.when(n > 0, cover).otherwise(0.0), 2).alias("coverage"),
        round_even(fresh, 2).alias("freshness"),
        round_even(agree, 2).alias("agreement"),
        n.alias("n_indicators"),
    )


def regime(axes: DataFrame) -> DataFrame:
    """Regime label and reason per as-of date from the growth and inflation axes.

    Missing axis, then low confidence, then mixed signals, then the quadrant.
    """
    at = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c)))
    df = axes.groupBy("as_of").agg(
        at("growth", "value").alias("growth"), at("inflation", "value").alias("inflation"),
        F.least(F.coalesce(at("growth", "confidence"), F.lit(0.0)), F.coalesce(at("inflation", "confidence"), F.lit(0.0))).alias("confidence"),
        at("financialConditions", "value").alias("financial_conditions"),
        at("riskAppetite", "value").alias("risk_appetite"),
    )
    g, i = F.col("growth"), F.col("inflation")
    g_mixed, i_mixed = F.abs(g) <= MIN_DIRECTION, F.abs(i) <= MIN_DIRECTION
    unsure = g.isNull() | i.isNull() | (F.col("confidence") < MIN_CONFIDENCE) | g_mixed | i_mixed
    up, hot = g >= 0, i >= 0
    label = (
        F.when(unsure, "Transition/Low confidence")
        .when(up & ~hot, "Goldilocks").when(up & hot, "Reflation")
        .when(~up & hot, "Stagflation").otherwise("Deflation/Slowdown")
    )
    reason = (
        F.when(g.isNull() | i.isNull(), "MISSING_AXIS")
        .when(F.col("confidence") < MIN_CONFIDENCE, "LOW_CONFIDENCE")
        .when(g_mixed & i_mixed, "BOTH_AXES_MIXED").when(g_mixed, "GROWTH_MIXED").when(i_mixed, "INFLATION_MIXED")
        .otherwise(F.upper(F.replace(label, F.lit("/"), F.lit("_"))))
    )
    return df.withColumns({"regime": label, "reason": reason})


def regime_evidence(reads: DataFrame, regimes: DataFrame, k: int = 8) -> DataFrame:
    """The first k supporting and contradicting indicators per date, in registry order."""
    df = reads.where(F.col("contribution") != 0).join(regimes.select("as_of", "regime"), "as_of")
    risk_on = F.col("regime").isin("Goldilocks", "Reflation")
    agrees = F.when(risk_on, F.col("contribution") > 0).otherwise(F.col("contribution") < 0)
    df = df.withColumn("side", F.when(agrees, "supporting").otherwise("contradicting"))
    w = Window.partitionBy("as_of", "side").orderBy("position")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(
        "as_of", "side", "place", "indicator", "axis", "direction", "z"
    )


def risk_budget(regimes: DataFrame) -> DataFrame:
    """Equity and cash ranges per date and whether the regime changed.

    One row per as-of date, so ordering the whole history is calendar-bounded.
    """
    lows = F.create_map(*[F.lit(x) for r, (lo, _) in BUDGET.items() for x in (r, lo)])
    highs = F.create_map(*[F.lit(x) for r, (_, hi) in BUDGET.items() for x in (r, hi)])
    fc, ra = F.col("financial_conditions"), F.col("risk_appetite")
    shift = F.when(fc < -0.3, -10).when(fc > 0.3, 5).otherwise(0) + F.when(ra < -0.3, -10).otherwise(0)
    lo = F.greatest(F.lit(10), F.element_at(lows, F.col("regime")) + shift)
    hi = F.greatest(F.lit(20), F.element_at(highs, F.col("regime")) + shift)
    prior = F.lag("regime").over(Window.partitionBy(F.lit(0)).orderBy("as_of"))
    return regimes.select(
        "as_of", "regime", "reason", "confidence", prior.alias("prior_regime"),
        F.coalesce(prior != F.col("regime"), F.lit(False)).alias("changed"),
        lo.alias("equity_low"), hi.alias("equity_high"), (100 - hi).alias("cash_low"), (100 - lo).alias("cash_high"),
    )


def macro_panel(macro: DataFrame, rows: int = 21) -> DataFrame:
    """Display panel: latest value, level change and percent change over 21 observations."""
    df = macro.where(F.col("value").isNotNull())
    base = F.lag("value", rows).over(by_indicator())
    df = df.select("*", (F.col("value") - base).alias("change_21"), (change("value", base) * 100).alias("pct_change_21"), F.lead("obs_date").over(by_indicator()).alias("_next"))
    return df.where(F.col("_next").isNull()).drop("_next")
