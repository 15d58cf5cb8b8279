"""Cross-sectional scoring over (as_of, region).

Group statistics are partial aggregates joined back to the rows, and ranks use
the split-rank primitive, so no region, sector or date is ever held by one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percentile_rank
from ..functions.stats import TRADING_DAYS, change, clip, present, ratio, round_even, row_mean
from ..functions.timewin import back, with_position
from ..session import cut_lineage

# Fixed values.
FACTOR_WEIGHTS = {"momentum": 0.30, "value": 0.25, "quality": 0.25, "lowvol": 0.20}
SOURCE_QUALITY = {"momentum": 1.0, "value": 0.6, "quality": 0.6, "lowvol": 1.0}
LEVERAGE_EXEMPT = ["Financials", "Utilities", "Real Estate", "Holding"]
VALUE_INPUTS = ["earnings_yield", "fwd_earnings_yield", "book_yield", "fcf_yield"]
QUALITY_INPUTS = ["roe", "op_margin", "profit_margin", "earnings_growth", "debt_to_equity"]
WINSOR = 2.5
MIN_SECTOR = 4
MIN_VALUES = 3
MIN_REGION = 5

GROUP = ["as_of", "region"]


# ------------------------------------------------------------------ z-scores
def _z(c: Column, mean: Column, sd: Column, n: Column, winsor: float) -> Column:
    unit = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return F.when(n >= MIN_VALUES, clip((c - mean) / unit, -winsor, winsor))


def _group_stats(df: DataFrame, keys: list[str], columns: list[str], tag: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(f"_{tag}_members")]
    for c in columns:
        aggs += [
            F.avg(c).alias(f"_{tag}_m_{c}"),
            F.stddev_pop(c).alias(f"_{tag}_s_{c}"),
            F.count(c).alias(f"_{tag}_n_{c}"),
        ]
    return df.groupBy(*keys).agg(*aggs)


def _scored(c: str, tag: str, winsor: float) -> Column:
    return _z(F.col(c), F.col(f"_{tag}_m_{c}"), F.col(f"_{tag}_s_{c}"), F.col(f"_{tag}_n_{c}"), winsor)


def zscore(df: DataFrame, columns: list[str], keys: list[str] = GROUP, suffix: str = "_z", winsor: float = WINSOR) -> DataFrame:
    """Winsorised z per group (population deviation, at least three values)."""
    out = df.join(_group_stats(df, keys, columns, "g"), keys, "left")
    out = out.select(*df.columns, *[_scored(c, "g", winsor).alias(c + suffix) for c in columns])
    return out


def sector_neutral_z(
    df: DataFrame, columns: list[str], keys: list[str] = GROUP, sector: str = "sector",
    suffix: str = "_z", winsor: float = WINSOR,
) -> DataFrame:
    """z within the sector where it has four members and three values, else region-wide.

    Members are counted whether or not the value is known; an unknown sector
    always reads region-wide.
    """
    wide = _group_stats(df, keys, columns, "g")
    narrow = _group_stats(df.where(F.col(sector).isNotNull()), [*keys, sector], columns, "s")
    out = df.join(wide, keys, "left").join(narrow, [*keys, sector], "left")
    scores = []
    for c in columns:
        local = (F.col("_s_members") >= MIN_SECTOR) & (F.col(f"_s_n_{c}") >= MIN_VALUES)
        scores.append(
            F.when(local, _scored(c, "s", winsor)).otherwise(_scored(c, "g", winsor)).alias(c + suffix)
        )
    return out.select(*df.columns, *scores)


# -------------------------------------------------------------- price inputs
def price_inputs(bars: DataFrame) -> DataFrame:
    """12-1 and 6-month momentum per row; offsets are in rows of known closes.

    12-1 needs 273 rows and compares lag 20 with lag 251; 6-month needs 126
    rows and compares with lag 125.
    """
    df = with_position(bars.where(F.col("close").isNotNull()))
    return df.select(
        "*",
        F.when(F.col("pos") >= 273, change(back("close", 20), back("close", 251))).alias("mom_12_1"),
        F.when(F.col("pos") >= 126, change("close", back("close", 125))).alias("mom_6m"),
    )


def trailing_frames(df: DataFrame, anchors: DataFrame, rows: int = TRADING_DAYS) -> DataFrame:
    """Each row of ``df`` once per anchor whose last ``rows`` rows contain it.

    ``anchors`` is (entity, ts, as_of) and need not fall on a row of ``df``.  A
    row finds its anchors by position inside the entity's own partition: work
    is rows x (anchors per frame), twelve for month ends over a year, and the
    aggregation that follows needs no further exchange.
    """
    cols = [c for c in df.columns if c not in ("entity", "ts")]
    data = df.withColumns({"as_of": F.lit(None).cast("date"), "_data": F.lit(1)})
    marks = anchors.select("entity", "ts", "as_of", F.lit(0).alias("_data"))
    both = data.unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("entity").orderBy("ts", F.col("_data").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_at", F.sum("_data").over(upto))
    ahead = Window.partitionBy("entity").orderBy("_at").rangeBetween(0, rows - 1)
    mark = F.when(F.col("_data") == 0, F.struct("as_of", "ts"))
    both = both.withColumn("_for", F.collect_list(mark).over(ahead))
    spread = both.where(F.col("_data") == 1).select("entity", *cols, F.explode("_for").alias("_a"))
    return spread.select("entity", F.col("_a.as_of").alias("as_of"), F.col("_a.ts").alias("anchor_ts"), *cols)


def trailing_risk(bars: DataFrame, anchors: DataFrame, rows: int = TRADING_DAYS) -> DataFrame:
    """Volatility, downside deviation and CVaR of the last 252 returns at each anchor."""
    df = bars.where(F.col("close").isNotNull()).select("entity", "ts", change("close", back("close", 1)).alias("r"))
    spread = trailing_frames(df.where(F.col("r").isNotNull()), anchors, rows)
    scale = F.sqrt(F.lit(float(TRADING_DAYS)))
    n = F.count("r")
    neg = F.when(F.col("r") < 0, F.col("r") * F.col("r"))
    out = spread.groupBy("entity", "as_of").agg(
        F.when(n >= 60, F.stddev_samp("r") * scale).alias("vol252"),
        F.when(F.count(neg) >= 20, F.sqrt(F.avg(neg)) * scale).alias("downside_vol"),
        F.when(n >= 60, F.percentile("r", F.lit(0.05))).alias("_var"),
        F.sort_array(F.collect_list("r")).alias("_r"),
    )
    tail = F.filter("_r", lambda x: x <= F.col("_var"))
    total = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x)
    cvar = F.when(F.col("_var").isNotNull(), -F.try_divide(total, F.size(tail).cast("double")) * 100)
    return out.withColumn("cvar95", cvar).drop("_var", "_r")


def trailing_beta(bars: DataFrame, benchmark: DataFrame, on: list[str], anchors: DataFrame, rows: int = TRADING_DAYS) -> DataFrame:
    """Beta over the last 252 dates on which both returns exist (at least 60).

    Each return is taken on its own series' calendar before the dates are matched.
    """
    group = [k for k in on if k != "ts"]
    a = bars.where(F.col("close").isNotNull()).select("entity", *on, change("close", back("close", 1)).alias("r"))
    bw = Window.partitionBy(*group).orderBy("ts") if group else Window.partitionBy(F.lit(0)).orderBy("ts")
    b = benchmark.where(F.col("bench").isNotNull()).select(*on, change("bench", F.lag("bench").over(bw)).alias("b"))
    pair = a.join(b, on).where(F.col("r").isNotNull() & F.col("b").isNotNull()).select("entity", "ts", "r", "b")
    spread = trailing_frames(pair, anchors, rows)
    return spread.groupBy("entity", "as_of").agg(
        F.when(F.count("r") >= 60, F.try_divide(F.covar_samp("r", "b"), F.nullif(F.var_samp("b"), F.lit(0.0)))).alias("beta")
    )


# ------------------------------------------------------------------- scoring
def factor_sleeves(xsec: DataFrame) -> DataFrame:
    """Momentum, value, quality and low-volatility sleeves from sector-neutral z-scores.

    Leverage counts against quality except in sectors that carry it by nature.
    """
    df = xsec.withColumns(
        {
            "_lev": F.when(F.col("sector").isNull() | ~F.col("sector").isin(*LEVERAGE_EXEMPT), -F.col("debt_to_equity")),
            "_low": -F.col("vol252"),
        }
    )
    raw = ["mom_12_1", "mom_6m", *VALUE_INPUTS, "roe", "op_margin", "profit_margin", "earnings_growth", "_lev", "_low"]
    df = sector_neutral_z(df, raw)
    z = lambda *cs: [F.col(f"{c}_z") for c in cs]
    return df.withColumns(
        {
            "momentum": row_mean(*z("mom_12_1", "mom_6m")),
            "value": row_mean(*z(*VALUE_INPUTS)),
            "quality": row_mean(*z("roe", "op_margin", "profit_margin", "earnings_growth", "_lev")),
            "lowvol": F.col("_low_z"),
        }
    ).drop("_lev", "_low", *[f"{c}_z" for c in raw])


def evidence(xsec: DataFrame) -> DataFrame:
    """Financial completeness, factor coverage, source quality and their blend in [0, 1]."""
    sleeves = list(FACTOR_WEIGHTS)
    have = present(*sleeves)
    quality = sum(
        (F.when(F.col(s).isNotNull(), F.lit(SOURCE_QUALITY[s])).otherwise(0.0) for s in sleeves[1:]),
        F.when(F.col(sleeves[0]).isNotNull(), F.lit(SOURCE_QUALITY[sleeves[0]])).otherwise(0.0),
    )
    inputs = VALUE_INPUTS + QUALITY_INPUTS
    df = xsec.withColumns(
        {
            "sleeves_present": have,
            "financial_coverage": present(*inputs) / F.lit(float(len(inputs))),
            "factor_coverage": have / F.lit(float(len(sleeves))),
            "source_quality": F.coalesce(ratio(quality, have.cast("double")), F.lit(0.0)),
        }
    )
    blend = 0.5 * F.col("factor_coverage") + 0.3 * F.col("financial_coverage") + 0.2 * F.col("source_quality")
    return df.withColumn("evidence", clip(blend, 0.0, 1.0))


def alpha(xsec: DataFrame) -> DataFrame:
    """Sleeve blend renormalised over what is present, shrunk by the evidence."""
    total = F.lit(0.0)
    weight = F.lit(0.0)
    for s, w in FACTOR_WEIGHTS.items():
        total = total + F.coalesce(F.col(s), F.lit(0.0)) * w
        weight = weight + F.when(F.col(s).isNotNull(), F.lit(w)).otherwise(0.0)
    df = xsec.withColumn("raw_alpha", ratio(total, F.nullif(weight, F.lit(0.0))))
    return df.withColumn("alpha", F.col("raw_alpha") * F.col("evidence"))


def value_trap() -> Column:
    """Cheap, weak quality, and no free cash flow or shrinking earnings."""
    z = F.lit(0.0)
    return F.coalesce(
        (F.col("value") > 0.5)
        & (F.col("quality") < -0.3)
        & ((F.coalesce(F.col("fcf_yield"), z) <= 0) | (F.coalesce(F.col("earnings_growth"), z) < 0)),
        F.lit(False),
    )


def score_cross_section(xsec: DataFrame, min_sleeves: int = 3, min_financial: float = 0.4) -> DataFrame:
    """Inputs per (as_of, region, entity) to alpha, flags and data sufficiency.

    Regions with fewer than five candidates, or fewer than five scored names,
    are dropped for that date.  The sleeves are written out once: every later
    step reads group statistics of them and the rows again.
    """
    df = cut_lineage(factor_sleeves(enough(xsec)), "sleeves")
    df = alpha(evidence(df))
    df = df.withColumns(
        {
            "value_trap": value_trap(),
            "data_insufficient": (F.col("sleeves_present") < min_sleeves)
            | (round_even("financial_coverage", 3) < min_financial),
        }
    ).where(F.col("alpha").isNotNull())
    return enough(df)


def enough(df: DataFrame, n: int = MIN_REGION, keys: list[str] = GROUP) -> DataFrame:
    """Drop groups with fewer than n rows."""
    keep = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(keep, keys, "left_semi")


def research_view(insufficient: Column, pct: Column) -> Column:
    return (
        F.when(insufficient, "DATA_INSUFFICIENT")
        .when(pct >= 66, "POSITIVE")
        .when(pct <= 33, "NEGATIVE")
        .otherwise("NEUTRAL")
    )


def research_rows(scored: DataFrame) -> DataFrame:
    """Published research rows: alpha, percentiles, view, coverage and risk block."""
    df = percentile_rank(scored, GROUP, ["alpha", *FACTOR_WEIGHTS])
    r = lambda c, d: round_even(c, d)
    return df.select(
        *GROUP, "entity", "sector", *[c for c in ("ts",) if c in df.columns],
        r("alpha", 3).alias("alpha"),
        r("raw_alpha", 3).alias("raw_alpha"),
        F.col("alpha_pct").cast("int").alias("alpha_percentile"),
        research_view(F.col("data_insufficient"), F.col("alpha_pct")).alias("view"),
        r("factor_coverage", 3).alias("evidence_coverage"),
        r("financial_coverage", 3).alias("data_completeness"),
        r("source_quality", 3).alias("source_quality"),
        "sleeves_present", "value_trap", "data_insufficient",
        *[F.col(f"{s}_pct").cast("int").alias(f"{s}_percentile") for s in FACTOR_WEIGHTS],
        r(F.col("vol252") * 100, 1).alias("vol252_pct"),
        r(F.col("downside_vol") * 100, 1).alias("downside_vol_pct"),
        r("cvar95", 2).alias("cvar95_pct"),
        r("max_dd_252", 1).alias("max_dd252_pct"),
        r("beta", 2).alias("beta"),
        r(F.col("mom_12_1") * 100, 1).alias("mom_12_1_pct"),
        "above_ma200", "regime",
        F.col("alpha").alias("alpha_exact"), "downside_vol", "vol252",
    )


# --------------------------------------------------------------- entry timing
def overheat_score() -> Column:
    """Mean of the available stretch measures of the (rounded) entry readings."""
    return row_mean(
        (F.col("rsi14") - 50) / 25.0,
        F.col("dist200_pct") / 20.0,
        (F.col("vol_spike") - 1.0) * 1.5,
        F.col("mom60_pct") / 40.0,
    )


def overheat(entry: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Overheat score and its exact percentile within the region's cross-section."""
    df = entry.withColumn("overheat", overheat_score())
    return percentile_rank(df, keys, ["overheat"], digits=None)


def entry_state(df: DataFrame) -> DataFrame:
    """Worst-first ladder of entry states with reason codes.

    Zero and missing readings are equally harmless here, hence the coalesces.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mom, dist, rsi = z("mom60_pct"), z("dist200_pct"), z("rsi14")
    broken = ~F.col("above_ma200") & ~F.col("above_ma50") & (mom < 0)
    earnings = F.coalesce(F.col("earnings_in_days").between(0, 7), F.lit(False))
    violent = (z("vol_spike") >= 1.6) & ((z("gap_down_pct") <= -4) | (z("max_adverse_pct") <= -6))
    hot = F.coalesce(F.col("overheat_pct") >= 85, F.lit(False)) | (rsi >= 78) | (dist >= 25)
    clean = F.col("above_ma50") & F.col("above_ma200") & (mom > -5)
    some = lambda *items: F.filter(F.array(*items), lambda x: x.isNotNull())
    reasons = (
        F.when(broken, some(F.lit("broken_trend")))
        .when(earnings, some(F.lit("earnings_near")))
        .when(violent, some(F.lit("volatility_and_gap")))
        .when(
            hot,
            some(
                F.when(F.col("overheat_pct").isNotNull(), F.lit("hot_versus_peers")),
                F.when(dist >= 25, F.lit("stretched_above_ma200")),
                F.when(rsi >= 78, F.lit("rsi_overbought")),
            ),
        )
        .when(clean, some(F.lit("trend_confirmed")))
        .when(~F.col("above_ma50"), some(F.lit("below_ma50")))
        .otherwise(some(F.lit("trend_mixed")))
    )
    state = (
        F.when(broken, "AVOID")
        .when(earnings | violent, "EVENT_RISK")
        .when(hot, "WAIT_FOR_PULLBACK")
        .when(clean, "ACCUMULATE_GRADUALLY")
        .otherwise("WATCH")
    )
    return df.withColumns(
        {"entry_state": state, "entry_reasons": reasons, "overheat_percentile": round_even("overheat_pct", 0)}
    )


def attach_entry(rows: DataFrame, entry: DataFrame, keys: list[str] = ("as_of", "region", "entity")) -> DataFrame:
    """Research rows with their entry state; WATCH where no price reading exists."""
    states = entry.select(*keys, "entry_state", "entry_reasons", "overheat_percentile")
    df = rows.join(states, list(keys), "left")
    missing = F.col("entry_state").isNull()
    return df.withColumns(
        {
            "entry_reasons": F.when(missing, F.array(F.lit("no_price_reading"))).otherwise(F.col("entry_reasons")),
            "entry_state": F.coalesce("entry_state", F.lit("WATCH")),
        }
    )


def concentration_overlay(picks: DataFrame, exposure: DataFrame, cap_pct: float = 30.0) -> DataFrame:
    """Demote a clean add to WATCH where the sleeve already holds cap_pct of the sector."""
    label = F.coalesce("sector", F.lit("Unclassified"))
    side = exposure.select(*GROUP, F.col("sector").alias("_label"), "exposure_pct")
    df = picks.withColumn("_label", label).join(side, [*GROUP, "_label"], "left").drop("_label")
    heavy = (F.col("exposure_pct") >= cap_pct) & (F.col("entry_state") == "ACCUMULATE_GRADUALLY")
    heavy = F.coalesce(heavy & F.col("sector").isNotNull(), F.lit(False))
    return df.withColumns(
        {
            "entry_reasons": F.when(heavy, F.concat("entry_reasons", F.array(F.lit("sector_concentration")))).otherwise(F.col("entry_reasons")),
            "entry_state": F.when(heavy, "WATCH").otherwise(F.col("entry_state")),
        }
    )
