"""Macro regime and market-level queries (month-end as-of dates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis as dg
from ..operators import market as mk
from ..operators import regime as rg
from ..session import stage_table
from ..sources import bars as src
from ..sources.macro import melt_macro
from . import views as v
from .catalog import register
from .diagnosis_queries import DIAG, features
from .feature_queries import W, roll

I = "OVER (PARTITION BY indicator ORDER BY obs_date)"
IR = "OVER (PARTITION BY indicator ORDER BY obs_date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{a}', {s}, {lag}, '{m}', {i})" for i, (n, a, s, lag, m) in enumerate(rg.REGISTRY)
) + ") t(indicator, axis, sign, lag_bdays, method, position))"
ASOFS = "asofs AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS as_of FROM orders)"


def bday_sql(d: str, n: str) -> str:
    wd = f"(isodow({d}) - 1)"
    return (f"CASE WHEN {n} = 0 THEN {d} + CAST(CASE WHEN {wd} > 4 THEN 7 - {wd} ELSE 0 END AS INTEGER) ELSE {d} + CAST({n} + 2 * "
            f"((least({wd}, 4) + {n}) // 5) - greatest({wd} - 4, 0) AS INTEGER) END")


def macro(spark, sf):
    return stage_table(spark, f"{sf}/macro", lambda: v.macro(spark, sf))


def asofs(spark, sf):
    return v.table(spark, sf, "orders").select(F.last_day(F.col("o_orderdate").cast("date")).alias("as_of")).distinct()


@register("macro_long", "S3", f"WITH {v.MACRO} --final SELECT * FROM macro", "indicator obs_date", "", "value")
def _(spark, sf):
    return v.macro(spark, sf)


@register(
    "macro_from_wide", "S3", f"WITH {v.MACRO_DAILY} --final SELECT * FROM macro_daily", "indicator obs_date", "", "value",
)
def _(spark, sf):
    wide = v.macro_daily(spark, sf).groupBy("obs_date").pivot("indicator", ["Treasury_10Y", "Treasury_2Y"]).agg(F.first("value"))
    return melt_macro(wide)


@register("collapse_repeats", "W25", f"WITH {v.MACRO} --final SELECT * FROM (SELECT *, lag(value) {I} AS p FROM macro) WHERE p IS NULL OR p <> value", "indicator obs_date", "", "value")
def _(spark, sf):
    return rg.collapse_repeats(macro(spark, sf))


EZ = "CASE WHEN count({c}) {o} >= 24 THEN ({c} - avg({c}) {o}) / nullif(stddev_pop({c}) {o}, 0) END"
UP = IR.format(n="UNBOUNDED")


@register("expanding_z", "W26", f"WITH {v.MACRO} --final SELECT indicator, obs_date, {EZ.format(c='value', o=UP)} AS z FROM macro", "indicator obs_date", "", "z")
def _(spark, sf):
    return rg.expanding_z(macro(spark, sf))


def sgn(e: str, t: float) -> str:
    return f"CASE WHEN {e} IS NULL OR abs({e}) <= {t} THEN 0 ELSE CAST(sign({e}) AS INTEGER) END"


def fm(c: str, k: int) -> str:
    o = IR.format(n=k - 1)
    return f"CASE WHEN count({c}) {o} = {k} THEN avg({c}) {o} END"


def stepped(k: int) -> str:
    return (f"CASE WHEN n > 400 THEN lag(value, {k}) {I} WHEN n >= 4 THEN lag(value, 3) {I} "
            f"WHEN n = 3 THEN lag(value, 2) {I} WHEN n = 2 THEN lag(value, 1) {I} END")


TRANS = f"""{v.MACRO}, {REG},
m0 AS (SELECT m.*, r.method, lag(value) OVER (PARTITION BY m.indicator ORDER BY obs_date) AS prev FROM macro m JOIN reg r ON m.indicator = r.indicator),
s0 AS (SELECT *, count(*) {UP} AS n, value - lag(value) {I} AS diff, (value / lag(value, 12) {I} - 1) * 100 AS yoy, (value / lag(value, 13) {I} - 1) * 100 AS g13,
  (pow(value / lag(value, 3) {I}, 4) - 1) * 100 AS ann3, {fm('value', 3)} AS m3, {fm('value', 4)} AS m4, {EZ.format(c='value', o=UP)} AS zl
  FROM m0 WHERE prev IS NULL OR prev <> value),
s1 AS (SELECT *, {fm('diff', 3)} AS d3, {EZ.format(c='yoy', o=UP)} AS zr, value - ({stepped(21)}) AS st21, value / ({stepped(63)}) - 1 AS ret63 FROM s0),
s2 AS (SELECT *,
  CASE method WHEN 'inflation_rate_yoy_and_3m_annualized' THEN yoy WHEN 'monthly_change_3m_average' THEN d3 WHEN 'three_month_average_change' THEN m3
    WHEN 'four_week_average_change' THEN m4 WHEN 'yoy_growth_rate' THEN yoy WHEN 'thirteen_week_growth_rate' THEN g13 WHEN 'three_month_price_return' THEN ret63 ELSE value END AS transformed,
  CASE method WHEN 'inflation_rate_yoy_and_3m_annualized' THEN yoy - lag(yoy, 3) {I} WHEN 'monthly_change_3m_average' THEN d3 - lag(d3, 3) {I}
    WHEN 'three_month_average_change' THEN m3 - lag(m3, 3) {I} WHEN 'four_week_average_change' THEN m4 - lag(m4, 4) {I} WHEN 'yoy_growth_rate' THEN yoy - lag(yoy, 3) {I}
    WHEN 'thirteen_week_growth_rate' THEN g13 - lag(g13, 4) {I} WHEN 'three_month_price_return' THEN ret63 ELSE st21 END AS change,
  CASE WHEN method = 'inflation_rate_yoy_and_3m_annualized' THEN zr ELSE zl END AS z, CASE WHEN method = 'inflation_rate_yoy_and_3m_annualized' THEN ann3 END AS annualized_3m FROM s1),
s3 AS (SELECT *, CASE WHEN method = 'inflation_rate_yoy_and_3m_annualized' THEN {sgn('change', 0.05)}
  WHEN method IN ('level_zscore_and_recent_change', 'level_and_steepening_change') THEN {sgn(f"((({sgn('z', 0.25)}) + ({sgn('change', 1e-9)})) / 2.0)", 0.25)}
  ELSE {sgn('change', 1e-9)} END AS direction FROM s2),
s4 AS (SELECT indicator, obs_date, transformed, change, z, annualized_3m, direction FROM s3),
tr AS (SELECT m.indicator, m.obs_date, m.value, s.transformed, s.change, s.z, s.annualized_3m, s.direction
  FROM m0 m ASOF JOIN s4 s ON m.indicator = s.indicator AND m.obs_date >= s.obs_date)"""


@register("macro_transforms", "W27 W28", f"WITH {TRANS} --final SELECT * FROM tr", "indicator obs_date", "direction", "value transformed change z annualized_3m")
def _(spark, sf):
    return rg.macro_transform(macro(spark, sf), rg.registry(spark))


# Release-lagged as-of lookup by brute force: every visible row, newest kept.
READS = f"""{TRANS}, {ASOFS},
rl AS (SELECT t.*, r.axis, r.sign, r.position, {bday_sql('t.obs_date', 'r.lag_bdays')} AS release FROM tr t JOIN reg r ON t.indicator = r.indicator),
reads AS (SELECT a.as_of, l.indicator, any_value(axis) AS axis, any_value(position) AS position, max(obs_date) AS obs_date, arg_max(value, obs_date) AS latest,
  arg_max_null(transformed, obs_date) AS transformed, arg_max_null(change, obs_date) AS change, arg_max_null(annualized_3m, obs_date) AS annualized_3m, arg_max_null(z, obs_date) AS z,
  arg_max(direction, obs_date) AS direction, arg_max(direction, obs_date) * any_value(sign) AS contribution, CAST(a.as_of - max(obs_date) AS INTEGER) AS freshness_days,
  a.as_of - max(obs_date) > 120 AS stale FROM asofs a JOIN rl l ON l.release <= a.as_of GROUP BY a.as_of, l.indicator)"""


@register(
    "asof_release_join", "J3", f"WITH {v.MACRO}, {REG}, {ASOFS}, rl AS (SELECT m.*, {bday_sql('m.obs_date', 'r.lag_bdays')} AS release FROM macro m JOIN reg r ON m.indicator = r.indicator) "
    "--final SELECT a.as_of, l.indicator, max(obs_date) AS obs_date, arg_max(value, obs_date) AS value FROM asofs a JOIN rl l ON l.release <= a.as_of GROUP BY 1, 2",
    "as_of indicator obs_date", "", "value",
)
def _(spark, sf):
    return rg.asof_release(macro(spark, sf), rg.registry(spark), asofs(spark, sf))


@register(
    "indicator_reads", "W29 W27", f"WITH {READS} --final SELECT * FROM reads", "as_of indicator axis obs_date stale", "direction contribution freshness_days",
    "latest:4 transformed:4 change:4 annualized_3m:4 z:2",
)
def _(spark, sf):
    return reads(spark, sf)


def reads(spark, sf):
    return rg.indicator_reads(macro(spark, sf), rg.registry(spark), asofs(spark, sf))


AXES = f"""{READS},
ax0 AS (SELECT as_of, axis, count(*) AS n, avg(contribution) FILTER (contribution <> 0) AS mean, count(*) FILTER (NOT stale) AS fresh FROM reads GROUP BY 1, 2),
ax1 AS (SELECT g.as_of, x.axis, x.expected, coalesce(a.n, 0) AS n, CASE WHEN a.n > 0 THEN coalesce(a.mean, 0) END AS val, coalesce(a.fresh / a.n, 0) AS fr
  FROM asofs g CROSS JOIN (SELECT axis, count(*) AS expected FROM reg GROUP BY 1) x LEFT JOIN ax0 a ON a.as_of = g.as_of AND a.axis = x.axis),
axes AS (SELECT as_of, axis, round_even(val, 2) AS value, CASE WHEN val > 0.15 THEN 'positive' WHEN val < -0.15 THEN 'negative' WHEN val IS NOT NULL THEN 'flat' END AS direction,
  CASE WHEN n > 0 THEN round_even(least(1, n / expected) * fr * (0.5 + 0.5 * abs(val)), 2) ELSE 0 END AS confidence, round_even(CASE WHEN n > 0 THEN least(1, n / expected) ELSE 0 END, 2) AS coverage,
  round_even(fr, 2) AS freshness, round_even(coalesce(abs(val), 0), 2) AS agreement, n AS n_indicators FROM ax1)"""


def axes(spark, sf):
    return rg.axis_summary(reads(spark, sf), rg.registry(spark), asofs(spark, sf))


@register("axis_summary", "A3", f"WITH {AXES} --final SELECT * FROM axes", "as_of axis direction", "n_indicators", "value confidence coverage freshness agreement")
def _(spark, sf):
    return axes(spark, sf)


REGIME = f"""{AXES},
g0 AS (SELECT as_of, max(value) FILTER (axis = 'growth') AS g, max(value) FILTER (axis = 'inflation') AS i,
  least(coalesce(max(confidence) FILTER (axis = 'growth'), 0), coalesce(max(confidence) FILTER (axis = 'inflation'), 0)) AS confidence,
  max(value) FILTER (axis = 'financialConditions') AS fc, max(value) FILTER (axis = 'riskAppetite') AS ra FROM axes GROUP BY 1),
rgm AS (SELECT *, CASE WHEN g IS NULL OR i IS NULL OR confidence < 0.34 OR abs(g) <= 0.15 OR abs(i) <= 0.15 THEN 'Transition/Low confidence'
   WHEN g >= 0 AND i < 0 THEN 'Goldilocks' WHEN g >= 0 THEN 'Reflation' WHEN i >= 0 THEN 'Stagflation' ELSE 'Deflation/Slowdown' END AS regime,
  CASE WHEN g IS NULL OR i IS NULL THEN 'MISSING_AXIS' WHEN confidence < 0.34 THEN 'LOW_CONFIDENCE' WHEN abs(g) <= 0.15 AND abs(i) <= 0.15 THEN 'BOTH_AXES_MIXED'
   WHEN abs(g) <= 0.15 THEN 'GROWTH_MIXED' WHEN abs(i) <= 0.15 THEN 'INFLATION_MIXED' WHEN g >= 0 AND i < 0 THEN 'GOLDILOCKS' WHEN g >= 0 THEN 'REFLATION'
   WHEN i >= 0 THEN 'STAGFLATION' ELSE 'DEFLATION_SLOWDOWN' END AS reason FROM g0)"""


@register("regime", "A4", f"WITH {REGIME} --final SELECT as_of, regime, reason, confidence, g AS growth, i AS inflation FROM rgm", "as_of regime reason", "", "confidence growth inflation")
def _(spark, sf):
    return rg.regime(axes(spark, sf))


@register(
    "regime_evidence", "A5",
    f"""WITH {REGIME}, e AS (SELECT r.*, CASE WHEN (g.regime IN ('Goldilocks', 'Reflation') AND contribution > 0) OR (g.regime NOT IN ('Goldilocks', 'Reflation') AND contribution < 0)
      THEN 'supporting' ELSE 'contradicting' END AS side FROM reads r JOIN rgm g USING (as_of) WHERE contribution <> 0)
    --final SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, side ORDER BY position) AS place FROM e) WHERE place <= 8""",
    "as_of side indicator axis", "place direction", "z:2",
)
def _(spark, sf):
    r = reads(spark, sf)
    return rg.regime_evidence(r, rg.regime(rg.axis_summary(r, rg.registry(spark), asofs(spark, sf))))


@register(
    "risk_budget", "A6",
    f"""WITH {REGIME}, b AS (SELECT *, CASE regime WHEN 'Goldilocks' THEN 70 WHEN 'Reflation' THEN 60 WHEN 'Stagflation' THEN 30 WHEN 'Deflation/Slowdown' THEN 25 ELSE 45 END AS lo,
      CASE regime WHEN 'Goldilocks' THEN 90 WHEN 'Reflation' THEN 80 WHEN 'Stagflation' THEN 55 WHEN 'Deflation/Slowdown' THEN 50 ELSE 70 END AS hi,
      CASE WHEN fc < -0.3 THEN -10 WHEN fc > 0.3 THEN 5 ELSE 0 END + CASE WHEN ra < -0.3 THEN -10 ELSE 0 END AS shift, lag(regime) OVER (ORDER BY as_of) AS prior_regime FROM rgm)
    --final SELECT as_of, regime, prior_regime, coalesce(prior_regime <> regime, false) AS changed, greatest(10, lo + shift) AS equity_low, greatest(20, hi + shift) AS equity_high,
      100 - greatest(20, hi + shift) AS cash_low, 100 - greatest(10, lo + shift) AS cash_high FROM b""",
    "as_of regime prior_regime changed", "equity_low equity_high cash_low cash_high",
)
def _(spark, sf):
    return rg.risk_budget(rg.regime(axes(spark, sf)))


@register(
    "macro_panel", "A7 W22 W23",
    f"""WITH {v.MACRO}, p AS (SELECT *, value - lag(value, 21) {I} AS change_21, (value / nullif(lag(value, 21) {I}, 0) - 1) * 100 AS pct_change_21, lead(obs_date) {I} AS nx FROM macro)
    --final SELECT * FROM p WHERE nx IS NULL""",
    "indicator obs_date", "", "value change_21 pct_change_21",
)
def _(spark, sf):
    return rg.macro_panel(macro(spark, sf))


# ------------------------------------------------------------ breadth, sentiment
BREADTH = f"""{DIAG}, br AS (SELECT month_end AS as_of, region, 100 * avg(CASE WHEN close > ma200 THEN 1.0 ELSE 0.0 END) AS breadth_200,
  100 * avg(CASE WHEN close > ma50 THEN 1.0 ELSE 0.0 END) AS breadth_50, 100 * avg(CASE WHEN regime = 'Bull' THEN 1.0 ELSE 0.0 END) AS bull_pct,
  coalesce(median(mom60) * 100, 0) AS median_momentum FROM diag GROUP BY 1, 2)"""


def breadth(spark, sf):
    return mk.breadth(src.month_snapshot(dg.diagnose(features(spark, sf))))


@register("breadth", "A1", f"WITH {BREADTH} --final SELECT * FROM br", "as_of region", "", "breadth_200 breadth_50 bull_pct median_momentum")
def _(spark, sf):
    return breadth(spark, sf)


def gauges(spark, sf):
    """One row per as-of date with each gauge's newest value; two rates stand in for the KR ones."""
    m = macro(spark, sf)
    w = rg.by_indicator()
    m = m.withColumn("chg", (F.col("value") / F.nullif(F.lag("value", 21).over(w), F.lit(0.0)) - 1) * 100)
    seen = rg.asof_visible(m, asofs(spark, sf), F.col("obs_date"))
    at = lambda n, c="value": F.max(F.when(F.col("indicator") == n, F.col(c)))
    return seen.groupBy("as_of").agg(
        at("VIX").alias("vix"), (at("HY_Spread") / 50).alias("hy_spread"), at("Yield_Curve").alias("yield_curve"),
        (at("TGA") * 6).alias("usd_krw"), at("TGA", "chg").alias("usd_krw_chg"),
        at("Treasury_2Y").alias("korea_10y"), at("Treasury_10Y").alias("korea_3m"),
    )


GAUGES = f"""{ASOFS}, mc AS (SELECT *, (value / nullif(lag(value, 21) {I}, 0) - 1) * 100 AS chg FROM macro),
gl0 AS (SELECT a.as_of, m.indicator, arg_max(value, obs_date) AS val, arg_max_null(chg, obs_date) AS chg FROM asofs a JOIN mc m ON m.obs_date <= a.as_of GROUP BY 1, 2),
gauges AS (SELECT as_of, max(val) FILTER (indicator = 'VIX') AS vix, max(val) FILTER (indicator = 'HY_Spread') / 50 AS hy, max(val) FILTER (indicator = 'Yield_Curve') AS yc,
  max(val) FILTER (indicator = 'TGA') * 6 AS krw, max(chg) FILTER (indicator = 'TGA') AS krw_chg, max(val) FILTER (indicator = 'Treasury_2Y') AS k10, max(val) FILTER (indicator = 'Treasury_10Y') AS k3
  FROM gl0 GROUP BY 1)"""
SENT = f"""{BREADTH}, {v.MACRO}, {GAUGES},
sn AS (SELECT b.as_of, b.region, b.breadth_200, least(greatest(50 + (breadth_200 - 50) * 0.4::DOUBLE + (breadth_50 - 50) * 0.1::DOUBLE + CASE WHEN median_momentum > 0 THEN 8 ELSE -8 END + (bull_pct - 50) * 0.1::DOUBLE
  + CASE WHEN b.region = 'US' THEN CASE WHEN vix > 25 THEN -10 WHEN vix < 16 THEN 5 ELSE 0 END + CASE WHEN hy > 5 THEN -10 ELSE 0 END + CASE WHEN yc < 0 THEN -8 ELSE 0 END
    ELSE CASE WHEN krw > 1400 THEN -10 ELSE 0 END + CASE WHEN krw_chg > 3 THEN -6 ELSE 0 END + CASE WHEN k10 - k3 < 0 THEN -8 ELSE 0 END END, 0), 100) AS s
  FROM br b LEFT JOIN gauges g USING (as_of)),
sent AS (SELECT as_of, region, round_even(s, 0) AS score, CASE WHEN s >= 60 THEN 'bullish' WHEN s < 40 THEN 'bearish' ELSE 'neutral' END AS label,
  CASE WHEN s < 25 THEN 'extreme fear' WHEN s < 45 THEN 'fear' WHEN s < 55 THEN 'neutral' WHEN s < 75 THEN 'greed' ELSE 'extreme greed' END AS fear_greed, round_even(breadth_200, 0) AS breadth_200 FROM sn)"""


def sentiment(spark, sf):
    return mk.sentiment(breadth(spark, sf), gauges(spark, sf))


@register("sentiment", "A2", f"WITH {SENT} --final SELECT * FROM sent", "as_of region label fear_greed", "score breadth_200")
def _(spark, sf):
    return sentiment(spark, sf)


# -------------------------------------------------------------------- direction
def _kind(num):
    return F.when(num == 1, "cash").when(num % 4 == 0, "defense").otherwise("risk")


def asset_returns(spark, sf):
    num = F.regexp_replace("entity", "Brand#", "").cast("int")
    r = src.month_snapshot(mk.horizon_returns(v.bars(spark, sf)))
    return r.withColumns({"kind": _kind(num), "position": num})


def market_series(spark, sf):
    """Region benchmarks as an index close series."""
    return v.benchmark(v.bars(spark, sf)).withColumnRenamed("bench", "close")


def market_returns(spark, sf):
    s = market_series(spark, sf).withColumn("entity", F.col("region"))
    return src.month_snapshot(mk.horizon_returns(s))


RETS = f"""hr AS (SELECT *, lead(ts) {W} AS nx, round_even((close / lag(close, 252) {W} - 1) * 100, 2) AS r12 FROM bars),
assets AS (SELECT month_end AS as_of, entity, r12, num AS position, CASE WHEN num = 1 THEN 'cash' WHEN num % 4 = 0 THEN 'defense' ELSE 'risk' END AS kind FROM hr WHERE month_end IS DISTINCT FROM last_day(nx)),
dm0 AS (SELECT as_of, max(r12) FILTER (kind = 'risk') AS rr, arg_max(entity, (r12, -position)) FILTER (kind = 'risk' AND r12 IS NOT NULL) AS re,
  arg_max(entity, (r12, -position)) FILTER (kind = 'defense' AND r12 IS NOT NULL) AS de, max(r12) FILTER (kind = 'cash') AS cash FROM assets GROUP BY 1),
dm AS (SELECT *, coalesce(rr > 0 AND (cash IS NULL OR rr > cash), false) AS win FROM dm0)"""


@register(
    "dual_momentum", "A8", f"WITH {v.BARS}, {RETS} --final SELECT as_of, win AS equities_win, CASE WHEN win THEN re ELSE coalesce(de, re) END AS winner, cash AS cash_12m FROM dm",
    "as_of equities_win winner", "", "cash_12m:2",
)
def _(spark, sf):
    return mk.dual_momentum(asset_returns(spark, sf))


R = "OVER (PARTITION BY region ORDER BY ts)"
VT = f"""vt0 AS (SELECT *, bench / lag(bench) {R} - 1 AS br, lead(ts) {R} AS nx FROM bench),
vt1 AS (SELECT *, CASE WHEN count(br) OVER w = 21 THEN stddev_samp(br) OVER w * sqrt(252) * 100 END AS v FROM vt0 WINDOW w AS (PARTITION BY region ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
vt AS (SELECT region, ts, round_even(v, 1) AS realized_vol, round_even(least(greatest(12 / v * 100, 20), 100), 0) AS exposure_pct FROM vt1 WHERE v > 0)"""


@register("vol_target", "A9", f"WITH {v.BARS}, {v.BENCH}, {VT} --final SELECT * FROM vt", "region ts", "exposure_pct", "realized_vol")
def _(spark, sf):
    return mk.vol_target(market_series(spark, sf))


TILT = f"""ti0 AS (SELECT region, last_day(ts) AS as_of, lead(ts) {R} AS nx, ts, round_even((bench / lag(bench, 63) {R} - 1) * 100, 2) AS r3, round_even((bench / lag(bench, 126) {R} - 1) * 100, 2) AS r6 FROM bench),
ti1 AS (SELECT * FROM ti0 WHERE as_of IS DISTINCT FROM last_day(nx)),
tilt AS (SELECT as_of, d3, d6, CASE WHEN d3 > 2 AND d6 > 0 THEN 'KR' WHEN d3 < -2 AND d6 < 0 THEN 'US' ELSE 'neutral' END AS tilt FROM (
  SELECT k.as_of, round_even(k.r3 - u.r3, 1) AS d3, round_even(k.r6 - u.r6, 1) AS d6 FROM ti1 k JOIN ti1 u ON k.as_of = u.as_of AND k.region = 'KR' AND u.region = 'US') WHERE d3 IS NOT NULL AND d6 IS NOT NULL)"""


@register("region_tilt", "A10", f"WITH {v.BARS}, {v.BENCH}, {TILT} --final SELECT * FROM tilt", "as_of tilt", "", "d3:1 d6:1")
def _(spark, sf):
    return mk.tilt(market_returns(spark, sf))


TREND = f"""tr0 AS (SELECT *, {roll('avg', 'close', 200)} AS ma200 FROM bars),
trend AS (SELECT b.month_end AS as_of, avg(CASE WHEN close >= ma200 THEN 1.0 WHEN ma200 IS NOT NULL THEN 0.0 END) AS frac
  FROM tr0 b JOIN assets a ON a.entity = b.entity AND a.as_of = b.month_end AND b.ts = (SELECT max(ts) FROM bars c WHERE c.entity = b.entity AND c.month_end = b.month_end) GROUP BY 1)"""


@register(
    "direction", "A11",
    f"""WITH {SENT}, {RETS}, {VT}, {TREND.replace('tr0', 'trd0')},
    mood AS (SELECT as_of, avg(score) AS mood FROM sent GROUP BY 1),
    vm AS (SELECT last_day(ts) AS as_of, arg_max(exposure_pct, ts) AS e FROM vt WHERE region = 'US' GROUP BY 1),
    di AS (SELECT a.as_of, d.win, t.frac, m.mood, v.e FROM asofs a LEFT JOIN dm d USING (as_of) LEFT JOIN trend t USING (as_of) LEFT JOIN mood m USING (as_of) LEFT JOIN vm v USING (as_of)),
    ds AS (SELECT *, least(greatest(50 + CASE WHEN win THEN 15 WHEN NOT win THEN -15 ELSE 0 END + coalesce((frac - 0.5) * 30, 0) + coalesce((mood - 50) * 0.3::DOUBLE, 0)
      + CASE WHEN e < 50 THEN -8 WHEN e > 90 THEN 4 ELSE 0 END, 0), 100) AS s FROM di WHERE win IS NOT NULL OR frac IS NOT NULL OR mood IS NOT NULL OR e IS NOT NULL),
    de AS (SELECT *, least(greatest(round_even(coalesce(e, 70) * CASE WHEN s >= 60 THEN 1.0 WHEN s >= 45 THEN 0.8 ELSE 0.5 END / 5, 0) * 5, 10), 100) AS eq FROM ds)
    --final SELECT as_of, round_even(s, 0) AS score, CASE WHEN s >= 60 THEN 'add risk' WHEN s >= 45 THEN 'hold' ELSE 'defend' END AS stance, eq AS equity_pct, 100 - eq AS cash_pct FROM de""",
    "as_of stance", "score equity_pct cash_pct",
)
def _(spark, sf):
    f = features(spark, sf).select("entity", "ts", (F.col("close") >= F.col("ma200")).alias("above_200d"))
    trend = src.month_snapshot(f).select("as_of", "above_200d")
    vol = mk.vol_target(market_series(spark, sf)).where(F.col("region") == "US").withColumn("entity", F.col("region"))
    return mk.direction(
        asofs(spark, sf), mk.dual_momentum(asset_returns(spark, sf)), trend, sentiment(spark, sf),
        src.month_snapshot(vol).select("as_of", "exposure_pct"),
    )


def _ex(k: int) -> str:
    return f"(close / lag(close, {k}) {W} - 1) * 100 AS s{k}"


def _exb(k: int) -> str:
    return f"(bench / lag(bench, {k}) {R} - 1) * 100 AS b{k}"


@register(
    "style_factor_excess", "A12",
    f"""WITH {v.BARS}, {v.BENCH}, s AS (SELECT *, lead(ts) {W} AS nx, {_ex(21)}, {_ex(63)}, {_ex(126)} FROM bars), b AS (SELECT *, lead(ts) {R} AS nx, {_exb(21)}, {_exb(63)}, {_exb(126)} FROM bench)
    --final SELECT s.entity, s.region, round_even(s21 - b21, 1) AS ex_1m_pct, round_even(s63 - b63, 1) AS ex_3m_pct, round_even(s126 - b126, 1) AS ex_6m_pct
    FROM s JOIN b ON s.region = b.region AND s.nx IS NULL AND b.nx IS NULL""",
    "entity region", "", "ex_1m_pct ex_3m_pct ex_6m_pct",
)
def _(spark, sf):
    bars = v.bars(spark, sf).select("entity", "region", "ts", "close")
    return mk.factor_excess(bars, v.benchmark(v.bars(spark, sf)), ["region", "ts"])
