"""Trend, risk, entry, index and rotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis as dg
from ..operators import features as fx
from ..session import stage_table
from ..sources import bars as src
from . import views as v
from .catalog import register
from .feature_queries import B, BJ, FILL, W, roll, rsi_sql

# The part of the feature panel the readings use.
FEATS = f"""{v.BARS}, {v.BENCH}, {BJ},
f1 AS (SELECT b.*, close / nullif(lag(close) {W}, 0) - 1 AS r, open / nullif(lag(close) {W}, 0) - 1 AS gap,
   close / {FILL.format(c='bench')} AS rel,
   greatest(coalesce(close - lag(close) {W}, 0), 0) AS gain, greatest(-coalesce(close - lag(close) {W}, 0), 0) AS loss FROM bj b),
feats AS (SELECT *, {roll('avg', 'close', 20)} AS ma20, {roll('avg', 'close', 50)} AS ma50, {roll('avg', 'close', 200)} AS ma200,
   ({roll('stddev_samp', 'r', 20)}) * sqrt(252) AS vol20, ({roll('stddev_samp', 'r', 60)}) * sqrt(252) AS vol60,
   {rsi_sql(14)} AS rsi, rel / lag(rel, 20) {W} - 1 AS rel_mom, close / ({roll('max', 'close', 252)}) AS hi52,
   close / lag(close, 60) {W} - 1 AS mom60,
   round_even(avg(volume) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / ({roll('avg', 'volume', 60)}), 2) AS vsurge,
   min(r) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 100 AS adverse,
   min(gap) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * 100 AS gapdown
   FROM f1)"""

# Drawdown on a set of anchor rows: peak so far inside the frame, then the worst fall.
def dd_sql(anchor: str) -> str:
    return f"""ddw AS (SELECT a.entity, a.ts AS at_ts, b.pos, b.close,
     max(b.close) OVER (PARTITION BY a.entity, a.ts ORDER BY b.pos) AS peak
   FROM {anchor} a JOIN bars b ON a.entity = b.entity AND b.pos BETWEEN a.pos - 251 AND a.pos),
dd AS (SELECT entity, at_ts AS ts, min(close / peak - 1) * 100 AS max_dd FROM ddw GROUP BY 1, 2)"""


def features(spark, sf):
    """The stored feature panel the readings are taken from."""
    return stage_table(spark, f"{sf}/features", lambda: fresh_features(spark, sf))


def fresh_features(spark, sf):
    """Bars with the moving averages, volatilities, RSI, strength and momentum readings."""
    bars = v.bars(spark, sf)
    df = fx.align_ffill(bars, v.benchmark(bars), ["region", "ts"], ["bench"])
    df = fx.moving_averages(df, (20, 50, 200))
    df = fx.rolling_vol(fx.returns(df), (20, 60))
    df = fx.momentum(fx.rsi(fx.relative_strength(df), (14,)), (60,))
    return fx.trend_position(df)


@register(
    "rolling_max_drawdown", "W17",
    f"WITH {v.BARS}, {dd_sql('bars')} --final SELECT * FROM dd", "entity ts", "", "max_dd",
)
def _(spark, sf):
    return dg.max_drawdown(v.bars(spark, sf))


DIAG = f"""{FEATS}, anchors AS (SELECT * FROM feats WHERE month_end IS DISTINCT FROM last_day(lead_ts)),
{dd_sql('anchors')},
diag AS (SELECT a.*, d.max_dd,
  CASE WHEN close > ma200 AND ma50 > ma200 THEN 'Bull' WHEN close < ma200 AND NOT coalesce(ma50 > ma200, false) THEN 'Bear' ELSE 'Transition' END AS regime,
  list_filter([CASE WHEN close < ma200 THEN 'SMA200' END, CASE WHEN vol20 * 100 > 30 THEN 'Volatility' END, CASE WHEN max_dd < -15 THEN 'Drawdown' END,
    CASE WHEN rel_mom < 0 THEN 'Relative Strength' END, CASE WHEN rsi > 75 THEN 'RSI' END], lambda x: x IS NOT NULL) AS flags
  FROM anchors a JOIN dd d USING (entity, ts))""".replace("feats AS (SELECT *,", f"feats AS (SELECT *, lead(ts) {W} AS lead_ts,", 1)


@register(
    "diagnosis", "W16 W15 W17 P16",
    f"""WITH {DIAG} --final SELECT entity, month_end AS as_of, ts, regime, array_to_string(flags, ',') AS flags, round_even(close, 2) AS last_close,
    round_even(vol20 * 100, 1) AS realized_vol, round_even(rsi, 1) AS rsi14, round_even(max_dd, 1) AS max_dd,
    round_even(rel_mom * 100, 1) AS rel_momentum, round_even(hi52 * 100, 1) AS pct_52w_high,
    coalesce(close > ma50, false) AS above_ma50, coalesce(close > ma200, false) AS above_ma200, mom60 FROM diag""",
    "entity as_of ts regime flags above_ma50 above_ma200", "", "last_close realized_vol rsi14 max_dd rel_momentum pct_52w_high mom60",
)
def _(spark, sf):
    out = src.month_snapshot(dg.diagnose(features(spark, sf)))
    return out.withColumn("flags", F.array_join("risk_flags", ",")).withColumnRenamed("max_drawdown_252d", "max_dd")


@register(
    "latest_reading_per_column", "W15",
    f"WITH {FEATS} --final SELECT entity, " + ", ".join(
        f"arg_max({c}, ts) FILTER ({c} IS NOT NULL) AS {c}" for c in ("ma200", "rsi", "rel_mom", "hi52")) + " FROM feats GROUP BY entity",
    "entity", "", "ma200:4 rsi rel_mom hi52",
)
def _(spark, sf):
    df = features(spark, sf).select(
        "entity", "ts", "ma200", F.col("rsi_14").alias("rsi"), F.col("rel_momentum").alias("rel_mom"), F.col("price_52w_high").alias("hi52"))
    return dg.latest_values(df, ["ma200", "rsi", "rel_mom", "hi52"])


@register("volume_surge", "W18", f"WITH {FEATS} --final SELECT entity, ts, vsurge AS volume_surge FROM feats", "entity ts", "", "volume_surge")
def _(spark, sf):
    return dg.volume_surge(v.bars(spark, sf))


@register(
    "adverse_moves", "W19", f"WITH {FEATS} --final SELECT entity, ts, adverse AS max_adverse, gapdown AS gap_down FROM feats",
    "entity ts", "", "max_adverse gap_down",
)
def _(spark, sf):
    return dg.adverse_moves(v.bars(spark, sf))


ENTRYF = """entryf AS (SELECT entity, region, sector, ts, month_end, lead_ts, coalesce(close > ma20, false) AS above_ma20,
  coalesce(close > ma50, false) AS above_ma50, coalesce(close > ma200, false) AS above_ma200,
  round_even((close / nullif(ma200, 0) - 1) * 100, 1) AS dist200_pct, round_even(rsi, 1) AS rsi14, round_even(vol20 * 100, 1) AS vol20_pct,
  round_even(CASE WHEN vol60 > 0 THEN nullif(vol20, 0) / vol60 END, 2) AS vol_spike, round_even(mom60 * 100, 1) AS mom60_pct,
  round_even(adverse, 1) AS max_adverse_pct, round_even(gapdown, 1) AS gap_down_pct, vsurge AS volume_surge FROM feats)"""
FEATS_L = FEATS.replace("feats AS (SELECT *,", f"feats AS (SELECT *, lead(ts) {W} AS lead_ts,", 1)


@register(
    "entry_features", "W20",
    f"WITH {FEATS_L}, {ENTRYF} --final SELECT * FROM entryf", "entity ts above_ma20 above_ma50 above_ma200", "",
    "dist200_pct rsi14 vol20_pct vol_spike mom60_pct max_adverse_pct gap_down_pct volume_surge",
)
def _(spark, sf):
    return dg.entry_features(features(spark, sf))


@register(
    "trailing_return_and_change", "W22 W23",
    f"{B} SELECT entity, ts, (close / lag(close, 63) {W} - 1) * 100 AS ret_63, (close / lag(close, 126) {W} - 1) * 100 AS ret_126, close - lag(close, 21) {W} AS chg_21 FROM bars",
    "entity ts", "", "ret_63 ret_126 chg_21",
)
def _(spark, sf):
    return v.bars(spark, sf).select(
        "entity", "ts", dg.trailing_return("close", 63).alias("ret_63"), dg.trailing_return("close", 126).alias("ret_126"),
        dg.trailing_change("close", 21).alias("chg_21"))


@register(
    "index_summary", "W24 A13",
    f"""WITH {v.BARS}, i AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n, lag(close, 1) {W} AS prev, lag(close, 21) {W} AS m1,
      max(close) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS hi, {roll('avg', 'close', 200)} AS ma200 FROM bars),
    l AS (SELECT * FROM i WHERE pos = n AND n >= 30),
    y AS (SELECT l.entity, arg_max(b.close, b.ts) AS y FROM l JOIN bars b ON l.entity = b.entity AND year(b.ts) < year(l.ts) GROUP BY 1),
    f AS (SELECT entity, arg_min(close, ts) AS f FROM bars GROUP BY 1),
    s AS (SELECT b.entity, string_agg(CAST(CAST(round(b.close, 2) AS DECIMAL(12,2)) AS VARCHAR), ' ' ORDER BY b.ts) AS spark FROM bars b JOIN l ON b.entity = l.entity AND b.pos > l.n - 63 GROUP BY 1)
    --final SELECT l.entity, l.ts AS as_of, round_even(close, 2) AS last, round_even((close / prev - 1) * 100, 2) AS d1, round_even((close / m1 - 1) * 100, 2) AS m1,
      round_even((close / coalesce(y.y, f.f) - 1) * 100, 2) AS ytd, round_even((close / hi - 1) * 100, 2) AS hi, close >= ma200 AS above_200d, spark
      FROM l JOIN f USING (entity) JOIN s USING (entity) LEFT JOIN y USING (entity)""",
    "entity as_of above_200d spark", "", "last d1 m1 ytd hi",
)
def _(spark, sf):
    out = dg.index_summary(v.bars(spark, sf))
    text = F.transform("spark", lambda x: x.cast("decimal(12,2)").cast("string"))
    return out.withColumn("spark", F.array_join(text, " ")).withColumnsRenamed(
        {"chg_1d_pct": "d1", "chg_1m_pct": "m1", "ytd_pct": "ytd", "from_52w_high_pct": "hi"})


ROT = f"""{v.BARS}, {v.BENCH}, {BJ},
    rs AS (SELECT *, close / {FILL.format(c='bench')} AS rs, (close / lag(close, 21) {W} - 1) * 100 AS r1, (close / lag(close, 63) {W} - 1) * 100 AS r3 FROM bj),
    rr AS (SELECT *, row_number() {W} AS p, (rs / ({roll('avg', 'rs', 63)}) - 1) * 100 AS ratio, (rs / lag(rs, 21) {W} - 1) * 100 AS mom FROM rs WHERE rs IS NOT NULL),
    rot AS (SELECT entity, region, ts, round_even(ratio, 2) AS rs_ratio, round_even(mom, 2) AS rs_mom,
      CASE WHEN ratio >= 0 THEN CASE WHEN mom >= 0 THEN 'Leading' ELSE 'Weakening' END WHEN mom >= 0 THEN 'Improving' ELSE 'Lagging' END AS quadrant,
      round_even(r1, 1) AS ret_1m_pct, round_even(r3, 1) AS ret_3m_pct FROM rr WHERE p > 84)"""


@register(
    "rotation", "W21 K6 J1", f"WITH {ROT} --final SELECT * FROM rot", "entity region ts quadrant", "", "rs_ratio rs_mom ret_1m_pct ret_3m_pct",
)
def _(spark, sf):
    bars = v.bars(spark, sf)
    return dg.rotation(bars, v.benchmark(bars), ["region", "ts"])


@register(
    "latest_date", "A13", f"{B} SELECT max(ts) AS as_of FROM bars", "as_of",
)
def _(spark, sf):
    return src.latest_date(v.bars(spark, sf))
