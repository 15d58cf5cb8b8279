"""Bar and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranks import percentile_rank
from ..operators import features as fx
from ..operators.selection import top_k
from ..sources import bars as src
from . import views as v
from .catalog import register

B = f"WITH {v.BARS} --final "
W = "OVER (PARTITION BY entity ORDER BY ts)"


def roll(fn: str, c: str, n: int) -> str:
    """A full-window rolling aggregate in SQL."""
    o = f"OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) {o} = {n} THEN {fn}({c}) {o} END"


@register("bars_from_trades", "S2 S1", B + "SELECT * FROM bars", "entity region sector ts", "", "open high low close volume", 4)
def _(spark, sf):
    return src.clean_bars(v.fresh_bars(spark, sf))


@register(
    "top_momentum_names", "K3 X4 W5",
    f"""WITH {v.BARS},
    m AS (SELECT *, close / nullif(lag(close, 60) {W}, 0) - 1 AS mom, lead(ts) {W} AS nxt FROM bars),
    s AS (SELECT * FROM m WHERE nxt IS NULL AND mom IS NOT NULL),
    r AS (SELECT *, rank() OVER (PARTITION BY region ORDER BY mom)
            + (count(*) OVER (PARTITION BY region, mom) - 1) / 2.0 AS rk,
          count(*) OVER (PARTITION BY region) AS n FROM s),
    p AS (SELECT *, round_even(rk / n * 100, 0) AS mom_pct FROM r),
    t AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY mom_pct DESC, entity) AS place FROM p)
    --final SELECT * FROM t WHERE place <= 5""",
    "region entity ts", "place", "mom mom_pct",
)
def top_momentum_names(spark, sf):
    df = fx.momentum(v.fresh_bars(spark, sf).select("entity", "region", "ts", "close"), (60,))
    snap = src.latest_snapshot_rows(df).where(F.col("momentum_60d").isNotNull())
    ranked = percentile_rank(snap, ["region"], ["momentum_60d"])
    return top_k(
        ranked, ["region"], [F.col("momentum_60d_pct").desc(), F.col("entity")], 5, "place"
    ).select("region", "entity", "ts", "place", F.col("momentum_60d").alias("mom"), F.col("momentum_60d_pct").alias("mom_pct"))


@register(
    "returns_and_ratios", "W1",
    f"""{B} SELECT entity, ts, close / nullif(lag(close) {W}, 0) - 1 AS ret,
    ln(close / nullif(lag(close) {W}, 0)) AS log_ret, high / nullif(low, 0) AS hl, close / nullif(open, 0) AS co FROM bars""",
    "entity ts", "", "ret log_ret hl co",
)
def _(spark, sf):
    return fx.returns(v.bars(spark, sf)).select(
        "entity", "ts", F.col("returns").alias("ret"), F.col("log_returns").alias("log_ret"),
        F.col("high_low_ratio").alias("hl"), F.col("close_open_ratio").alias("co"),
    )


@register(
    "moving_averages", "W2",
    f"{B} SELECT entity, ts, "
    + ", ".join(f"{roll('avg', 'close', n)} AS ma{n}, close / ({roll('avg', 'close', n)}) AS ma{n}_ratio" for n in fx.MA_PERIODS)
    + " FROM bars",
    "entity ts", "", " ".join(f"ma{n}:4 ma{n}_ratio" for n in fx.MA_PERIODS),
)
def _(spark, sf):
    return fx.moving_averages(v.bars(spark, sf))


RET = f"ret AS (SELECT *, close / nullif(lag(close) {W}, 0) - 1 AS r FROM bars)"


@register(
    "rolling_volatility", "W3",
    f"WITH {v.BARS}, {RET} --final SELECT entity, ts, "
    + ", ".join(f"({roll('stddev_samp', 'r', n)}) * sqrt(252) AS vol{n}" for n in fx.VOL_PERIODS) + " FROM ret",
    "entity ts", "", "vol5 vol10 vol20 vol60",
)
def _(spark, sf):
    df = fx.rolling_vol(fx.returns(v.bars(spark, sf)))
    return df.select("entity", "ts", *[F.col(f"volatility_{n}d").alias(f"vol{n}") for n in fx.VOL_PERIODS])


@register(
    "volume_ratio", "W4", f"{B} SELECT entity, ts, volume / ({roll('avg', 'volume', 20)}) AS volume_ratio FROM bars",
    "entity ts", "", "volume_ratio",
)
def _(spark, sf):
    return fx.volume_ratio(v.bars(spark, sf))


@register(
    "momentum", "W5",
    f"{B} SELECT entity, ts, " + ", ".join(f"close / lag(close, {n}) {W} - 1 AS momentum_{n}d" for n in fx.MOMENTUM_PERIODS) + " FROM bars",
    "entity ts", "", " ".join(f"momentum_{n}d" for n in fx.MOMENTUM_PERIODS),
)
def _(spark, sf):
    return fx.momentum(v.bars(spark, sf))


def rsi_sql(n: int) -> str:
    g, l = roll("avg", "gain", n), roll("avg", "loss", n)
    return f"CASE WHEN ({l}) > 0 THEN 100 - 100 / (1 + ({g}) / nullif({l}, 0)) WHEN ({g}) > 0 THEN 100 END"


GAIN = f"""gl AS (SELECT *, greatest(coalesce(close - lag(close) {W}, 0), 0) AS gain,
         greatest(-coalesce(close - lag(close) {W}, 0), 0) AS loss FROM bars)"""


@register(
    "rsi", "W6", f"WITH {v.BARS}, {GAIN} --final SELECT entity, ts, {rsi_sql(14)} AS rsi_14, {rsi_sql(28)} AS rsi_28 FROM gl",
    "entity ts", "", "rsi_14 rsi_28",
)
def _(spark, sf):
    return fx.rsi(v.bars(spark, sf))


@register(
    "macd", "W7",
    f"""WITH {v.BARS},
    e AS (SELECT a.entity, a.ts, a.pos,
            sum(b.close * pow(11.0/13, a.pos - b.pos)) / sum(pow(11.0/13, a.pos - b.pos)) AS fast,
            sum(b.close * pow(25.0/27, a.pos - b.pos)) / sum(pow(25.0/27, a.pos - b.pos)) AS slow
          FROM bars a JOIN bars b ON a.entity = b.entity AND b.pos BETWEEN a.pos - 600 AND a.pos GROUP BY ALL),
    m AS (SELECT entity, ts, pos, fast - slow AS macd FROM e),
    s AS (SELECT a.entity, a.ts, a.macd,
            sum(b.macd * pow(0.8, a.pos - b.pos)) / sum(pow(0.8, a.pos - b.pos)) AS macd_signal
          FROM m a JOIN m b ON a.entity = b.entity AND b.pos BETWEEN a.pos - 300 AND a.pos GROUP BY ALL)
    --final SELECT entity, ts, macd, macd_signal, macd - macd_signal AS macd_diff FROM s""",
    "entity ts", "", "macd macd_signal macd_diff",
)
def _(spark, sf):
    return fx.macd(v.bars(spark, sf))


@register(
    "bollinger", "W8",
    f"""WITH {v.BARS}, b AS (SELECT entity, ts, close, {roll('avg', 'close', 20)} AS mid,
      2 * ({roll('stddev_samp', 'close', 20)}) AS band FROM bars)
    --final SELECT entity, ts, 2 * band / nullif(mid, 0) AS bb_width, (close - mid + band) / nullif(2 * band, 0) AS bb_position FROM b""",
    "entity ts", "", "bb_width bb_position",
)
def _(spark, sf):
    return fx.bollinger(v.bars(spark, sf))


FILL = "last_value({c} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
VIXJ = f"vx AS (SELECT b.*, {FILL.format(c='v.vix')} AS vix FROM bars b LEFT JOIN vix v USING (ts))".replace(
    "PARTITION BY entity ORDER BY ts", "PARTITION BY b.entity ORDER BY b.ts")
VIXF = f"""vf AS (SELECT *, vix / ({roll('avg', 'vix', 20)}) AS vix_ratio, vix / lag(vix) {W} - 1 AS vix_change,
      vix / ({roll('avg', 'vix', 60)}) AS vix_short_long FROM vx)"""


@register(
    "vix_features", "W9 J1", f"WITH {v.BARS}, {v.VIX}, {VIXJ}, {VIXF} --final SELECT * FROM vf",
    "entity ts", "", "vix vix_ratio vix_change vix_short_long",
)
def _(spark, sf):
    df = fx.align_ffill(v.bars(spark, sf), v.vix(spark, sf), ["ts"], ["vix"])
    return fx.vix_features(df)


BJ = """bj AS (SELECT b.*, n.bench FROM bars b LEFT JOIN bench n ON b.region = n.region AND b.ts = n.ts)"""


@register(
    "relative_strength", "W10 J1",
    f"WITH {v.BARS}, {v.BENCH}, {BJ} --final SELECT entity, ts, rel_ratio, rel_ratio / lag(rel_ratio, 20) {W} - 1 AS rel_momentum "
    f"FROM (SELECT *, close / {FILL.format(c='bench')} AS rel_ratio FROM bj)",
    "entity ts", "", "rel_ratio rel_momentum",
)
def _(spark, sf):
    bars = v.bars(spark, sf)
    return fx.relative_strength(fx.align_ffill(bars, v.benchmark(bars), ["region", "ts"], ["bench"]))


@register(
    "benchmark_routing", "J12",
    f"""WITH {v.BARS},
    j AS (SELECT b.entity, b.ts, n.close AS bench0 FROM bars b LEFT JOIN bars n
      ON n.ts = b.ts AND n.entity = CASE b.region WHEN 'US' THEN 'Brand#2' ELSE 'Brand#1' END AND n.entity <> b.entity)
    --final SELECT entity, ts, {FILL.format(c='bench0')} AS bench FROM j""",
    "entity ts", "", "bench", 4,
)
def _(spark, sf):
    bars = v.bars(spark, sf)
    return fx.with_benchmark(bars, bars, {"US": "Brand#2", "KR": "Brand#1"})


MJ = """mw AS (SELECT obs_date AS ts, max(CASE WHEN indicator = 'Treasury_10Y' THEN value END) AS t10,
      max(CASE WHEN indicator = 'Treasury_2Y' THEN value END) AS t2,
      max(CASE WHEN indicator = 'Yield_Curve' THEN value END) AS yc FROM macro
      WHERE indicator IN ('Treasury_10Y', 'Treasury_2Y', 'Yield_Curve') GROUP BY 1),
    mj AS (SELECT b.*, m.t10 AS t10_0, m.t2 AS t2_0, m.yc AS yc_0 FROM vf b LEFT JOIN mw m USING (ts)),
    ma AS (SELECT *, """ + ", ".join(f"{FILL.format(c=c + '_0')} AS {c}_f" for c in ("t10", "t2", "yc")) + f""" FROM mj),
    mm AS (SELECT *, lag(t10_f) {W} AS t10, lag(t2_f) {W} AS t2, lag(yc_f) {W} AS yc FROM ma)"""
MACRO_COLS = ["Treasury_10Y", "Treasury_2Y", "Yield_Curve"]


@register(
    "macro_stress", "W11 P1 J1 J2 S3",
    f"WITH {v.BARS}, {v.VIX}, {v.MACRO}, {VIXJ}, {VIXF}, {MJ} --final SELECT entity, ts, t10, t2, yc, t10 / ({roll('avg', 't10', 60)}) AS treasury_stress, "
    f"yc - lag(yc, 20) {W} AS yield_curve_change, vix_ratio * 0.4 + vix_short_long * 0.3 + 0.3 / nullif(yc + 2, 0) AS risk_score FROM mm",
    "entity ts", "", "t10 t2 yc treasury_stress yield_curve_change risk_score",
)
def _(spark, sf):
    df = fx.align_ffill(v.bars(spark, sf), v.vix(spark, sf), ["ts"], ["vix"])
    df = fx.with_macro(df, v.macro(spark, sf), MACRO_COLS)
    df = fx.macro_stress(fx.vix_features(df))
    return df.withColumnsRenamed({"Treasury_10Y": "t10", "Treasury_2Y": "t2", "Yield_Curve": "yc"})


@register(
    "trend_position", "W12",
    f"{B} SELECT entity, ts, ({roll('avg', 'close', 50)}) / ({roll('avg', 'close', 200)}) AS ma50_ma200, "
    f"close / ({roll('max', 'close', 252)}) AS price_52w_high, close / ({roll('min', 'close', 252)}) AS price_52w_low FROM bars",
    "entity ts", "", "ma50_ma200 price_52w_high price_52w_low",
)
def _(spark, sf):
    return fx.trend_position(fx.moving_averages(v.bars(spark, sf), (50, 200)))


@register(
    "calendar_features", "W13",
    f"{B} SELECT entity, ts, month(ts) AS month, isodow(ts) - 1 AS day_of_week, quarter(ts) AS quarter FROM bars",
    "entity ts", "month day_of_week quarter",
)
def _(spark, sf):
    return fx.calendar_features(v.bars(spark, sf))


H = (10, 21, 63, 126)


@register(
    "forward_targets", "W14 J5",
    f"{B} SELECT entity, ts, " + ", ".join(
        f"lead(close, {h}) {W} / close - 1 AS forward_return_{h}d, CASE WHEN lead(close, {h}) {W} IS NULL THEN NULL "
        f"WHEN lead(close, {h}) {W} / close - 1 > 0 THEN 1.0 ELSE 0.0 END AS target_{h}d" for h in H) + " FROM bars",
    "entity ts", "", " ".join(f"forward_return_{h}d target_{h}d" for h in H),
)
def _(spark, sf):
    return fx.add_targets(v.bars(spark, sf), H)


@register(
    "neutral_defaults", "P3",
    f"""WITH {v.BARS}, {v.MACRO_DAILY}, t10 AS (SELECT obs_date AS ts, value FROM macro_daily WHERE indicator = 'Treasury_10Y'),
    j AS (SELECT b.*, t10.value FROM bars b LEFT JOIN t10 USING (ts)),
    f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM j)
    --final SELECT 'no series' AS panel, entity, ts, CAST(20 AS DOUBLE) AS vix, CAST(3 AS DOUBLE) AS t10, 0.5 AS yc, 1.0 AS rel_ratio, 0.0 AS rel_momentum FROM bars
    UNION ALL SELECT 'no curve', entity, ts, 20, held, 0.5, 1.0, 0.0 FROM f""",
    "panel entity ts", "", "vix t10 yc rel_ratio rel_momentum",
)
def _(spark, sf):
    bars = v.bars(spark, sf)
    ten = v.macro_daily(spark, sf).where(F.col("indicator") == "Treasury_10Y")
    cols = ["panel", "entity", "ts", "vix", "Treasury_10Y", "Yield_Curve", "rel_ratio", "rel_momentum"]
    fill = lambda df, name: fx.relative_strength(fx.with_neutral_defaults(df)).withColumn("panel", F.lit(name)).select(cols)
    both = fill(bars, "no series").unionByName(fill(fx.with_macro(bars, ten), "no curve"))
    return both.withColumnsRenamed({"Treasury_10Y": "t10", "Yield_Curve": "yc"})


@register(
    "complete_feature_rows", "P4 P2 P6",
    f"""WITH {v.BARS}, {GAIN}, f AS (SELECT entity, ts, {rsi_sql(14)} AS rsi_14, {roll('avg', 'close', 200)} AS ma200,
      {roll('max', 'close', 252)} AS hi, count(*) OVER (PARTITION BY entity) AS n FROM gl)
    --final SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows FROM f
    WHERE rsi_14 IS NOT NULL AND ma200 IS NOT NULL AND hi IS NOT NULL AND n >= 300 GROUP BY entity""",
    "entity first_ts last_ts", "n_rows",
)
def _(spark, sf):
    df = fx.min_history(v.bars(spark, sf), 300)
    df = fx.rsi(fx.trend_position(fx.moving_averages(df)))
    full = fx.complete_cases(df, [c for c in fx.feature_columns(df)])
    return full.groupBy("entity").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_rows")
    )


@register("model_feature_columns", "P2 W1 W12", None, "entity ts", "", "returns ma200_ratio macd risk_score rel_momentum")
def _(spark, sf):
    bars = v.bars(spark, sf)
    df = fx.build_features(bars, v.benchmark(bars), v.vix(spark, sf), v.macro(spark, sf), MACRO_COLS)
    df = fx.add_targets(df, (21,))
    return df.select("entity", "ts", *fx.feature_columns(df))
