"""Model quality, trading, ledger and outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import clip, round_even, shrink
from ..functions.timewin import pct_change
from ..operators import diagnosis as dg
from ..operators import features as fx
from ..operators import ledger as lg
from ..operators import portfolio as pf
from ..operators import quality as ql
from ..operators import selection as sel
from ..session import stage_table
from ..sources import bars as src
from . import views as v
from .catalog import register
from .crosssection_queries import RR, rows
from .diagnosis_queries import DIAG, FEATS_L, features
from .feature_queries import W
from .macro_queries import bday_sql

# ------------------------------------------------------------------ predictions
# A contrarian score for most brands and a trend score for every third one, so
# that both accepted and rejected models occur.
H = 21


def predictions(spark, sf):
    num = F.regexp_replace("entity", "Brand#", "").cast("int")
    m = F.col("mom") * F.when(num % 3 == 0, 10).otherwise(-10)
    df = v.bars(spark, sf).select("entity", "region", "ts", "open", "close", pct_change("close", 20).alias("mom"))
    df = fx.add_targets(df, (H,))
    return df.where(F.col("mom").isNotNull() & F.col(f"target_{H}d").isNotNull()).select(
        "entity", "region", "ts", "open", "close", F.lit(H).alias("horizon"),
        F.col(f"forward_return_{H}d").alias("forward_return"), F.col(f"target_{H}d").cast("int").alias("actual"),
        clip(0.5 + 0.5 * m / (1 + F.abs(m)), 0.05, 0.95).alias("prob_cal"),
    )


PRED = f"""p0 AS (SELECT *, (close / lag(close, 20) {W} - 1) * CASE WHEN num % 3 = 0 THEN 10 ELSE -10 END AS m, lead(close, {H}) {W} / close - 1 AS fr FROM bars),
pred AS (SELECT entity, region, ts, open, close, {H} AS horizon, fr AS forward_return, CASE WHEN fr > 0 THEN 1 ELSE 0 END AS actual,
  least(greatest(0.5 + 0.5 * m / (1 + abs(m)), 0.05), 0.95) AS p FROM p0 WHERE m IS NOT NULL AND fr IS NOT NULL)"""
P = f"WITH {v.BARS}, {PRED}"

HS = """hs AS (SELECT entity, horizon, coalesce(avg(forward_return) FILTER (forward_return > 0), 0) AS up_mean, coalesce(avg(forward_return) FILTER (forward_return <= 0), 0) AS down_mean,
  avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END) AS base_rate, count(*) AS sample_size FROM pred GROUP BY 1, 2)"""


@register("horizon_stats", "A14", f"{P}, {HS} --final SELECT * FROM hs", "entity", "horizon sample_size", "up_mean down_mean base_rate")
def _(spark, sf):
    return ql.horizon_stats(predictions(spark, sf))


THR = "thr AS (SELECT entity, horizon, round_even(CASE WHEN quantile_cont(p, 0.8) < 0.999 THEN quantile_cont(p, 0.8) ELSE 0.7 END, 4) AS threshold FROM pred GROUP BY 1, 2)"


@register("dynamic_threshold", "A19", f"{P}, {THR} --final SELECT * FROM thr", "entity", "horizon", "threshold")
def _(spark, sf):
    return ql.dynamic_threshold(predictions(spark, sf))


@register(
    "alert_class", "B5", f"{P}, {THR} --final SELECT entity, ts, CASE WHEN p >= threshold THEN 'STRONG BUY' WHEN p <= 1 - threshold THEN 'STRONG SELL' ELSE 'HOLD' END AS alert FROM pred JOIN thr USING (entity, horizon)",
    "entity ts alert",
)
def _(spark, sf):
    p = predictions(spark, sf)
    return p.join(ql.dynamic_threshold(p), ["entity", "horizon"]).withColumn("alert", ql.classify_alert("prob_cal"))


@register(
    "shrunk_probability", "M4", f"{P}, {HS} --final SELECT entity, ts, least(greatest((252.0 / 21 * p + 15 * base_rate) / (252.0 / 21 + 15), 0.05), 0.95) AS prob FROM pred JOIN hs USING (entity, horizon)",
    "entity ts", "", "prob",
)
def _(spark, sf):
    p = predictions(spark, sf)
    return p.join(ql.horizon_stats(p), ["entity", "horizon"]).withColumn("prob", shrink("prob_cal", "base_rate", 252.0 / H))


ECE = """ec0 AS (SELECT entity, horizon, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(actual) - avg(p)) AS gap FROM pred GROUP BY 1, 2, 3),
ece AS (SELECT entity, horizon, sum(n * gap) / sum(n) AS ece FROM ec0 GROUP BY 1, 2)"""


@register("calibration_error", "A16", f"{P}, {ECE} --final SELECT * FROM ece", "entity", "horizon", "ece")
def _(spark, sf):
    return ql.calibration_error(predictions(spark, sf))


MET = f"""{THR},
q0 AS (SELECT *, p >= threshold AS hit, row_number() OVER (PARTITION BY entity, horizon ORDER BY ts DESC) <= 252 AS rec FROM pred JOIN thr USING (entity, horizon)),
q1 AS (SELECT entity, horizon, any_value(threshold) AS threshold, count(*) AS days, count(*) FILTER (hit) AS sig, count(*) FILTER (hit AND actual = 1) AS tp, avg(actual) AS baseline, count(*) FILTER (actual = 1) AS pos,
  avg((p - actual) * (p - actual)) AS brier, coalesce(count(*) FILTER (rec AND hit AND actual = 1) / nullif(count(*) FILTER (rec AND hit), 0), 0) - avg(actual) FILTER (rec) AS recent_lift,
  avg(CASE WHEN p <= 0.01 OR p >= 0.99 THEN 1.0 ELSE 0.0 END) AS extreme_rate FROM q0 GROUP BY 1, 2),
q2 AS (SELECT *, coalesce(tp / nullif(sig, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(2 * tp / nullif(sig + pos, 0), 0) AS f1, baseline * (1 - baseline) AS naive_brier,
  CASE WHEN sig > 0 THEN (tp / sig + 3.8416 / (2 * sig) - 1.96 * sqrt((tp / sig * (1 - tp / sig) + 3.8416 / (4 * sig)) / sig)) / (1 + 3.8416 / sig) ELSE 0 END AS wl FROM q1),
met AS (SELECT *, 1 - brier / nullif(naive_brier, 0) AS brier_skill, precision - baseline AS lift, wl - baseline AS lift_ci_lower FROM q2)"""


def metrics(spark, sf):
    p = predictions(spark, sf)
    return ql.oos_metrics(p, ql.dynamic_threshold(p))


@register(
    "oos_metrics", "A15 A17", f"{P}, {MET} --final SELECT *, sig AS signal_count FROM met", "entity", "horizon days signal_count",
    "threshold baseline precision recall f1 brier naive_brier brier_skill lift lift_ci_lower recent_lift extreme_rate", 9,
)
def _(spark, sf):
    return metrics(spark, sf)


GRADE = """gr0 AS (SELECT *, list_filter([CASE WHEN days < 126 THEN 'oos_observations_below_126' END, CASE WHEN sig < 20 THEN 'signal_observations_below_20' END, CASE WHEN lift <= 0 THEN 'precision_lift_not_positive' END,
  CASE WHEN NOT coalesce(brier_skill > 0, false) THEN 'brier_skill_score_not_positive' END, CASE WHEN recent_lift < -0.05 THEN 'recent_performance_decayed' END,
  CASE WHEN extreme_rate > 0.1 THEN 'calibration_instability_extreme_probabilities' END], lambda x: x IS NOT NULL) AS rs FROM met),
gr AS (SELECT *, len(rs) = 0 AS eligible, CASE WHEN len(rs) > 0 THEN 'REJECT' WHEN lift >= 0.05 AND lift_ci_lower > 0 AND brier_skill >= 0.02 THEN 'A' ELSE 'B' END AS quality_grade FROM gr0)"""


def graded(spark, sf):
    return stage_table(spark, f"{sf}/graded", lambda: ql.grade(metrics(spark, sf)))


@register("quality_grade", "A18", f"{P}, {MET}, {GRADE} --final SELECT *, array_to_string(rs, ',') AS reasons FROM gr", "entity eligible quality_grade reasons", "horizon")
def _(spark, sf):
    return graded(spark, sf).withColumn("reasons", F.array_join("eligibility_reasons", ","))


# ---------------------------------------------------------------------- trading
def candidates(spark, sf):
    """Latest prediction of every entity with its statistics, grade and diagnosis."""
    p = predictions(spark, sf)
    last = p.groupBy("entity", "region", "horizon").agg(F.max("ts").alias("entry"), F.max_by("prob_cal", "ts").alias("prob_up"))
    diag = dg.diagnose(features(spark, sf)).select(
        "entity", F.col("ts").alias("entry"), "regime", "above_ma50", "above_ma200", "mom60", "realized_vol", "rel_momentum", "rsi14")
    q = ql.publish(graded(spark, sf)).select("entity", "horizon", "eligible", "quality_grade", "lift", "eligibility_reasons")
    return (
        last.join(ql.horizon_stats(p), ["entity", "horizon"]).join(q, ["entity", "horizon"]).join(diag, ["entity", "entry"])
    )


CAND = f"""{FEATS_L}, {PRED}, {HS}, {MET}, {GRADE},
lastp AS (SELECT entity, region, horizon, max(ts) AS entry, arg_max(p, ts) AS prob_up FROM pred GROUP BY 1, 2, 3),
cand AS (SELECT l.*, h.up_mean, h.down_mean, h.sample_size, g.eligible, g.quality_grade, round_even(g.lift * 100, 2) AS lift, array_to_string(g.rs, ',') AS eligibility_reasons,
  CASE WHEN f.close > f.ma200 AND f.ma50 > f.ma200 THEN 'Bull' WHEN f.close < f.ma200 AND NOT coalesce(f.ma50 > f.ma200, false) THEN 'Bear' ELSE 'Transition' END AS regime,
  coalesce(f.close > f.ma50, false) AS above_ma50, f.mom60, round_even(f.vol20 * 100, 1) AS realized_vol, round_even(f.rel_mom * 100, 1) AS rel_momentum, round_even(f.rsi, 1) AS rsi14, f.vsurge
  FROM lastp l JOIN hs h USING (entity, horizon) JOIN gr g USING (entity, horizon) JOIN feats f ON f.entity = l.entity AND f.ts = l.entry)"""
EV = "(prob_up * up_mean + (1 - prob_up) * down_mean)"
KELLY = """CASE WHEN up_mean > 0 AND down_mean < 0 THEN least(greatest(least((prob_up - (1 - prob_up) / (up_mean / abs(down_mean))) / 2 * CASE WHEN quality_grade = 'A' THEN 1.0 ELSE 0.5 END,
  CASE WHEN realized_vol > 0 THEN 0.015 / (realized_vol / 100.0) ELSE 1e9 END), 0), 0.1) END"""
HUR = "CASE region WHEN 'KR' THEN 0.007 ELSE 0.004 END"


@register("trade_economics", "B1 B2 B3", f"WITH {CAND} --final SELECT entity, {EV} AS ev, {HUR} AS hurdle, {KELLY} AS weight, above_ma50 OR coalesce(mom60 > 0, false) AS confirms FROM cand",
          "entity confirms", "", "ev hurdle weight")
def _(spark, sf):
    return candidates(spark, sf).select(
        "entity", pf.expected_value().alias("ev"), pf.cost_hurdle().alias("hurdle"), pf.kelly_weight().alias("weight"), pf.trend_confirms().alias("confirms"))


def every_date(spark, sf):
    """Every graded prediction as a candidate on its own date, so the gates see many cases."""
    p = predictions(spark, sf)
    diag = dg.diagnose(features(spark, sf)).select("entity", "ts", "regime", "above_ma50", "mom60", "realized_vol", "rel_momentum", "rsi14")
    q = ql.publish(graded(spark, sf)).select("entity", "horizon", "eligible", "quality_grade", "lift")
    return (
        p.drop("open", "close", "forward_return", "actual").withColumnsRenamed({"prob_cal": "prob_up"})
        .join(ql.horizon_stats(p), ["entity", "horizon"]).join(q, ["entity", "horizon"]).join(diag, ["entity", "ts"])
        .withColumn("entry", F.col("ts"))
    )


IDEAS = f"""{CAND.replace('lastp AS (SELECT entity, region, horizon, max(ts) AS entry, arg_max(p, ts) AS prob_up FROM pred GROUP BY 1, 2, 3)', 'lastp AS (SELECT entity, region, horizon, ts AS entry, p AS prob_up FROM pred)')},
ideas AS (SELECT entity, region, prob_up AS model_score, {KELLY} * 100 AS suggested_weight_pct, {EV} * 100 AS exp_move_pct, ({EV} - {HUR}) * 100 AS net_edge_pct, sample_size, horizon, entry,
  {bday_sql('entry', '21')} AS hold_until, regime, quality_grade, concat_ws(' | ', CASE WHEN regime = 'Bull' THEN 'uptrend' ELSE 'transition' END,
   CASE WHEN quality_grade IN ('A', 'B') THEN 'validated ' || quality_grade || ' (lift ' || printf('%.2f', lift) || 'pp)' END,
   CASE WHEN mom60 IS NOT NULL THEN '60d momentum ' || CASE WHEN round_even(mom60 * 100, 0) < 0 THEN '' ELSE '+' END || CAST(CAST(round_even(mom60 * 100, 0) AS BIGINT) AS VARCHAR) || '%' END,
   CASE WHEN rel_momentum > 0 THEN 'ahead of benchmark' END, CASE WHEN rsi14 > 70 THEN 'RSI ' || CAST(CAST(round_even(rsi14, 0) AS BIGINT) AS VARCHAR) || ' hot' END,
   'up probability ' || CAST(CAST(round_even(prob_up * 100, 0) AS BIGINT) AS VARCHAR) || '%') AS why
  FROM cand WHERE eligible AND prob_up >= 0.55 AND {EV} - {HUR} > 0 AND regime <> 'Bear' AND (above_ma50 OR coalesce(mom60 > 0, false)))"""


@register("trade_ideas", "B4 P17", f"WITH {IDEAS} --final SELECT * FROM ideas", "entity region entry hold_until regime quality_grade why", "horizon sample_size",
          "model_score:4 suggested_weight_pct:1 exp_move_pct:2 net_edge_pct:2")
def _(spark, sf):
    return pf.trade_ideas(every_date(spark, sf))


@register(
    "ranked_ideas", "K1", f"""WITH {IDEAS} --final SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry, region ORDER BY CASE quality_grade WHEN 'A' THEN 2 WHEN 'B' THEN 1 ELSE 0 END DESC,
      coalesce(nullif(round_even(net_edge_pct, 2), 0), -999) DESC, entity) AS rank FROM ideas) WHERE rank <= 5""",
    "entry region entity quality_grade", "rank",
)
def _(spark, sf):
    return sel.rank_ideas(pf.trade_ideas(every_date(spark, sf)), ["entry", "region"])


FLOW = "mom60 > 0 AND vsurge <> 0"


@register(
    "money_flow", "K2", f"WITH {FEATS_L} --final SELECT *, vsurge AS volume_surge FROM (SELECT *, row_number() OVER (PARTITION BY ts, region ORDER BY vsurge DESC, entity) AS rank FROM feats WHERE {FLOW}) WHERE rank <= 6",
    "ts region entity", "rank", "volume_surge",
)
def _(spark, sf):
    d = dg.diagnose(features(spark, sf)).join(dg.volume_surge(v.bars(spark, sf)).select("entity", "ts", "volume_surge"), ["entity", "ts"])
    return sel.money_flow(d, ["ts", "region"])


@register(
    "screen_table", "P14", f"WITH {CAND} --final SELECT entity, region, prob_up AS model_score, regime, eligible, quality_grade, eligibility_reasons FROM cand",
    "entity region regime eligible quality_grade eligibility_reasons", "", "model_score",
)
def _(spark, sf):
    c = candidates(spark, sf).withColumn("eligibility_reasons", F.array_join("eligibility_reasons", ","))
    return sel.screen_table(c.withColumnRenamed("prob_up", "model_score"))


@register(
    "detail_table", "P18 G2",
    f"""WITH {DIAG} --final SELECT entity, region, ts AS as_of, regime, round_even(close, 2) AS last_close, vsurge AS volume_surge, round_even(mom60 * 100, 1) AS mom60_pct,
      round_even(vol20 * 100, 1) AS realized_vol, array_to_string(flags, ',') AS flags FROM diag WHERE lead_ts IS NULL""",
    "entity region as_of regime flags", "", "last_close volume_surge mom60_pct realized_vol",
)
def _(spark, sf):
    d = dg.diagnose(features(spark, sf)).join(dg.volume_surge(v.bars(spark, sf)).select("entity", "ts", "volume_surge"), ["entity", "ts"])
    return dg.detail_table(src.latest_snapshot_rows(d)).withColumn("flags", F.array_join("risk_flags", ","))


# Long/flat curve from the sign of the prediction.
CURVE = """c0 AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS sig FROM pred),
c1 AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS now, lag(close) OVER w AS pc, lead(ts) OVER w IS NULL AS fin, row_number() OVER w AS n,
  CASE region WHEN 'KR' THEN 0.00015 ELSE 0 END AS bf, CASE region WHEN 'KR' THEN 0.00165 ELSE 0 END AS sf FROM c0 WINDOW w AS (PARTITION BY entity ORDER BY ts)),
c2 AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY entity ORDER BY ts), 0) AS was FROM c1),
c3 AS (SELECT *, CASE WHEN was = 0 AND now = 1 THEN close / (open * 1.001 * (1 + bf)) WHEN was = 1 AND now = 1 THEN close / pc WHEN was = 1 THEN open * 0.999 * (1 - sf) / pc ELSE 1 END
  * CASE WHEN fin AND now = 1 THEN 0.999 * (1 - sf) ELSE 1 END AS growth, CAST(was <> now AS INTEGER) + CAST(fin AND now = 1 AS INTEGER) AS trades FROM c2),
curve AS (SELECT *, exp(sum(ln(growth)) OVER (PARTITION BY entity ORDER BY ts)) AS value, CASE WHEN fin THEN 0 ELSE now END AS position FROM c3 WHERE n > 1)"""


def curve(spark, sf):
    p = predictions(spark, sf).withColumn("signal", (F.col("prob_cal") >= 0.5).cast("int"))
    return pf.equity_curve(p)


@register("equity_curve", "B7 J11", f"{P}, {CURVE} --final SELECT * FROM curve", "entity ts", "position trades", "value")
def _(spark, sf):
    return curve(spark, sf)


@register(
    "curve_stats", "B8",
    f"""{P}, {CURVE}, k1 AS (SELECT *, CASE WHEN n > 2 THEN growth - 1 END AS r, value / max(value) OVER (PARTITION BY entity ORDER BY ts) - 1 AS dd FROM curve),
    k2 AS (SELECT entity, arg_max(value, ts) AS fin, greatest((max(ts) - min(ts)) / 365.25::DOUBLE, 1e-9) AS yrs, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS dn, min(dd) AS mdd,
      sum(trades) AS num_trades, arg_max(close, ts) / arg_min(open, ts) - 1 AS bh FROM k1 GROUP BY 1)
    --final SELECT entity, (pow(fin, 1 / yrs) - 1) * 100 AS annual_return, (fin - 1) * 100 AS total_return, sd * sqrt(252) * 100 AS volatility, mu / sd * sqrt(252) AS sharpe,
      mu / dn * sqrt(252) AS sortino, mdd * 100 AS max_drawdown, bh * 100 AS buy_hold_return, num_trades FROM k2""",
    "entity", "num_trades", "annual_return:2 total_return:2 volatility:2 sharpe:2 sortino:2 max_drawdown:2 buy_hold_return:2",
)
def _(spark, sf):
    return pf.curve_stats(curve(spark, sf))


# ----------------------------------------------------------------------- ledger
MODEL, SCHEMA = "scoring-1", "1.0"


def signals(spark, sf):
    return stage_table(spark, f"{sf}/signals", lambda: fresh_signals(spark, sf))


def fresh_signals(spark, sf):
    snap = src.month_snapshot(v.bars(spark, sf))
    details = snap.select("as_of", "entity", F.col("as_of").alias("ts"), round_even("close", 2).alias("last_close"))
    return lg.ledger_records(rows(spark, sf), details, model_version=MODEL, schema_version=SCHEMA, benchmarks={"US": "US", "KR": "KR"})


SIG = f"""{RR}, sig AS (SELECT concat_ws('|', CAST(r.as_of AS VARCHAR), r.region, r.entity, '{MODEL}') AS id, r.as_of AS date, r.ts AS bar_ts, r.entity, r.region, '{MODEL}' AS model_version, r.view, r.alpha, r.alpha_percentile,
  round_even(b.close, 2) AS ref_close, r.region AS benchmark FROM rows r JOIN bars b ON r.entity = b.entity AND r.ts = b.ts WHERE NOT data_insufficient)"""


@register("ledger_records", "A21", f"WITH {SIG} --final SELECT * FROM sig", "id date entity region model_version view benchmark", "alpha_percentile", "alpha ref_close")
def _(spark, sf):
    return fresh_signals(spark, sf)


# Offered rows: all signals; stored ones: those of odd months, plus one undated row offered.
@register(
    "ledger_append_if_absent", "J9 R2",
    f"""WITH {SIG}, old AS (SELECT id FROM sig WHERE month(date) % 2 = 1) --final SELECT * FROM sig WHERE id NOT IN (SELECT id FROM old)""",
    "id date entity", "", "alpha",
)
def _(spark, sf):
    s = signals(spark, sf)
    offered = s.unionByName(s.withColumn("alpha", F.col("alpha") + 1)).unionByName(s.withColumn("date", F.lit(None).cast("date")))
    return lg.append_new(s.where(F.month("date") % 2 == 1), offered, ["date", "alpha"])


@register(
    "asof_backward_match", "J4",
    f"""WITH {v.BARS}, s AS (SELECT entity, month_end AS day FROM bars GROUP BY 1, 2) --final SELECT s.entity, s.day, b.ts AS bar_ts, b.close AS bar_close FROM s ASOF JOIN bars b ON s.entity = b.entity AND s.day >= b.ts""",
    "entity day bar_ts", "", "bar_close:4",
)
def _(spark, sf):
    b = v.bars(spark, sf)
    s = b.select("entity", F.last_day("ts").alias("day")).distinct()
    return lg.asof_backward(s, b, "day")


def _path(h: int) -> str:
    o = f"OVER (PARTITION BY entity ORDER BY ts ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)"
    return (f"SELECT entity, region, ts, {h} AS horizon, lead(ts, {h}) {W} AS end_ts, lead(close, {h}) {W} / close - 1 AS fwd, "
            f"max(close) {o} / close - 1 AS mfe, min(close) {o} / close - 1 AS mae FROM bars")


PATHS = "paths AS (" + " UNION ALL ".join(_path(h) for h in lg.HORIZONS) + ")"


@register("forward_paths", "J5 A22", f"WITH {v.BARS}, {PATHS} --final SELECT * FROM paths WHERE end_ts IS NOT NULL", "entity ts end_ts", "horizon", "fwd mfe mae")
def _(spark, sf):
    return lg.forward_paths(v.bars(spark, sf))


OUT = f"""{SIG}, {PATHS}, outc AS (SELECT s.id, s.date, s.entity, s.region, s.view, s.alpha, p.horizon, round_even(p.fwd, 4) AS fwd, round_even(p.fwd - (b1.bench / b0.bench - 1), 4) AS excess,
  round_even(p.mfe, 4) AS mfe, round_even(p.mae, 4) AS mae FROM sig s JOIN paths p ON s.entity = p.entity AND s.bar_ts = p.ts AND p.end_ts IS NOT NULL
  LEFT JOIN bench b0 ON b0.region = s.benchmark AND b0.ts = p.ts LEFT JOIN bench b1 ON b1.region = s.benchmark AND b1.ts = p.end_ts)"""


def outs(spark, sf):
    return stage_table(spark, f"{sf}/outcomes", lambda: fresh_outs(spark, sf))


def fresh_outs(spark, sf):
    b = v.bars(spark, sf)
    return lg.outcomes(signals(spark, sf), b, v.benchmark(b).withColumnRenamed("region", "benchmark"))


@register("signal_outcomes", "A22 J4 J5 J6 R3", f"WITH {OUT} --final SELECT * FROM outc", "id date entity region view", "horizon", "alpha fwd excess mfe mae")
def _(spark, sf):
    return fresh_outs(spark, sf)


# Greedy date selection as a recursive query.
NOV = f"""od AS (SELECT DISTINCT horizon, date FROM outc),
nov AS (SELECT horizon, min(date) AS date FROM od GROUP BY 1 UNION ALL
  SELECT n.horizon, (SELECT min(o.date) FROM od o WHERE o.horizon = n.horizon AND o.date >= {bday_sql('n.date', 'n.horizon')}) FROM nov n
  WHERE EXISTS (SELECT 1 FROM od o WHERE o.horizon = n.horizon AND o.date >= {bday_sql('n.date', 'n.horizon')})),
smp AS (SELECT o.* FROM outc o JOIN nov n ON n.horizon = o.horizon AND n.date = o.date)"""
RO = f"WITH RECURSIVE {OUT}, {NOV}"


@register("non_overlapping_dates", "A24", f"{RO} --final SELECT * FROM nov", "date", "horizon")
def _(spark, sf):
    return lg.non_overlapping(outs(spark, sf))


IC = """rk AS (SELECT *, rank() OVER (PARTITION BY horizon, date, region ORDER BY alpha) + (count(*) OVER (PARTITION BY horizon, date, region, alpha) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY horizon, date, region ORDER BY fwd) + (count(*) OVER (PARTITION BY horizon, date, region, fwd) - 1) / 2.0 AS rf FROM smp WHERE alpha IS NOT NULL),
ic AS (SELECT horizon, date, region, count(*) AS n, corr(ra, rf) AS ic FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(DISTINCT alpha) > 1 AND count(DISTINCT fwd) > 1)"""


def sample(spark, sf):
    return lg.sampled(outs(spark, sf))


@register("rank_ic", "A25 J10", f"{RO}, {IC} --final SELECT * FROM ic", "date region", "horizon n", "ic")
def _(spark, sf):
    return lg.rank_ic(sample(spark, sf))


@register("rank_ic_summary", "A25", f"{RO}, {IC} --final SELECT horizon, round_even(avg(i), 3) AS mean_ic, round_even(median(i), 3) AS median_ic, round_even(avg(CASE WHEN i > 0 THEN 1.0 ELSE 0.0 END), 3) AS hit_ratio, count(*) AS cross_sections, sum(n) AS n_signals FROM (SELECT *, round_even(ic, 6) AS i FROM ic) GROUP BY 1",
          "", "horizon cross_sections n_signals", "mean_ic median_ic hit_ratio", 3)
def _(spark, sf):
    return lg.ic_summary(lg.rank_ic(sample(spark, sf)))


@register("rank_ic_by_region", "A25", f"{RO}, {IC} --final SELECT horizon, region, round_even(avg(ic), 3) AS mean_ic, round_even(median(ic), 3) AS median_ic, round_even(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 3) AS hit_ratio, count(*) AS cross_sections, sum(n) AS n_signals FROM ic GROUP BY 1, 2",
          "region", "horizon cross_sections n_signals", "mean_ic median_ic hit_ratio", 3)
def _(spark, sf):
    return lg.ic_summary(lg.rank_ic(sample(spark, sf)), by_region=True)


@register(
    "signal_performance", "A26",
    f"""{RO} --final SELECT horizon, count(*) AS n, round_even(avg(excess), 4) AS mean_excess, round_even(avg(excess) - 0.001, 4) AS mean_excess_after_cost, round_even(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) FILTER (view = 'POSITIVE'), 3) AS positive_hit_rate,
      count(*) FILTER (view = 'POSITIVE') AS n_positive, round_even(avg(fwd) FILTER (view = 'POSITIVE'), 4) AS fwd_positive, count(*) FILTER (view = 'NEUTRAL') AS n_neutral, round_even(avg(fwd) FILTER (view = 'NEUTRAL'), 4) AS fwd_neutral,
      count(*) FILTER (view = 'NEGATIVE') AS n_negative, round_even(avg(fwd) FILTER (view = 'NEGATIVE'), 4) AS fwd_negative FROM smp GROUP BY 1""",
    "", "horizon n n_positive n_neutral n_negative", "mean_excess mean_excess_after_cost positive_hit_rate:3 fwd_positive fwd_neutral fwd_negative", 4,
)
def _(spark, sf):
    return lg.signal_perf(sample(spark, sf))


@register(
    "basket_risk", "A27",
    f"""{RO}, bk AS (SELECT horizon, date, avg(fwd) AS r FROM smp WHERE view = 'POSITIVE' GROUP BY 1, 2),
    eq AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY horizon ORDER BY date)) AS e, row_number() OVER (PARTITION BY horizon ORDER BY r) AS worst, count(*) OVER (PARTITION BY horizon) AS n FROM bk),
    pk AS (SELECT *, e / max(e) OVER (PARTITION BY horizon ORDER BY date) - 1 AS dd FROM eq)
    --final SELECT horizon, count(*) AS n_dates, min(dd) AS mdd, avg(r) FILTER (worst <= greatest(1, ceil(n * 0.05))) AS cvar95 FROM pk GROUP BY 1""",
    "", "horizon n_dates", "mdd cvar95", 4,
)
def _(spark, sf):
    return lg.basket_risk(sample(spark, sf))


@register(
    "validation_status", "A28",
    f"""{RO}, {IC}, d AS (SELECT min(date) AS a, max(date) AS z, count(*) FILTER (horizon = 126) AS m FROM outc),
    s AS (SELECT (SELECT count(*) FROM generate_series(a, z, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) AS paper_days, m AS matured_signals, (SELECT count(*) FROM ic WHERE horizon = 63) AS cross_sections FROM d)
    , e AS (SELECT count(DISTINCT date) AS eligible_dates, round_even(avg(excess) - 0.001, 4) AS excess_after_cost FROM smp WHERE horizon = 63),
    bk AS (SELECT date, avg(fwd) AS r FROM smp WHERE view = 'POSITIVE' AND horizon = 63 GROUP BY 1),
    eq AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS e, row_number() OVER (ORDER BY r) AS worst, count(*) OVER () AS n FROM bk),
    rb AS (SELECT round_even(min(dd), 4) AS mdd, round_even(avg(r) FILTER (worst <= greatest(1, ceil(n * 0.05))), 4) AS cvar95 FROM (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM eq)),
    ri AS (SELECT coalesce(string_agg(region || '=' || CAST(round_even(m * 1000, 0) AS BIGINT) || '/' || k, ',' ORDER BY region), '') AS region_ic FROM (SELECT region, round_even(avg(ic), 3) AS m, count(*) AS k FROM ic WHERE horizon = 63 GROUP BY 1))
    --final SELECT *, paper_days >= 126 AND matured_signals > 0 AND cross_sections > 0 AS live_validation_eligible, false AS live_validated,
      CASE WHEN paper_days >= 126 AND matured_signals > 0 AND cross_sections > 0 THEN 'manual_review_required; auto-promotion_disabled' ELSE
      concat_ws(',', CASE WHEN paper_days < 126 THEN 'paper_history_below_126_business_days' END, CASE WHEN matured_signals = 0 THEN 'no_126d_matured_signals' END) END AS reasons FROM s, e, rb, ri""",
    "region_ic live_validation_eligible live_validated reasons", "paper_days matured_signals cross_sections eligible_dates", "excess_after_cost mdd cvar95", 4,
)
def _(spark, sf):
    one = lambda r: F.concat(r["region"], F.lit("="), round_even(r["mean_ic"] * 1000, 0).cast("long").cast("string"), F.lit("/"), r["n_dates"].cast("string"))
    status = lg.validation_status(outs(spark, sf))
    return status.withColumns({"reasons": F.array_join("reasons", ","), "region_ic": F.array_join(F.transform("region_ic", one), ",")})


@register(
    "signal_horizon_map", "A22",
    f"""{RO}, hm AS (SELECT id, string_agg(horizon || ':' || CAST(round_even(fwd * 10000, 0) AS BIGINT), ',' ORDER BY CAST(horizon AS VARCHAR)) AS horizons FROM outc GROUP BY 1)
    --final SELECT * FROM hm""",
    "id horizons",
)
def _(spark, sf):
    maps = lg.horizon_map(outs(spark, sf))
    bps = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), round_even(e["value"]["fwd"] * 10000, 0).cast("long").cast("string"))
    return maps.select("id", F.array_join(F.transform(F.sort_array(F.map_entries("horizons")), bps), ",").alias("horizons"))


# ------------------------------------------------------------ factor validation
FIC = """cal AS (SELECT region, ts, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY region) AS len FROM (SELECT DISTINCT region, ts FROM bars)),
px AS (SELECT b.entity, b.region, b.close, c.i FROM bars b JOIN cal c ON b.region = c.region AND b.ts = c.ts),
anc AS (SELECT region, ts AS date, i AS a FROM cal WHERE i >= 252 AND (i - 252) % 21 = 0 AND i < len - 63 AND len >= 252 + 63 + 21),
fwd AS (SELECT n.entity, n.region, n.i AS a, t.close / n.close - 1 AS fwd FROM px n JOIN px t ON n.entity = t.entity AND n.region = t.region AND t.i = n.i + 63)"""
FMOM = "sc AS (SELECT p.entity, p.region, p.i + 21 AS a, p.close / q.close - 1 AS score FROM px p JOIN px q ON p.entity = q.entity AND p.region = q.region AND q.i = p.i - 231)"
# Low volatility by laying out the padded daily frame.
FVOL = """fr AS (SELECT e.entity, a.region, a.a, c.i, p.close FROM anc a JOIN (SELECT DISTINCT entity, region FROM px) e ON e.region = a.region
  JOIN cal c ON c.region = a.region AND c.i BETWEEN a.a - 252 AND a.a - 1 LEFT JOIN px p ON p.entity = e.entity AND p.region = a.region AND p.i = c.i),
fp AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY entity, region, a ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM fr),
fq AS (SELECT *, pad / lag(pad) OVER (PARTITION BY entity, region, a ORDER BY i) - 1 AS r FROM fp),
sc AS (SELECT entity, region, a, -stddev_samp(r) AS score FROM fq GROUP BY 1, 2, 3)"""
FRANK = """cm AS (SELECT s.region, n.date, s.score, f.fwd FROM sc s JOIN fwd f ON s.entity = f.entity AND s.region = f.region AND s.a = f.a JOIN anc n ON n.region = s.region AND n.a = s.a WHERE s.score IS NOT NULL AND f.fwd IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY region, date ORDER BY score) + (count(*) OVER (PARTITION BY region, date, score) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY region, date ORDER BY fwd) + (count(*) OVER (PARTITION BY region, date, fwd) - 1) / 2.0 AS rf FROM cm),
ics AS (SELECT region, date, round_even(corr(rs, rf), 3) AS rank_ic, count(*) AS n FROM rk GROUP BY 1, 2 HAVING count(*) >= 5)"""

for _name, _score in (("momentum", FMOM), ("lowvol", FVOL)):

    @register(f"factor_ic_{_name}", "A20", f"WITH {v.BARS}, {FIC}, {_score}, {FRANK} --final SELECT * FROM ics", "region date", "n", "rank_ic")
    def _(spark, sf, factor=_name):
        return lg.factor_ic(v.bars(spark, sf), factor)

    @register(
        f"factor_ic_summary_{_name}", "A20",
        f"""WITH {v.BARS}, {FIC}, {_score}, {FRANK} --final SELECT region, count(*) AS n, round_even(avg(rank_ic), 3) AS mean_ic, round_even(avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END), 3) AS hit_rate,
          avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(count(*)) AS t_stat FROM ics GROUP BY 1""",
        "region", "n", "mean_ic hit_rate t_stat:2", 3,
    )
    def _(spark, sf, factor=_name):
        return lg.factor_ic_summary(lg.factor_ic(v.bars(spark, sf), factor))
