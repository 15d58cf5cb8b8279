"""Cross-section, entry timing, selection and table queries (month-end as-of dates)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crosssection as cx
from ..operators import diagnosis as dg
from ..operators import portfolio as pf
from ..operators import selection as sel
from ..functions.ranks import percentile_rank
from ..session import stage_table
from ..sources import bars as src
from ..sources import fundamentals as fnd
from . import views as v
from .catalog import register
from .diagnosis_queries import DIAG, ENTRYF, features
from .feature_queries import W

FIELDS = ["earnings_yield", "fwd_earnings_yield", "book_yield", "fcf_yield", "roe", "op_margin",
          "profit_margin", "earnings_growth", "debt_to_equity"]


def xsec_inputs(spark, sf):
    """The stored month-end cross-section inputs."""
    return stage_table(spark, f"{sf}/xsec", lambda: fresh_xsec(spark, sf))


def scored(spark, sf):
    """The stored scored cross-section."""
    return stage_table(spark, f"{sf}/scored", lambda: cx.score_cross_section(xsec_inputs(spark, sf)))


def fresh_xsec(spark, sf):
    """(as_of, region, entity) with price inputs, risk block, fundamentals and diagnosis."""
    bars = v.bars(spark, sf)
    panel = cx.price_inputs(bars)
    panel = dg.max_drawdown(panel, out="max_dd_252")
    snap = src.month_snapshot(panel).select(
        "entity", "region", "sector", "ts", "as_of", "mom_12_1", "mom_6m", "max_dd_252")
    anchors = snap.select("entity", "ts", "as_of")
    risk = cx.trailing_risk(bars.select("entity", "ts", "close"), anchors)
    beta = cx.trailing_beta(bars.select("entity", "region", "ts", "close"), v.benchmark(bars), ["region", "ts"], anchors)
    diag = src.month_snapshot(dg.diagnose(features(spark, sf))).select("entity", "as_of", "above_ma200", "regime")
    fund = v.fundamentals(spark, sf).select("entity", *FIELDS)
    key = ["entity", "as_of"]
    return snap.join(risk, key, "left").join(beta, key, "left").join(diag, key, "left").join(fund, "entity", "left")


XS = f"""{DIAG}, {v.FUND},
px AS (SELECT *, CASE WHEN pos >= 273 THEN lag(close, 20) {W} / lag(close, 251) {W} - 1 END AS mom_12_1,
  CASE WHEN pos >= 126 THEN close / lag(close, 125) {W} - 1 END AS mom_6m FROM bars),
rw AS (SELECT a.entity, a.ts AS at_ts, b.r, n.br FROM anchors a JOIN feats b ON a.entity = b.entity AND b.pos BETWEEN a.pos - 251 AND a.pos
  LEFT JOIN (SELECT *, bench / lag(bench) OVER (PARTITION BY region ORDER BY ts) - 1 AS br FROM bench) n ON n.region = b.region AND n.ts = b.ts WHERE b.r IS NOT NULL),
rq AS (SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY entity, at_ts) AS q FROM rw),
risk AS (SELECT entity, at_ts AS ts, CASE WHEN count(r) >= 60 THEN stddev_samp(r) * sqrt(252) END AS vol252,
  CASE WHEN count(*) FILTER (r < 0) >= 20 THEN sqrt(avg(r * r) FILTER (r < 0)) * sqrt(252) END AS downside_vol,
  CASE WHEN count(r) >= 60 THEN -avg(r) FILTER (r <= q) * 100 END AS cvar95,
  CASE WHEN count(br) >= 60 THEN covar_samp(r, br) / nullif(var_samp(CASE WHEN br IS NOT NULL THEN br END), 0) END AS beta FROM rq GROUP BY 1, 2),
xs AS (SELECT d.month_end AS as_of, d.region, d.entity, d.sector, d.ts, p.mom_12_1, p.mom_6m, d.max_dd AS max_dd_252, k.vol252, k.downside_vol, k.cvar95, k.beta,
  coalesce(d.close > d.ma200, false) AS above_ma200, d.regime, {', '.join('f.' + c for c in FIELDS)}
  FROM diag d JOIN px p USING (entity, ts) LEFT JOIN risk k USING (entity, ts) LEFT JOIN fund f USING (entity))"""


@register(
    "price_momentum_inputs", "X5", f"WITH {XS} --final SELECT as_of, entity, mom_12_1, mom_6m FROM xs", "as_of entity", "", "mom_12_1 mom_6m",
)
def _(spark, sf):
    return src.month_snapshot(cx.price_inputs(v.bars(spark, sf)))


@register(
    "trailing_risk", "X6 X7 X8", f"WITH {XS} --final SELECT as_of, entity, vol252, downside_vol, cvar95 FROM xs WHERE vol252 IS NOT NULL",
    "as_of entity", "", "vol252 downside_vol cvar95",
)
def _(spark, sf):
    bars = v.bars(spark, sf)
    return cx.trailing_risk(bars, src.month_snapshot(bars)).where("vol252 IS NOT NULL")


@register("trailing_beta", "X9 J7", f"WITH {XS} --final SELECT as_of, entity, beta FROM xs WHERE beta IS NOT NULL", "as_of entity", "", "beta")
def _(spark, sf):
    bars = v.bars(spark, sf)
    return cx.trailing_beta(bars, v.benchmark(bars), ["region", "ts"], src.month_snapshot(bars)).where("beta IS NOT NULL")


def z_sql(c: str, part: str) -> str:
    o = f"OVER (PARTITION BY {part})"
    return (f"CASE WHEN count({c}) {o} >= 3 AND {c} IS NOT NULL THEN least(greatest(({c} - avg({c}) {o}) / "
            f"CASE WHEN stddev_pop({c}) {o} = 0 THEN 1 ELSE stddev_pop({c}) {o} END, -2.5), 2.5) END")


def snz_sql(c: str) -> str:
    s = "as_of, region, sector"
    return (f"CASE WHEN sector IS NOT NULL AND count(*) OVER (PARTITION BY {s}) >= 4 AND count({c}) OVER (PARTITION BY {s}) >= 3 "
            f"THEN {z_sql(c, s)} ELSE {z_sql(c, 'as_of, region')} END")


@register(
    "winsorized_z", "X1", f"WITH {XS} --final SELECT as_of, region, entity, {z_sql('mom_6m', 'as_of, region')} AS mom_6m_z, {z_sql('roe', 'as_of, region')} AS roe_z FROM xs",
    "as_of region entity", "", "mom_6m_z roe_z",
)
def _(spark, sf):
    snap = src.month_snapshot(cx.price_inputs(v.bars(spark, sf))).join(v.fundamentals(spark, sf).select("entity", "roe"), "entity", "left")
    return cx.zscore(snap.select("as_of", "region", "entity", "mom_6m", "roe"), ["mom_6m", "roe"])


@register(
    "sector_neutral_z", "X2", f"WITH {XS} --final SELECT as_of, region, entity, {snz_sql('mom_12_1')} AS mom_12_1_z, {snz_sql('op_margin')} AS op_margin_z FROM xs",
    "as_of region entity", "", "mom_12_1_z op_margin_z",
)
def _(spark, sf):
    snap = src.month_snapshot(cx.price_inputs(v.bars(spark, sf))).join(v.fundamentals(spark, sf).select("entity", "op_margin"), "entity", "left")
    return cx.sector_neutral_z(snap.select("as_of", "region", "sector", "entity", "mom_12_1", "op_margin"), ["mom_12_1", "op_margin"])


def mean_sql(cs: list[str]) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in cs)
    n = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cs)
    return f"({total}) / nullif({n}, 0)"


_RAW = ["mom_12_1", "mom_6m", "earnings_yield", "fwd_earnings_yield", "book_yield", "fcf_yield", "roe", "op_margin",
        "profit_margin", "earnings_growth", "lev", "low"]
_FIN = FIELDS
_WS = {"momentum": 0.30, "value": 0.25, "quality": 0.25, "lowvol": 0.20}
_SQ = {"momentum": 1.0, "value": 0.6, "quality": 0.6, "lowvol": 1.0}
SLEEVES = f"""xl AS (SELECT *, CASE WHEN sector IS NULL OR sector NOT IN ('Financials', 'Utilities', 'Real Estate', 'Holding') THEN -debt_to_equity END AS lev, -vol252 AS low
  FROM (SELECT *, count(*) OVER (PARTITION BY as_of, region) AS members FROM xs) WHERE members >= 5),
zz AS (SELECT *, {', '.join(f'{snz_sql(c)} AS {c}_z' for c in _RAW)} FROM xl),
sleeves AS (SELECT *, {mean_sql(['mom_12_1_z', 'mom_6m_z'])} AS momentum,
  {mean_sql(['earnings_yield_z', 'fwd_earnings_yield_z', 'book_yield_z', 'fcf_yield_z'])} AS value,
  {mean_sql(['roe_z', 'op_margin_z', 'profit_margin_z', 'earnings_growth_z', 'lev_z'])} AS quality, low_z AS lowvol FROM zz)"""
EVID = f"""ev0 AS (SELECT *, {' + '.join(f'CAST({s} IS NOT NULL AS INTEGER)' for s in _WS)} AS sleeves_present,
  ({' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _FIN)}) / 9.0::DOUBLE AS financial_coverage FROM sleeves),
ev AS (SELECT *, sleeves_present / 4.0::DOUBLE AS factor_coverage,
  coalesce(({' + '.join(f'CASE WHEN {s} IS NOT NULL THEN {q}::DOUBLE ELSE 0 END' for s, q in _SQ.items())}) / nullif(sleeves_present, 0), 0) AS source_quality FROM ev0),
al0 AS (SELECT *, least(greatest(0.5::DOUBLE * factor_coverage + 0.3::DOUBLE * financial_coverage + 0.2::DOUBLE * source_quality, 0), 1) AS evidence,
  ({' + '.join(f'coalesce({s}, 0) * {w}::DOUBLE' for s, w in _WS.items())}) / nullif({' + '.join(f'CASE WHEN {s} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END' for s, w in _WS.items())}, 0) AS raw_alpha FROM ev),
scored AS (SELECT * FROM (SELECT *, raw_alpha * evidence AS alpha,
  coalesce(value > 0.5 AND quality < -0.3 AND (coalesce(fcf_yield, 0) <= 0 OR coalesce(earnings_growth, 0) < 0), false) AS value_trap,
  sleeves_present < 3 OR round_even(financial_coverage, 3) < 0.4 AS data_insufficient,
  count(raw_alpha) OVER (PARTITION BY as_of, region) AS n_scored FROM al0) WHERE alpha IS NOT NULL AND n_scored >= 5)"""
SC = f"{XS}, {SLEEVES}, {EVID}"


@register(
    "factor_sleeves", "X10 X3 P11", f"WITH {XS}, {SLEEVES} --final SELECT * FROM sleeves", "as_of region entity", "", "momentum value quality lowvol",
)
def _(spark, sf):
    return cx.factor_sleeves(cx.enough(xsec_inputs(spark, sf)))


@register(
    "scored_cross_section", "X11 X12 X13 X14",
    f"WITH {SC} --final SELECT * FROM scored", "as_of region entity value_trap data_insufficient", "sleeves_present",
    "financial_coverage factor_coverage source_quality evidence raw_alpha alpha",
)
def _(spark, sf):
    return cx.score_cross_section(xsec_inputs(spark, sf))


def pct_sql(c: str, part: str = "as_of, region") -> str:
    return (f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0) "
            f"/ count({c}) OVER (PARTITION BY {part}) * 100 END")


def pct_cols(cols, digits=True):
    return ", ".join(f"round_even({pct_sql(c)}, 0) AS {c}_pct" for c in cols)


RR = f"""{SC}, pc AS (SELECT *, {pct_cols(['alpha', 'momentum', 'value', 'quality', 'lowvol'])} FROM scored),
rows AS (SELECT as_of, region, entity, sector, ts, round_even(alpha, 3) AS alpha, round_even(raw_alpha, 3) AS raw_alpha, alpha_pct AS alpha_percentile,
  CASE WHEN data_insufficient THEN 'DATA_INSUFFICIENT' WHEN alpha_pct >= 66 THEN 'POSITIVE' WHEN alpha_pct <= 33 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS view,
  round_even(factor_coverage, 3) AS evidence_coverage, round_even(financial_coverage, 3) AS data_completeness, round_even(source_quality, 3) AS source_quality,
  sleeves_present, value_trap, data_insufficient, momentum_pct AS momentum_percentile, value_pct AS value_percentile, quality_pct AS quality_percentile, lowvol_pct AS lowvol_percentile,
  round_even(vol252 * 100, 1) AS vol252_pct, round_even(downside_vol * 100, 1) AS downside_vol_pct, round_even(cvar95, 2) AS cvar95_pct,
  round_even(max_dd_252, 1) AS max_dd252_pct, round_even(beta, 2) AS beta, round_even(mom_12_1 * 100, 1) AS mom_12_1_pct, above_ma200, regime,
  alpha AS alpha_exact, downside_vol, vol252 FROM pc)"""
RR_KEEP = "as_of region entity sector view value_trap data_insufficient above_ma200 regime"
RR_INTS = "alpha_percentile sleeves_present momentum_percentile value_percentile quality_percentile lowvol_percentile"
RR_NUMS = "alpha raw_alpha evidence_coverage data_completeness source_quality vol252_pct downside_vol_pct cvar95_pct max_dd252_pct beta mom_12_1_pct"


def rows(spark, sf):
    return stage_table(spark, f"{sf}/rows", lambda: cx.research_rows(scored(spark, sf)))


@register("research_rows", "P19 X4 X14", f"WITH {RR} --final SELECT * FROM rows", RR_KEEP, RR_INTS, RR_NUMS)
def _(spark, sf):
    return rows(spark, sf)


@register(
    "percentile_rank", "X4", f"WITH {XS} --final SELECT as_of, region, entity, {pct_sql('mom_6m')} AS mom_pct, {pct_sql('roe')} AS roe_pct FROM xs",
    "as_of region entity", "", "mom_pct roe_pct",
)
def _(spark, sf):
    snap = src.month_snapshot(cx.price_inputs(v.bars(spark, sf))).join(v.fundamentals(spark, sf).select("entity", "roe"), "entity", "left")
    return percentile_rank(snap, ["as_of", "region"], ["mom_6m", "roe"], digits=None).withColumnRenamed("mom_6m_pct", "mom_pct")


TABLE = f"{RR}, tbl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, region ORDER BY alpha_exact DESC, entity) AS rank FROM rows WHERE NOT data_insufficient) WHERE rank <= 15)"


@register("research_table", "K3", f"WITH {TABLE} --final SELECT * FROM tbl", "as_of region entity view", "rank alpha_percentile", "alpha")
def _(spark, sf):
    return sel.research_table(rows(spark, sf))


@register("insufficient_names", "K7", f"WITH {RR} --final SELECT * FROM rows WHERE data_insufficient", "as_of region entity sector", "sleeves_present", "data_completeness")
def _(spark, sf):
    return sel.insufficient(rows(spark, sf))


def entry(spark, sf):
    return src.month_snapshot(dg.entry_features(features(spark, sf)))


OVER = f"""{ENTRYF}, em AS (SELECT *, month_end AS as_of FROM entryf WHERE month_end IS DISTINCT FROM last_day(lead_ts)),
oh0 AS (SELECT e.*, {mean_sql(['((rsi14 - 50) / 25.0)', '(dist200_pct / 20.0)', '((vol_spike - 1.0) * 1.5)', '(mom60_pct / 40.0)'])} AS overheat FROM em e),
oh AS (SELECT *, {pct_sql('overheat')} AS overheat_pct FROM oh0)"""
STATE = """st0 AS (SELECT *, NOT above_ma200 AND NOT above_ma50 AND coalesce(mom60_pct, 0) < 0 AS broken,
  coalesce(vol_spike, 0) >= 1.6 AND (coalesce(gap_down_pct, 0) <= -4 OR coalesce(max_adverse_pct, 0) <= -6) AS violent,
  coalesce(overheat_pct >= 85, false) OR coalesce(rsi14, 0) >= 78 OR coalesce(dist200_pct, 0) >= 25 AS hot,
  above_ma50 AND above_ma200 AND coalesce(mom60_pct, 0) > -5 AS clean FROM oh),
st AS (SELECT *, CASE WHEN broken THEN 'AVOID' WHEN violent THEN 'EVENT_RISK' WHEN hot THEN 'WAIT_FOR_PULLBACK' WHEN clean THEN 'ACCUMULATE_GRADUALLY' ELSE 'WATCH' END AS entry_state,
  CASE WHEN broken THEN 'broken_trend' WHEN violent THEN 'volatility_and_gap' WHEN hot THEN array_to_string(list_filter([
    CASE WHEN overheat_pct IS NOT NULL THEN 'hot_versus_peers' END, CASE WHEN coalesce(dist200_pct, 0) >= 25 THEN 'stretched_above_ma200' END,
    CASE WHEN coalesce(rsi14, 0) >= 78 THEN 'rsi_overbought' END], lambda x: x IS NOT NULL), ',')
  WHEN clean THEN 'trend_confirmed' WHEN NOT above_ma50 THEN 'below_ma50' ELSE 'trend_mixed' END AS reasons,
  round_even(overheat_pct, 0) AS overheat_percentile FROM st0)"""


@register("overheat", "X15", f"WITH {DIAG}, {OVER} --final SELECT * FROM oh", "as_of region entity", "", "overheat overheat_pct")
def _(spark, sf):
    return cx.overheat(entry(spark, sf))


@register("entry_state", "X16", f"WITH {DIAG}, {OVER}, {STATE} --final SELECT * FROM st", "as_of region entity entry_state reasons", "overheat_percentile")
def _(spark, sf):
    return cx.entry_state(cx.overheat(entry(spark, sf))).withColumn("reasons", F.array_join("entry_reasons", ","))


# Entry states for the sufficient names only, as the tables show them.
OVER_E = OVER.replace("FROM em e),", "FROM em e SEMI JOIN (SELECT * FROM rows WHERE NOT data_insufficient) q USING (as_of, region, entity)),")
TAGS = f"""{TABLE}, {OVER_E}, {STATE},
tagged AS (SELECT t.*, coalesce(s.entry_state, 'WATCH') AS entry_state, s.overheat_percentile FROM tbl t LEFT JOIN st s USING (as_of, region, entity))"""


def sufficient(spark, sf):
    """Sufficient research rows with entry states measured against the same names."""
    r = rows(spark, sf).where(~F.col("data_insufficient"))
    e = entry(spark, sf).drop("sector", "ts").join(r.select("as_of", "region", "entity"), ["as_of", "region", "entity"], "left_semi")
    return cx.attach_entry(r, cx.entry_state(cx.overheat(e)))


@register(
    "explain_tags", "P15",
    f"""WITH {TAGS} --final SELECT as_of, region, entity, array_to_string(list_filter([CASE WHEN momentum_percentile >= 66 THEN 'momentum_high' END,
      CASE WHEN value_percentile >= 66 THEN 'value_attractive' END, CASE WHEN quality_percentile >= 66 THEN 'quality_high' END, CASE WHEN lowvol_percentile >= 66 THEN 'low_volatility' END,
      CASE WHEN above_ma200 THEN 'above_ma200' END, CASE WHEN alpha_percentile >= 66 THEN 'alpha_high' END], lambda x: x IS NOT NULL)[1:3], ',') AS pros,
      array_to_string(list_filter([CASE WHEN value_trap THEN 'value_trap' END, CASE WHEN data_completeness < 0.6 THEN 'thin_data' END, CASE WHEN NOT above_ma200 THEN 'below_ma200' END,
      CASE WHEN quality_percentile <= 33 THEN 'quality_low' END, CASE WHEN max_dd252_pct <= -25 THEN 'deep_drawdown' END, CASE WHEN cvar95_pct >= 4 THEN 'tail_risk' END,
      CASE WHEN overheat_percentile >= 85 THEN 'overheated' END], lambda x: x IS NOT NULL)[1:3], ',') AS cons FROM tagged""",
    "as_of region entity pros cons",
)
def _(spark, sf):
    out = sel.explain_tags(sel.research_table(sufficient(spark, sf)))
    return out.withColumns({"pros": F.array_join("pros", ","), "cons": F.array_join("cons", ",")})


SCREEN = "row_number() OVER (PARTITION BY as_of ORDER BY region, rank, entity) AS screen_rank"


@register(
    "screen_actionable", "P12",
    f"WITH {TAGS} --final SELECT * FROM (SELECT *, {SCREEN} FROM tagged WHERE view = 'POSITIVE' AND entry_state = 'ACCUMULATE_GRADUALLY') WHERE screen_rank <= 8",
    "as_of region entity view entry_state", "screen_rank",
)
def _(spark, sf):
    return sel.screen_actionable(sel.research_table(sufficient(spark, sf)))


@register(
    "screen_wait", "P12",
    f"WITH {TAGS} --final SELECT * FROM (SELECT *, {SCREEN} FROM tagged WHERE view <> 'NEGATIVE' AND entry_state IN ('WAIT_FOR_PULLBACK', 'EVENT_RISK', 'AVOID')) WHERE screen_rank <= 8",
    "as_of region entity view entry_state", "screen_rank",
)
def _(spark, sf):
    return sel.screen_wait(sel.research_table(sufficient(spark, sf)))


# ------------------------------------------------------- rank-buffer selection
# A region's incumbents are the picks of its previous date: a fold over the numbered dates, which the
# SQL twin runs over all eligible names, without the library's choice of candidates.
PICKS = f"""{SC}, el AS (SELECT *, {pct_sql('alpha')} AS share FROM scored WHERE NOT data_insufficient),
days AS (SELECT as_of, region, row_number() OVER (PARTITION BY region ORDER BY as_of) AS k FROM (SELECT DISTINCT as_of, region FROM scored)),
lists AS (SELECT d.as_of, d.region, d.k, coalesce(l.names, []) AS names FROM days d LEFT JOIN (
  SELECT as_of, region, list(struct_pack(entity := entity, share := share) ORDER BY above_ma200 DESC, alpha DESC, entity) AS names FROM el GROUP BY 1, 2) l USING (as_of, region)),
walk AS (SELECT DISTINCT region, CAST(0 AS BIGINT) AS k, CAST(NULL AS DATE) AS as_of, CAST([] AS VARCHAR[]) AS prior, CAST([] AS VARCHAR[]) AS held FROM days
  UNION ALL
  SELECT region, k, as_of, prior, list_transform((good || rest)[1:least(12, greatest(len(good), least(8, len(good) + len(rest))))], lambda x: x.entity) FROM (
    SELECT l.region, l.k, l.as_of, w.held AS prior,
      list_filter(l.names, lambda x: x.share >= CASE WHEN list_contains(w.held, x.entity) THEN 72 ELSE 88 END) AS good,
      list_filter(l.names, lambda x: x.share < CASE WHEN list_contains(w.held, x.entity) THEN 72 ELSE 88 END) AS rest
    FROM walk w JOIN lists l ON l.region = w.region AND l.k = w.k + 1)),
picks AS (SELECT el.*, w.pick, list_contains(w.prior, entity) AS incumbent, share >= CASE WHEN list_contains(w.prior, entity) THEN 72 ELSE 88 END AS qualified
  FROM (SELECT as_of, region, prior, unnest(held) AS entity, unnest(range(1, len(held) + 1)) AS pick FROM walk WHERE k > 0) w JOIN el USING (as_of, region, entity))"""


def picks(spark, sf):
    return stage_table(spark, f"{sf}/picks", lambda: sel.select_over_time(scored(spark, sf)))


@register("rank_buffer_selection", "K5", f"WITH RECURSIVE {PICKS} --final SELECT * FROM picks", "as_of region entity qualified incumbent", "pick", "share")
def _(spark, sf):
    return picks(spark, sf).withColumnRenamed("alpha_share", "share")


SLEEVES = f"""{PICKS}, vol AS (SELECT as_of, region, entity, sector, coalesce(sector, 'Unclassified') AS sec, coalesce(downside_vol, vol252) AS v FROM picks),
inv AS (SELECT *, CASE WHEN v IS NOT NULL THEN 1 / greatest(v, 0.05) END AS q FROM vol),
shr AS (SELECT as_of, region, entity, sector, sec, q2 / sum(q2) OVER (PARTITION BY as_of, region) AS share
  FROM (SELECT *, coalesce(q, avg(q) OVER (PARTITION BY as_of, region), 1) AS q2 FROM inv)),
fold AS (SELECT as_of, region, entity, sector, sec, share, CAST(0 AS DOUBLE) AS w, true AS free, 0 AS k FROM shr
  UNION ALL
  SELECT as_of, region, entity, sector, sec, share, CASE WHEN held > 0.3 + 1e-9 THEN w2 * 0.3 / held ELSE w2 END, free2 AND held <= 0.3 + 1e-9, k + 1
  FROM (SELECT *, sum(w2) OVER (PARTITION BY as_of, region, sec) AS held FROM (
    SELECT *, CASE WHEN free THEN least(grown, 0.15) ELSE w END AS w2, free AND grown <= 0.15 AS free2 FROM (
      SELECT *, w + CASE WHEN free AND spare > 1e-6 THEN share / nullif(open_, 0) * spare ELSE 0 END AS grown FROM (
        SELECT *, 0.95 - sum(w) OVER (PARTITION BY as_of, region) AS spare, sum(CASE WHEN free THEN share ELSE 0 END) OVER (PARTITION BY as_of, region) AS open_
        FROM fold WHERE k < 12))))),
wsleeve AS (SELECT *, round(100 * (1 - sum(w) OVER (PARTITION BY as_of, region)), 1) AS cash_pct, round(w, 4) AS weight FROM fold WHERE k = 12)"""


@register("sleeve_weights", "B6", f"WITH RECURSIVE {SLEEVES} --final SELECT * FROM wsleeve", "as_of region entity sector", "", "weight:3 cash_pct:0")
def _(spark, sf):
    return pf.sleeve_weights(picks(spark, sf))


# Exposure over equal-weight picks, so that the SQL twin needs no weight solver.
EXPO = f"""{PICKS}, wt AS (SELECT *, 100.0 / count(*) OVER (PARTITION BY as_of, region) AS weight_pct FROM picks),
expo AS (SELECT as_of, region, coalesce(sector, 'Unclassified') AS sector, sum(weight_pct) AS exposure_pct FROM wt GROUP BY 1, 2, 3)"""


def equal_weight(p):
    n = p.groupBy("as_of", "region").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, ["as_of", "region"]).withColumn("weight_pct", 100.0 / F.col("n"))


@register("sector_exposure", "A23", f"WITH RECURSIVE {EXPO} --final SELECT * FROM expo", "as_of region sector", "", "exposure_pct", 4)
def _(spark, sf):
    return pf.sector_exposure(equal_weight(picks(spark, sf)))


@register(
    "concentration_overlay", "X17",
    f"""WITH RECURSIVE {EXPO}, {OVER}, {STATE} --final SELECT p.as_of, p.region, p.entity,
      CASE WHEN round(x.exposure_pct, 6) >= 33.4 AND s.entry_state = 'ACCUMULATE_GRADUALLY' THEN 'WATCH' ELSE s.entry_state END AS entry_state,
      s.reasons || CASE WHEN round(x.exposure_pct, 6) >= 33.4 AND s.entry_state = 'ACCUMULATE_GRADUALLY' THEN ',sector_concentration' ELSE '' END AS reasons
      FROM picks p JOIN st s USING (as_of, region, entity) JOIN expo x ON x.as_of = p.as_of AND x.region = p.region AND x.sector = p.sector""",
    "as_of region entity entry_state reasons",
)
def _(spark, sf):
    p = equal_weight(picks(spark, sf))
    e = cx.entry_state(cx.overheat(entry(spark, sf)))
    expo = pf.sector_exposure(p).withColumn("exposure_pct", F.round("exposure_pct", 6))
    out = cx.concentration_overlay(cx.attach_entry(p, e), expo, 33.4)
    return out.withColumn("reasons", F.array_join("entry_reasons", ","))


# ------------------------------------------------------ fundamentals and lists
@register(
    "clean_fundamentals", "S5", f"WITH {v.FUND} --final SELECT *, CAST(NULL AS DOUBLE) AS dividend_yield, op_margin AS operating_margin FROM f0",
    "entity", "", "trailing_pe forward_pe price_to_book roe profit_margin operating_margin debt_to_equity revenue_growth earnings_growth free_cashflow:4 market_cap:2 dividend_yield",
)
def _(spark, sf):
    return fnd.clean_fundamentals(v.raw_fundamentals(spark, sf))


@register("guarded_yields", "P10 J8", f"WITH {v.FUND} --final SELECT * FROM fund", "entity", "", "earnings_yield fwd_earnings_yield book_yield fcf_yield")
def _(spark, sf):
    return v.fundamentals(spark, sf)
