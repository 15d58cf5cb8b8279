"""Ledger immutability, outcomes, evaluation, consensus, gates, stores and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from panelweave.operators import consensus as cs
from panelweave.operators import gates as gt
from panelweave.operators import ledger as lg
from panelweave.operators import models as md
from panelweave.operators import quality as ql
from panelweave.sources import bars as src
from panelweave.sources import export as ex
from panelweave.sources import fundamentals as fnd
from panelweave.sources import ledger_store as store
from panelweave.sources.macro import derive_spread, melt_macro
from panelweave.sources.registry import read_registry
from panelweave.streaming import bars as sb
from panelweave.streaming import ledger as sl
from tests.util import bars, bdays, date, walk

SIG = "id string, date date, entity string, region string, model_version string, view string, alpha double, benchmark string"
OUT = "id string, date date, entity string, region string, view string, alpha double, horizon int, fwd double, excess double"


def test_append_is_first_wins_immutable_and_dated(spark):
    old = spark.createDataFrame([("a", date("2024-01-02"), 1.0)], "id string, date date, alpha double")
    new = spark.createDataFrame([("a", date("2024-01-02"), 9.0), ("b", date("2024-01-02"), 2.0), ("b", date("2024-01-03"), 3.0), ("c", None, 4.0)], old.schema)
    out = lg.append_new(old, new)
    assert [(r.id, r.alpha) for r in out.collect()] == [("b", 2.0)]
    c = lg.append_counts(new, out).first()
    assert (c.offered, c.appended, c.skipped) == (4, 1, 3)


def signals(spark, day):
    return spark.createDataFrame([("s1", day, "A", "US", "m", "POSITIVE", 1.0, "B")], SIG)


def test_only_elapsed_horizons_mature_and_excess_needs_exact_dates(spark):
    b = bars(spark, {"A": [100 + i for i in range(40)]})
    days = bdays(40)
    bench = spark.createDataFrame([("B", d, 100.0 + i / 2) for i, d in enumerate(days)], "benchmark string, ts date, bench double")
    out = lg.outcomes(signals(spark, days[0]), b, bench).collect()
    assert [(r.horizon, r.fwd, r.excess, r.mfe, r.mae) for r in out] == [(21, 0.21, round(0.21 - 0.105, 4), 0.21, 0.0)]
    missing_end = bench.where(F.col("ts") != F.lit(days[21]))
    assert lg.outcomes(signals(spark, days[0]), b, missing_end).first().excess is None
    # a weekend signal uses the bar before it; one before the first bar has none
    assert lg.asof_backward(signals(spark, date("2024-01-06")), b).first().bar_ts == date("2024-01-05")
    assert lg.asof_backward(signals(spark, date("2023-12-29")), b).count() == 0


def test_rank_ic_per_cross_section_and_basket(spark):
    rows = []
    for day, sign in ((date("2024-01-02"), 1), (date("2024-06-03"), -1)):
        rows += [(f"{day}{i}", day, f"T{i}", "US", "POSITIVE", float(i), 21, 0.01 * i * sign, None) for i in range(1, 6)]
    o = spark.createDataFrame(rows, OUT)
    ic = {r.date: r.ic for r in lg.rank_ic(lg.sampled(o)).collect()}
    assert ic == {date("2024-01-02"): 1.0, date("2024-06-03"): -1.0}
    s = lg.ic_summary(lg.rank_ic(o)).first()
    assert (s.mean_ic, s.hit_ratio, s.cross_sections, s.n_signals) == (0.0, 0.5, 2, 10)
    r = lg.basket_risk(o).first()
    assert r.n_dates == 2 and r.mdd == -0.03 and r.cvar95 == -0.03
    v = lg.validation_status(o).first()
    assert not v.live_validation_eligible and not v.live_validated and "no_126d_matured_signals" in v.reasons


def test_non_overlapping_is_the_greedy_choice(spark):
    days = bdays(120)
    o = spark.createDataFrame([("x", d, "A", "US", "NEUTRAL", 1.0, 21, 0.0, None) for d in days], OUT)
    got = sorted(r.date for r in lg.non_overlapping(o).collect())
    assert got == [days[i] for i in range(0, 120, 21)]


def test_quality_grades(spark):
    import random

    rng = random.Random(0)
    days = bdays(600)
    good = [(p, int(rng.random() < p)) for p in (rng.uniform(.3, .8) for _ in range(600))]
    rows = [("GOOD", 10, d, y, p) for d, (p, y) in zip(days, good)] + [("BAD", 10, d, i % 2, .1 if i % 2 else .9) for i, d in enumerate(days[:260])]
    pred = spark.createDataFrame(rows, "entity string, horizon int, ts date, actual int, prob_cal double")
    g = {r.entity: r for r in ql.grade(ql.oos_metrics(pred, 0.55)).collect()}
    assert g["GOOD"].quality_grade in ("A", "B")
    assert g["BAD"].quality_grade == "REJECT" and g["BAD"].brier_skill < 0
    high = ql.grade(ql.oos_metrics(pred.where("entity = 'BAD'"), 0.95)).first()
    assert "signal_observations_below_20" in high.eligibility_reasons


def test_fold_plan_is_purged_and_embargoed(spark):
    b = bars(spark, {"A": [1.0] * 300})
    cfg = md.ModelConfig(min_train=60, calibration=30, step=20, oos_start="2024-01-01")
    days = {d: i for i, d in enumerate(bdays(300))}
    folds = md.fold_plan(b, cfg, 21).orderBy("fold").collect()
    assert len(folds) == len(range(111, 300, 20)) - sum(1 for i in range(111, 300, 20) if i - 72 < 60)
    for f in folds:
        assert days[f.cal_start] - days[f.train_end] == 22 and days[f.test_start] - days[f.cal_end] == 22
        assert days[f.cal_end] - days[f.cal_start] == 29
    assert folds[-1].test_end == bdays(300)[-1]


# ----------------------------------------------------------------- consensus
VIEW = "id string, source_id string, theme string, verified boolean, stance double, published_at timestamp, verified_at timestamp, stale_after_days int, summary string, title string"


def test_consensus_freshness_weights_and_queue(spark):
    t = lambda days: dt.datetime(2026, 7, 1) - dt.timedelta(days=days)
    views = spark.createDataFrame(
        [("1", "a", "AI", True, 2.0, t(10), t(5), 90, "s", "x"), ("2", "a", "AI", True, -2.0, t(20), t(15), 90, "s", "x"), ("3", "b", "AI", True, 1.0, t(9), t(0), 90, "s", "x"),
         ("4", "ir", "AI", True, -1.0, t(9), t(2), 90, "s", "x"), ("5", "b", "Rates", True, 1.0, t(210), t(200), 90, "s", "x"), ("6", "b", "Rates", False, None, None, None, 90, "", "x")], VIEW)
    sources = spark.createDataFrame([("a", "House A", "assetManager", 1.0, "u"), ("b", "House B", "assetManager", 1.0, "u"), ("ir", "Corp", "companyIR", 1.0, "u")],
                                    "id string, institution string, source_type string, weight double, url string")
    c = cs.classify_views(views, "2026-07-01 00:00:00")
    assert {r.id: r.status for r in c.collect()} == {"1": "VERIFIED", "2": "VERIFIED", "3": "VERIFIED", "4": "VERIFIED", "5": "STALE", "6": "UNVERIFIED"}
    d = cs.dedup_views(c)
    assert {r.id for r in d.collect()} == {"1", "3", "4"}  # an age of zero still counts as freshest
    w = cs.weighted_views(d, sources)
    assert {r.id: r.view_weight for r in w.collect()} == {"1": 1.0, "3": 1.0, "4": 0.25}
    r = cs.consensus(w).first()
    assert (r.median_stance, r.dispersion, r.institutions, r.agreement) == (1.0, 3.0, 3, "low")
    q = {x.id: x.missing_fields for x in cs.review_queue(c, sources).collect()}
    assert q == {"5": None, "6": ["published_at", "verified_at", "stance", "summary", "verified"]}
    v = cs.verification_coverage(c, d).first()
    assert (v.candidates, v.verified, v.stale, v.awaiting, v.coverage) == (6, 3, 1, 1, 0.5)


# ----------------------------------------------------------------------- gates
META = "seed boolean, stale boolean, synthetic boolean, build_failed boolean, models_trained int, coverage_pct double, n_errors int, universe_screened int"


def test_block_reasons(spark):
    rows = [(True, True, None, None, 0, 100.0, 0, 10), (None, None, None, None, 50, 99.0, 1, 180), (None, None, None, None, 50, 99.0, 11, 100)]
    got = [r.block_reasons for r in gt.block_reasons(spark.createDataFrame(rows, META)).collect()]
    assert got == [["seed_data", "stale_data", "models_trained_zero"], [], ["pipeline_errors_excessive"]]


def test_withhold_audit_and_modes(spark):
    df = spark.createDataFrame([("A", True, 1.0), ("B", False, 2.0)], "entity string, blocked boolean, weight double")
    assert [r.weight for r in gt.withhold(df, F.col("blocked")).orderBy("entity").collect()] == [None, 2.0]
    bad = gt.stamp(df.withColumn("x", F.lit(float("nan"))), {"schema_version": "1", "model_version": "m", "run_mode": "liveValidated", "data_mode": "live", "market_as_of": None})
    got = {r.violation: r.rows for r in gt.audit(bad, "t").collect()}
    assert got == {"missing_provenance_market_as_of": 2, "liveValidated_not_earned": 2, "nan_or_infinity": 2, "blocked_row_carries_weight": 1}
    m = spark.createDataFrame([("liveValidated",), ("researchOnly",), ("x",), (None,)], "m string").select(gt.run_mode("m").alias("r"))
    assert [r.r for r in m.collect()] == ["paperTrading", "researchOnly", "paperTrading", "paperTrading"]


# --------------------------------------------------------------------- sources
def test_sanitized_json_and_state_rules(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), 5, True, [float("inf"), 1.5])], "a double, n int, f boolean, xs array<double>")
    ex.export_json(df, str(tmp_path / "out"))
    line = next(p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size).read_text()
    assert json.loads(line) == {"a": None, "n": 5, "f": True, "xs": [None, 1.5]}
    with pytest.raises(ValueError):
        ex.snapshot_state(df, {"data_mode": "seed", "validation_passed": True})
    with pytest.raises(ValueError):
        ex.snapshot_state(df, {"data_mode": "live"})


def test_registry_fundamentals_and_macro_sources(spark, tmp_path):
    p = tmp_path / "views.json"
    p.write_text(json.dumps({"views": [{"id": "v", "sourceId": "s", "publishedAt": "2024-01-02", "verified": False, "stance": None, "risks": ["a", "b"], "staleAfterDays": 90}]}, indent=1))
    r = read_registry(spark, str(p), "views").first()
    assert r.source_id == "s" and r.risks == ["a", "b"] and r.published_at == dt.datetime(2024, 1, 2) and r.stance is None
    raw = spark.createDataFrame([("A", " 12.5", True, float("inf")), ("B", "nan", False, float("nan"))], "entity string, trailing_pe string, forward_pe boolean, roe double")
    got = fnd.clean_fundamentals(raw).collect()
    assert [(x.entity, x.trailing_pe, x.forward_pe, x.roe) for x in got] == [("A", 12.5, None, None)]
    wide = spark.createDataFrame([(date("2024-01-02"), 4.0, 3.0), (date("2024-01-03"), None, 3.0)], "obs_date date, x double, y double")
    long = derive_spread(melt_macro(wide), "x", "y", "z")
    assert {(r.indicator, r.value) for r in long.collect()} == {("x", 4.0), ("y", 3.0), ("z", 1.0)}


def test_ledger_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert store.read_ledger(spark, path).count() == 0
    cols = [f.name for f in store.LEDGER_SCHEMA.fields]
    make = lambda *rows: spark.createDataFrame([{**dict.fromkeys(cols), **r} for r in rows], store.LEDGER_SCHEMA)
    a = {"id": "a", "date": date("2024-01-02"), "alpha": 1.0}
    store.append_ledger(make(a), path)
    store.append_ledger(make({**a, "alpha": 7.0}, {**a, "id": "b"}), path)
    assert {(r.id, r.alpha, r.date) for r in store.read_ledger(spark, path).collect()} == {("a", 1.0, a["date"]), ("b", 1.0, a["date"])}


# ------------------------------------------------------------------- streaming
def test_streamed_bars_equal_closed_batch_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), "click", float((i * 37) % 50)) for i in range(200)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    ev.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    sb.start_event_bars(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "event_type", sequence="event_id").awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in sb.closed_windows(sb.event_bars(ev, "event_type", sequence="event_id"), F.lit(max(r[1] for r in rows))).collect()}
    assert got == want and len(want) > 20


def test_streamed_ledger_is_idempotent_across_restart_and_duplicates(spark, tmp_path):
    cols = [f.name for f in store.LEDGER_SCHEMA.fields]
    make = lambda *rows: spark.createDataFrame([{**dict.fromkeys(cols), **r} for r in rows], store.LEDGER_SCHEMA)
    src_dir, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    a = {"id": "a", "date": date("2024-01-02"), "alpha": 1.0}
    make(a).write.mode("append").parquet(src_dir)
    run = lambda cp: sl.start_ledger_append(spark.readStream.schema(store.LEDGER_SCHEMA).parquet(src_dir), path, str(tmp_path / cp)).awaitTermination(60)
    run("cp")
    make({**a, "alpha": 5.0}, {**a, "id": "b"}).write.mode("append").parquet(src_dir)
    run("cp")
    run("cp2")  # a lost checkpoint replays everything and still writes nothing twice
    assert sorted((r.id, r.alpha) for r in store.read_ledger(spark, path).collect()) == [("a", 1.0), ("b", 1.0)]
