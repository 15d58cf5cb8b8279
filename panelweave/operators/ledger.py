"""Immutable signal ledger and the evaluation of its matured outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bday_add, bday_count
from ..functions.ranks import average_rank
from ..functions.stats import change, round_even
from ..functions.timewin import axis

HORIZONS = (21, 63, 126, 252)


# -------------------------------------------------------------------- records
def signal_id(*parts: str | Column) -> Column:
    text = [F.coalesce(F.nullif((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")), F.lit("UNKNOWN")) for p in parts]
    return F.concat_ws("|", *text)


def ledger_records(
    rows: DataFrame, details: DataFrame | None = None, default_date: Column | None = None,
    model_version: str | None = None, schema_version: str | None = None,
    benchmarks: dict[str, str] | None = None, regimes: DataFrame | None = None,
) -> DataFrame:
    """One immutable record per sufficient research row.

    The date is the entity's own last bar (``details``: as_of, entity, ts,
    last_close), else the default; identity is date, region, entity and model.
    """
    df = rows.where(~F.col("data_insufficient")).drop("ts", "regime")
    if details is not None:
        df = df.join(details.select("as_of", "entity", F.col("ts").alias("_own"), "last_close"), ["as_of", "entity"], "left")
    else:
        df = df.withColumns({"_own": F.lit(None).cast("date"), "last_close": F.lit(None).cast("double")})
    if regimes is not None:
        df = df.join(regimes.select("as_of", F.col("regime").alias("macro_regime")), "as_of", "left")
    else:
        df = df.withColumn("macro_regime", F.lit(None).cast("string"))
    table = F.create_map(*[F.lit(x) for kv in (benchmarks or {"": ""}).items() for x in kv])
    date = F.coalesce("_own", default_date) if default_date is not None else F.col("_own")
    version = F.lit(model_version).cast("string")
    entry = [c for c in ("entry_state",) if c in df.columns]
    df = df.withColumn("date", date)
    return df.select(
        signal_id("date", "region", "entity", version).alias("id"),
        "date", "entity", "region",
        version.alias("model_version"),
        F.lit(schema_version).cast("string").alias("schema_version"),
        "view", "alpha", "alpha_percentile",
        F.col("last_close").alias("ref_close"),
        F.try_element_at(table, F.col("region")).alias("benchmark"),
        "macro_regime", *entry,
    )


def append_new(existing: DataFrame, new: DataFrame, order: list[str] = ["date"]) -> DataFrame:
    """The rows of ``new`` that may be appended: dated, first of their id, id not stored.

    Stored rows are never touched.
    """
    w = Window.partitionBy("id").orderBy(*order)
    first = new.where(F.col("date").isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return first.join(existing.select("id"), "id", "left_anti").select(*new.columns)


def append_counts(new: DataFrame, appended: DataFrame) -> DataFrame:
    """One row: rows offered, appended and skipped."""
    tag = lambda df, x: df.select(F.lit(x).alias("_new"))
    both = tag(new, 0).unionByName(tag(appended, 1))
    n, a = F.count_if(F.col("_new") == 0), F.count_if(F.col("_new") == 1)
    return both.agg(n.alias("offered"), a.alias("appended"), (n - a).alias("skipped"))


# -------------------------------------------------------------------- outcomes
def asof_backward(signals: DataFrame, bars: DataFrame, date: str = "date") -> DataFrame:
    """Each signal with its entity's newest bar on or before its date (``bar_ts``,
    ``bar_close``); signals before the first bar are dropped.

    Both sides share one sort by entity and day: no range join.
    """
    left = signals.select("entity", F.col(date).alias("_day"), F.lit(1).alias("_signal"), F.struct(*signals.columns).alias("_s"))
    right = bars.where(F.col("close").isNotNull()).select(
        "entity", F.col("ts").alias("_day"), F.lit(0).alias("_signal"), F.struct("ts", "close").alias("_b")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("entity").orderBy("_day", "_signal").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_b", F.last("_b", ignorenulls=True).over(w))
    return both.where((F.col("_signal") == 1) & F.col("_b").isNotNull()).select(
        "_s.*", F.col("_b.ts").alias("bar_ts"), F.col("_b.close").alias("bar_close")
    )


def forward_paths(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Per bar and elapsed horizon: end date, forward return, best and worst excursion."""
    w = axis()
    b = bars.where(F.col("close").isNotNull()).select("entity", "ts", "close")
    spans = []
    for h in horizons:
        frame = w.rowsBetween(0, h)
        spans.append(
            F.struct(
                F.lit(h).alias("horizon"),
                F.lead("ts", h).over(w).alias("end_ts"),
                change(F.lead("close", h).over(w), "close").alias("fwd"),
                change(F.max("close").over(frame), "close").alias("mfe"),
                change(F.min("close").over(frame), "close").alias("mae"),
            ).alias(f"_h{h}")
        )
    cols = [f"_h{h}" for h in horizons]
    wide = b.select("entity", "ts", *spans)
    return (
        wide.select("entity", "ts", F.explode(F.array(*cols)).alias("_p"))
        .where(F.col("_p.end_ts").isNotNull())
        .select("entity", "ts", "_p.*")
    )


def outcomes(signals: DataFrame, bars: DataFrame, benchmarks: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Matured outcomes of every signal, one row per horizon that has fully elapsed.

    ``benchmarks`` is (benchmark, ts, bench).  Excess needs benchmark values on
    exactly the start and end dates; a nearby session does not count.
    """
    matched = asof_backward(signals, bars)
    paths = forward_paths(bars, horizons).withColumnRenamed("ts", "bar_ts")
    df = matched.join(paths, ["entity", "bar_ts"])
    b = benchmarks.where(F.col("bench").isNotNull())
    start = b.select("benchmark", F.col("ts").alias("bar_ts"), F.col("bench").alias("_b0"))
    end = b.select("benchmark", F.col("ts").alias("end_ts"), F.col("bench").alias("_b1"))
    df = df.join(start, ["benchmark", "bar_ts"], "left").join(end, ["benchmark", "end_ts"], "left")
    excess = F.col("fwd") - change("_b1", "_b0")
    entry = [c for c in ("entry_state",) if c in df.columns]
    return df.select(
        "id", "date", "entity", "region", "model_version", "view", "alpha", *entry, "horizon",
        round_even("fwd", 4).alias("fwd"), round_even(excess, 4).alias("excess"),
        round_even("mfe", 4).alias("mfe"), round_even("mae", 4).alias("mae"),
    )


def horizon_map(outs: DataFrame) -> DataFrame:
    """The nested export form: horizon -> {fwd, excess, mfe, mae} per signal (four entries at most)."""
    entry = F.struct(F.col("horizon").cast("string").alias("key"), F.struct("fwd", "excess", "mfe", "mae").alias("value"))
    return outs.groupBy("id", "date", "entity", "region", "model_version", "view", "alpha").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("horizons")
    )


# ------------------------------------------------------------------ evaluation
def non_overlapping(outs: DataFrame) -> DataFrame:
    """Greedy date selection per horizon: each next date at least h business days on.

    The fold runs over one horizon's distinct dates, a calendar-bounded array.
    """
    days = outs.where(F.col("date").isNotNull()).groupBy("horizon").agg(F.sort_array(F.collect_set("date")).alias("_all"))
    start = F.struct(F.lit(None).cast("date").alias("next"), F.array().cast("array<date>").alias("kept"))

    def step(state: Column, day: Column) -> Column:
        take = state["next"].isNull() | (day >= state["next"])
        return F.struct(
            F.when(take, bday_add(day, F.col("horizon"))).otherwise(state["next"]).alias("next"),
            F.when(take, F.concat(state["kept"], F.array(day))).otherwise(state["kept"]).alias("kept"),
        )

    return days.select("horizon", F.explode(F.aggregate("_all", start, step, lambda s: s["kept"])).alias("date"))


def sampled(outs: DataFrame) -> DataFrame:
    return outs.join(non_overlapping(outs), ["horizon", "date"], "left_semi")


def rank_ic(sample: DataFrame) -> DataFrame:
    """Spearman correlation of alpha and forward return per (horizon, date, region).

    Needs three valid names and two distinct values on each side.
    """
    keys = ["horizon", "date", "region"]
    df = sample.where(F.col("alpha").isNotNull()).withColumn("region", F.coalesce("region", F.lit("UNKNOWN")))
    df = average_rank(df, keys, ["alpha", "fwd"], "_ar", ["entity", "id"] if "id" in df.columns else ["entity"])
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("alpha").alias("_a0"), F.max("alpha").alias("_a1"), F.min("fwd").alias("_f0"), F.max("fwd").alias("_f1"),
        F.corr("alpha_ar", "fwd_ar").alias("ic_exact"),
    ).where((F.col("n") >= 3) & (F.col("_a0") < F.col("_a1")) & (F.col("_f0") < F.col("_f1")))
    return g.select(*keys, "n", round_even("ic_exact", 6).alias("ic"), "ic_exact")


def ic_summary(ics: DataFrame, by_region: bool = False) -> DataFrame:
    """Mean, median and hit ratio of the cross-sections; medians are over dates, a bounded group."""
    keys = ["horizon", "region"] if by_region else ["horizon"]
    c = "ic_exact" if by_region else "ic"
    return ics.groupBy(*keys).agg(
        round_even(F.avg(c), 3).alias("mean_ic"),
        round_even(F.median(c), 3).alias("median_ic"),
        round_even(F.avg((F.col(c) > 0).cast("double")), 3).alias("hit_ratio"),
        F.count(F.lit(1)).alias("cross_sections"),
        F.sum("n").alias("n_signals"),
    )


def signal_perf(sample: DataFrame) -> DataFrame:
    """Pooled excess, after-cost excess, POSITIVE hit rate and mean forward return by view."""
    of = lambda view: F.when(F.col("view") == view, F.col("fwd"))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        round_even(F.avg("excess"), 4).alias("mean_excess"),
        round_even(F.avg("excess") - 0.001, 4).alias("mean_excess_after_cost"),
        round_even(F.avg((of("POSITIVE") > 0).cast("double")), 3).alias("positive_hit_rate"),
    ]
    for view in ("POSITIVE", "NEUTRAL", "NEGATIVE"):
        aggs += [F.count(of(view)).alias(f"n_{view.lower()}"), round_even(F.avg(of(view)), 4).alias(f"fwd_{view.lower()}")]
    return sample.groupBy("horizon").agg(*aggs)


def basket_risk(sample: DataFrame) -> DataFrame:
    """Drawdown and 95% CVaR of the equal-weight POSITIVE basket.

    One mean per date, then a fold over the dates; the running peak starts at
    the first equity point.
    """
    daily = sample.where(F.col("view") == "POSITIVE").groupBy("horizon", "date").agg(F.avg("fwd").alias("r"))
    g = daily.groupBy("horizon").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "r"))), lambda x: x["r"]).alias("_r")
    )
    start = F.struct(F.lit(1.0).alias("eq"), F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("dd"))

    def step(s: Column, r: Column) -> Column:
        eq = s["eq"] * (1 + r)
        peak = F.greatest(s["peak"], eq)
        return F.struct(eq.alias("eq"), peak.alias("peak"), F.least(s["dd"], F.try_divide(eq, peak) - 1).alias("dd"))

    worst = F.greatest(F.lit(1), F.ceil(F.size("_r") * 0.05)).cast("int")
    tail = F.slice(F.sort_array("_r"), F.lit(1), worst)
    total = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x)
    return g.select(
        "horizon", F.size("_r").alias("n_dates"),
        round_even(F.aggregate("_r", start, step, lambda s: s["dd"]), 4).alias("mdd"),
        round_even(total / worst, 4).alias("cvar95"),
    )


def validation_status(outs: DataFrame, min_days: int = 126) -> DataFrame:
    """One row: paper history in business days, matured signals, the evaluation of the 63-day
    outcomes (dates, rank correlation by region, excess after cost, drawdown, CVaR), eligibility
    and reasons.

    Promotion is never automatic: ``live_validated`` stays false.
    """
    chosen = sampled(outs.where(F.col("horizon") == 63))
    ics = rank_ic(chosen)
    regions = ics.groupBy("region").agg(round_even(F.avg("ic_exact"), 3).alias("mean_ic"), F.count(F.lit(1)).alias("n_dates"))
    sides = [
        outs.agg(
            F.coalesce(bday_count(F.min("date"), F.max("date")), F.lit(0)).cast("long").alias("paper_days"),
            F.count_if(F.col("horizon") == 126).alias("matured_signals"),
        ),
        ics.agg(F.count(F.lit(1)).alias("cross_sections")),
        regions.agg(F.sort_array(F.collect_list(F.struct("region", "mean_ic", "n_dates"))).alias("region_ic")),  # a row per region
        chosen.agg(F.countDistinct("date").alias("eligible_dates"), round_even(F.avg("excess") - 0.001, 4).alias("excess_after_cost")),
        basket_risk(chosen).agg(F.max("mdd").alias("mdd"), F.max("cvar95").alias("cvar95")),
    ]
    # Each side is one row.
    df = reduce(lambda a, b: a.join(b, "_k"), [x.withColumn("_k", F.lit(1)) for x in sides]).drop("_k")
    short, none = F.col("paper_days") < min_days, F.col("matured_signals") == 0
    ok = ~short & ~none & (F.col("cross_sections") > 0)
    failing = F.filter(
        F.array(F.when(short, f"paper_history_below_{min_days}_business_days"), F.when(none, "no_126d_matured_signals")),
        lambda x: x.isNotNull(),
    )
    return df.select(
        "paper_days", "matured_signals", "cross_sections", "eligible_dates", "region_ic", "excess_after_cost", "mdd", "cvar95",
        ok.alias("live_validation_eligible"), F.lit(False).alias("live_validated"),
        F.when(ok, F.array(F.lit("manual_review_required; auto-promotion_disabled"))).otherwise(failing).alias("reasons"),
    )


# ---------------------------------------------------------- walk-forward factor IC
def _calendar(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Zero-based index over the union of all dates of a panel (calendar-bounded)."""
    days = bars.select(*keys, "ts").distinct()
    w = Window.partitionBy(*keys).orderBy("ts")
    return days.withColumn("i", F.row_number().over(w) - 1).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _on_grid(a: Column, step: int) -> Column:
    """Whether an index is a rebalance position, so that no other is shuffled."""
    return (a >= 252) & ((a - 252) % step == 0)


def _momentum_scores(d: DataFrame, keys: list[str], step: int) -> DataFrame:
    """close[i-21] / close[i-252] - 1 on the panel's shared calendar."""
    at = lambda shift, name: F.struct((F.col("i") + shift).alias("a"), F.lit(name).alias("role"))
    e = d.withColumn("_x", F.explode(F.array(at(21, "near"), at(252, "far")))).where(_on_grid(F.col("_x.a"), step))
    pick = lambda r: F.max(F.when(F.col("_x.role") == r, F.col("close")))
    return e.groupBy(*keys, "entity", F.col("_x.a").alias("a")).agg(change(pick("near"), pick("far")).alias("score"))


def _lowvol_scores(d: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Minus the deviation of daily returns over rows i-252..i-1 of the shared calendar.

    Days without a price repeat the last one, so they count as zero returns
    once the frame has its first price.
    """
    w = Window.partitionBy(*keys, "entity").orderBy("i")
    d = d.withColumn("_r", change("close", F.lag("close").over(w)))
    # Anchors on the grid 252, 252+step, ... within the next 252 days.
    first = F.greatest(F.lit(0), F.ceil((F.col("i") + 1 - 252) / step)).cast("int")
    final = F.floor(F.col("i") / step).cast("int")
    e = d.where(first <= final).withColumn("_k", F.explode(F.sequence(first, final)))
    e = e.withColumn("a", 252 + F.col("_k") * step)
    g = e.groupBy(*keys, "entity", "a").agg(
        F.min("i").alias("_f"), F.min_by("_r", "i").alias("_r0"),
        F.count("_r").alias("_k"), F.avg("_r").alias("_m"), F.var_pop("_r").alias("_v"),
    )
    # Take the frame's first return out of the moments, then pad the days without one by zeros.
    first = F.col("_r0").isNotNull()
    k = F.col("_k") - first.cast("int")
    mean = F.when(first, F.try_divide(F.col("_m") * F.col("_k") - F.col("_r0"), k)).otherwise(F.col("_m"))
    gap = F.when(first, F.col("_r0") - F.col("_m")).otherwise(0.0)
    squares = F.col("_v") * F.col("_k") - F.when(first, F.coalesce(gap * gap * F.col("_k") / F.nullif(k, F.lit(0)), F.lit(0.0))).otherwise(0.0)
    n = (F.col("a") - 1 - F.col("_f")).cast("double")
    spread = F.coalesce(F.when(k > 0, F.greatest(squares, F.lit(0.0)) + mean * mean * k * (n - k) / n), F.lit(0.0))
    var = F.when(n >= 2, spread / (n - 1))
    return g.select(*keys, "entity", "a", (-F.sqrt(var)).alias("score"))


FACTORS = {"momentum": lambda d, keys, step: _momentum_scores(d, keys, step), "lowvol": _lowvol_scores}


def factor_ic(bars: DataFrame, factor: str = "momentum", horizon: int = 63, step: int = 21, keys: list[str] = ["region"]) -> DataFrame:
    """Spearman of a price factor with the forward return at every rebalance date.

    Dates are positions on the panel's shared calendar: 252, 252+step, ... up
    to the last with a full forward span.  A price reaches its anchors by
    arithmetic on the index, so no self-join or cross-section pivot is needed.
    """
    cal = _calendar(bars, keys)
    d = bars.where(F.col("close").isNotNull()).select(*keys, "entity", "ts", "close").join(cal, [*keys, "ts"])
    on_grid = _on_grid(F.col("a"), step) & (F.col("a") < F.col("_len") - horizon)
    score = FACTORS[factor](d, keys, step).where(F.col("score").isNotNull())
    at = lambda shift, name: F.struct((F.col("i") + shift).alias("a"), F.lit(name).alias("role"))
    e = d.withColumn("_x", F.explode(F.array(at(0, "now"), at(-horizon, "then")))).where(_on_grid(F.col("_x.a"), step))
    pick = lambda r: F.max(F.when(F.col("_x.role") == r, F.col("close")))
    fwd = e.groupBy(*keys, "entity", F.col("_x.a").alias("a")).agg(change(pick("then"), pick("now")).alias("fwd"))
    size = cal.select(*keys, F.col("ts").alias("date"), F.col("i").alias("a"), "_len")
    grid = size.where(on_grid & (F.col("_len") >= 252 + horizon + step))
    both = score.join(fwd, [*keys, "entity", "a"], "left").join(grid, [*keys, "a"])
    both = average_rank_common(both, [*keys, "date"])
    return both.groupBy(*keys, "date").agg(
        round_even(F.corr("score_ar", "fwd_ar"), 3).alias("rank_ic"), F.count(F.lit(1)).alias("n")
    ).where((F.col("n") >= 5) & F.col("rank_ic").isNotNull())


def average_rank_common(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks over the names that have both a score and a forward return."""
    common = df.where(F.col("score").isNotNull() & F.col("fwd").isNotNull())
    return average_rank(common, keys, ["score", "fwd"], "_ar", ["entity"])


def factor_ic_summary(series: DataFrame, keys: list[str] = ["region"]) -> DataFrame:
    c = F.col("rank_ic")
    mean, sd, n = F.avg(c), F.stddev_samp(c), F.count(c)
    return series.groupBy(*keys).agg(
        n.alias("n"), round_even(mean, 3).alias("mean_ic"),
        round_even(F.avg((c > 0).cast("double")), 3).alias("hit_rate"),
        round_even(F.when((n > 1) & (sd > 0), mean / F.nullif(sd, F.lit(0.0)) * F.sqrt(n.cast("double"))), 2).alias("t_stat"),
    )


def recent_series(series: DataFrame, k: int = 24, keys: list[str] = ["region"]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    return series.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
