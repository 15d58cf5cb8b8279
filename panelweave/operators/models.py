"""Purged walk-forward direction models, pooled over entities.

Entities share one model per fold, so folds are cut by date: a calendar day
is train, calibration or test for every entity at once.  A fold is fitted on a
bounded hash sample of its window's labelled rows (``fit_rows``, ``cal_rows``), in
one task; all folds of a horizon are one job.  Dates, counts and base rates come
from all rows, and every row of a test block is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import round_even, shrink
from ..session import cut_lineage
from . import ensemble, portfolio, quality


@dataclass(frozen=True)
class ModelConfig:
    """Window lengths in dates, and the two estimators' sizes.

    ``fit_rows`` and ``cal_rows`` bound the labelled rows that a fold is fitted and calibrated on.
    """

    min_train: int = 252
    step: int = 21
    calibration: int = 252
    oos_start: str = "2020-01-01"
    alert_quantile: float = 0.80
    fallback_threshold: float = 0.70
    trees: int = 100
    depth: int = 5
    learning_rate: float = 0.05
    subsample: float = 0.8
    inverse_penalty: float = 0.1
    fit_rows: int = 10_000
    cal_rows: int = 5_000


# -------------------------------------------------------------------- fold plan
def fold_plan(panel: DataFrame, cfg: ModelConfig, horizon: int, ts: str = "ts") -> DataFrame:
    """One row per fold with its six boundary dates, purged and embargoed.

    With the test block starting at date i: calibration ends h dates before i,
    training ends h dates before calibration starts, so no forward-looking
    target of one block reaches into the next.
    """
    oos = F.lit(cfg.oos_start).cast("date")
    days = panel.agg(F.sort_array(F.collect_set(ts)).alias("_d"))  # distinct dates: calendar-bounded
    n = F.size("_d")
    need = cfg.min_train + cfg.calibration + horizon
    first_oos = F.size(F.filter("_d", lambda d: d < oos))
    start = F.greatest(F.lit(need), F.when(first_oos < n, first_oos).otherwise(F.lit(need)))
    df = days.withColumns({"_n": n, "_start": start}).where((F.col("_n") > need + cfg.step) & (F.col("_start") < F.col("_n")))
    df = df.withColumn("_i", F.explode(F.sequence("_start", F.col("_n") - 1, F.lit(cfg.step))))
    cal_end = F.col("_i") - horizon
    cal_start = cal_end - cfg.calibration
    train_end = cal_start - horizon
    at = lambda i: F.try_element_at("_d", i.cast("int"))
    df = df.where((train_end >= cfg.min_train) & (cal_start >= 0))
    return df.select(
        F.col("_i").alias("fold"),
        at(F.lit(1)).alias("train_start"), at(train_end).alias("train_end"),
        at(cal_start + 1).alias("cal_start"), at(cal_end).alias("cal_end"),
        at(F.col("_i") + 1).alias("test_start"),
        at(F.least(F.col("_i") + cfg.step, F.col("_n"))).alias("test_end"),
    )


# ------------------------------------------------------------------- estimators
def complete(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows whose inputs are all there and finite."""
    return df.dropna(subset=features).where(F.forall(F.array(*[F.col(c).cast("double") for c in features]), lambda x: F.abs(x) < float("inf")))


def _fold_rows(frame: DataFrame, folds: list[dict]) -> DataFrame:
    """(fold, role, key, x, y): the rows that each fold is fitted on (role 0) and calibrated on (1).

    A row's place on the unit interval is a hash of its key, and a fold takes the rows below its share:
    at most about ``fit_rows`` and ``cal_rows`` of them, however many the windows hold.  The folds of a
    date are one array per date, so the rows meet them in an equality join of a calendar-sized table.
    """
    spark = frame.sparkSession
    plan = spark.createDataFrame(folds, FOLD_PLAN)
    in_train = F.col("ts").between(F.col("train_start"), F.col("train_end"))
    in_cal = F.col("ts").between(F.col("cal_start"), F.col("cal_end"))
    dates = frame.select("ts").distinct().join(F.broadcast(plan), in_train | in_cal)  # dates x folds: both bounded by the calendar
    role = F.struct("fold", F.when(in_train, 0).otherwise(1).alias("role"), F.when(in_train, F.col("fit_share")).otherwise(F.col("cal_share")).alias("share"))
    dates = dates.groupBy("ts").agg(F.collect_list(role).alias("_roles"))
    place = F.pmod(F.xxhash64(F.lit(11), "key"), F.lit(1 << 30)) / float(1 << 30)
    rows = frame.join(dates, "ts").withColumn("_u", place)
    return rows.withColumn("_r", F.explode(F.filter("_roles", lambda r: F.col("_u") < r["share"]))).select("_r.fold", "_r.role", "key", "x", "y")


FOLD_PLAN = "fold int, train_start date, train_end date, cal_start date, cal_end date, fit_share double, cal_share double"


def fit_folds(frame: DataFrame, folds: list[dict], cfg: ModelConfig) -> DataFrame:
    """One model row per fold, each fitted in a task of its own: the folds run side by side over the
    cluster.  ``frame`` has ts, key, x (inputs) and y (0/1)."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("role", "ascending"), ("key", "ascending")])
        x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        y, train = t.column("y").to_numpy().astype(float), t.column("role").to_numpy() == 0
        if not train.any():
            return ensemble.MODEL_TABLE.empty_table()
        m = ensemble.fit(x[train], y[train], x[~train], y[~train], cfg.trees, cfg.depth, cfg.learning_rate, cfg.subsample, cfg.inverse_penalty)
        m |= {"fold": key[0].as_py(), "n_train": int(train.sum()), "n_cal": int((~train).sum())}
        return pa.Table.from_pylist([{c: v.ravel().tolist() if isinstance(v, np.ndarray) else v for c, v in m.items()}], ensemble.MODEL_TABLE)

    rows = _fold_rows(frame, folds)
    return cut_lineage(rows.repartition(max(1, len(folds)), "fold").groupBy("fold").applyInArrow(run, ensemble.MODEL), "fold_models")


def _unpacked(models: DataFrame, cfg: ModelConfig) -> dict[int, dict]:
    """Models by fold: their number is bounded by the calendar, their size by the configuration."""
    out = {}
    for r in models.collect():
        m = {c: np.array(r[c], float) for c in ("mean", "scale", "coef")}
        m |= {"start": r["start"], "slope": r["slope"], "offset": r["offset"]}
        m |= {c: np.array(r[c], kind).reshape(cfg.trees, -1) for c, kind in (("feature", np.int32), ("threshold", float), ("leaf", float))}
        out[r["fold"]] = m
    return out


def score_folds(rows: DataFrame, models: dict[int, dict]) -> DataFrame:
    """``rows`` (fold, x, ...) with prob_raw and prob_cal of their fold's model; rows of unfitted folds leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            raw, cal = np.full(len(fold), np.nan), np.full(len(fold), np.nan)
            for f in np.unique(fold):
                if f in models:
                    mine = fold == f
                    raw[mine] = ensemble.raw_probability(x[mine], models[f])
                    cal[mine] = ensemble.calibrated(raw[mine], models[f])
            keep = pa.array(~np.isnan(raw))
            names = [c for c in batch.schema.names if c != "x"]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(raw), pa.array(cal)], names=[*names, "prob_raw", "prob_cal"])
            yield out.filter(keep)

    schema = T.StructType([f for f in rows.schema.fields if f.name != "x"] + [T.StructField("prob_raw", T.DoubleType()), T.StructField("prob_cal", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def _framed(df: DataFrame, features: list[str], target: str, keep: list[str]) -> DataFrame:
    inputs = F.array(*[F.col(c).cast("double") for c in features]).alias("x")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in keep if c in ("entity", "ts")]).alias("key")
    return cut_lineage(complete(df, features).select(*keep, key, inputs, F.col(target).cast("int").alias("y")), "model_frame")


def _shares(per_date: list, fold: dict, cfg: ModelConfig) -> dict:
    """The fold with the shares of its windows' rows and the exact base rate of its calibration window."""
    count = lambda lo, hi: [sum(r[k] for r in per_date if fold[lo] <= r["ts"] <= fold[hi]) for k in ("n", "up")]
    n_train, n_cal, up = count("train_start", "train_end")[0], *count("cal_start", "cal_end")
    share = lambda most, n: min(1.0, most / max(1, n))
    return fold | {"fit_share": share(cfg.fit_rows, n_train), "cal_share": share(cfg.cal_rows, n_cal), "base": up / n_cal if n_cal else 0.5}


def _per_date(frame: DataFrame) -> list:
    """Labelled rows and ups of each date: calendar-sized."""
    return frame.where("y is not null").groupBy("ts").agg(F.count("y").alias("n"), F.sum("y").alias("up")).collect()


def walk_forward(df: DataFrame, features: list[str], target: str, cfg: ModelConfig, horizon: int) -> DataFrame:
    """Out-of-sample predictions of every fold: raw and calibrated probability, the
    0/1 call and the fold's boundary dates, with open and close attached."""
    keep = [c for c in ("entity", "region", "ts", "open", "close") if c in df.columns]
    frame = _framed(df.where(F.col(target).isNotNull()), features, target, keep)
    per_date = _per_date(frame)
    # Hundreds of folds at most: one per ``step`` dates.
    folds = [_shares(per_date, f.asDict(), cfg) for f in fold_plan(frame, cfg, horizon).orderBy("fold").collect()]
    spark = frame.sparkSession
    bounds = ", ".join(f"{c} date" for c in quality.FOLD_COLUMNS)
    tests = spark.createDataFrame([(f["fold"], f["base"], *(f[c] for c in quality.FOLD_COLUMNS)) for f in folds], f"fold int, base double, {bounds}")
    fitted = [{k: f[k] for k in ("fold", "train_start", "train_end", "cal_start", "cal_end", "fit_share", "cal_share")} for f in folds]
    models = _unpacked(fit_folds(frame, fitted, cfg), cfg) if folds else {}
    dates = frame.select("ts").distinct().join(F.broadcast(tests), F.col("ts").between(F.col("test_start"), F.col("test_end")))
    scored = score_folds(frame.join(dates, "ts"), models)
    n_eff = float(cfg.calibration / max(horizon, 1))
    out = scored.withColumn("prob_cal", shrink("prob_cal", F.col("base"), n_eff))
    return out.select(
        *keep, F.lit(horizon).alias("horizon"), F.col("y").alias("actual"), "prob_raw", "prob_cal",
        (F.col("prob_cal") >= 0.5).cast("int").alias("pred"), *quality.FOLD_COLUMNS,
    )


def current_signal(df: DataFrame, features: list[str], target: str, cfg: ModelConfig, horizon: int) -> DataFrame:
    """Calibrated probability of every entity's newest complete row, labelled or not.

    The last calibration window is held out of the fit and a gap of h dates
    separates both.
    """
    keep = [c for c in ("entity", "region", "ts") if c in df.columns]
    frame = _framed(df, features, target, keep)
    empty = frame.limit(0).select(*keep, F.lit(0.0).alias("prob_up"), F.lit(0.0).alias("prob_up_raw"), F.lit("").alias("prediction"))
    per_date = sorted(_per_date(frame), key=lambda r: r["ts"])
    days = [r["ts"] for r in per_date]
    if len(days) <= cfg.min_train + cfg.calibration + horizon:
        return empty
    fold = {"fold": 0, "train_start": days[0], "train_end": days[-(cfg.calibration + horizon) - 1], "cal_start": days[-cfg.calibration], "cal_end": days[-1]}
    train = [r for r in per_date if r["ts"] <= fold["train_end"]]
    if not 0 < sum(r["up"] for r in train) < sum(r["n"] for r in train):
        return empty
    fold = _shares(per_date, fold, cfg)
    base = fold.pop("base")
    models = _unpacked(fit_folds(frame.where("y is not null"), [fold], cfg), cfg)
    newest = frame.groupBy("entity").agg(F.max("ts").alias("ts"))
    scored = score_folds(frame.join(newest, ["entity", "ts"]).withColumn("fold", F.lit(0)), models)
    out = scored.withColumn("prob_cal", shrink("prob_cal", F.lit(base), float(cfg.calibration / max(horizon, 1))))
    return out.select(
        *keep, round_even("prob_cal", 4).alias("prob_up"), round_even("prob_raw", 4).alias("prob_up_raw"),
        F.when(F.col("prob_cal") >= 0.5, "UP").otherwise("DOWN").alias("prediction"),
    )


def signal_card(current: DataFrame, predictions: DataFrame, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """Per (entity, horizon): live signal, threshold, graded metrics and the curve's statistics."""
    threshold = quality.dynamic_threshold(predictions, cfg.alert_quantile, cfg.fallback_threshold)
    metrics = quality.publish(quality.grade(quality.oos_metrics(predictions, threshold)))
    curve = portfolio.equity_curve(predictions.withColumnRenamed("pred", "signal"), ("entity", "horizon"))
    stats = portfolio.curve_stats(curve, ("entity", "horizon"))
    live = current if "horizon" in current.columns else current.join(predictions.select("entity", "horizon").distinct(), "entity")
    return live.drop("region", "ts").join(metrics, ["entity", "horizon"], "left").join(stats, ["entity", "horizon"], "left")
