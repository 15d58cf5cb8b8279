"""Out-of-sample quality: metrics, calibration, thresholds, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, ratio, round_even, wilson_lower

KEYS = ["entity", "horizon"]
# Fixed values.
MIN_OOS = 126
MIN_SIGNALS = 20
RECENT_ROWS = 252
RECENT_FLOOR = -0.05
GRADE_A_LIFT = 0.05
GRADE_A_SKILL = 0.02
EXTREME_SHARE = 0.10


def horizon_stats(forward: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean up and down forward return (a zero counts as down), base rate and sample size."""
    r = F.col("forward_return")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return forward.groupBy(*keys).agg(
        zero(F.avg(F.when(r > 0, r))).alias("up_mean"),
        zero(F.avg(F.when(r <= 0, r))).alias("down_mean"),
        F.coalesce(F.avg((r > 0).cast("double")), F.lit(0.5)).alias("base_rate"),
        F.count(r).alias("sample_size"),
    )


def dynamic_threshold(pred: DataFrame, quantile: float = 0.80, fallback: float = 0.70, keys: list[str] = KEYS) -> DataFrame:
    """Alert threshold: the linear 80% quantile of the probabilities, or the fallback
    when it is missing or saturated."""
    q = pred.groupBy(*keys).agg(F.percentile("prob_cal", F.lit(quantile)).alias("_q"))
    usable = F.col("_q") < 0.999
    return q.select(*keys, round_even(F.when(usable, F.col("_q")).otherwise(fallback), 4).alias("threshold"))


def classify_alert(prob: str = "prob_up", threshold: str = "threshold") -> Column:
    p, t = F.col(prob), F.col(threshold)
    return F.when(p >= t, "STRONG BUY").when(p <= 1 - t, "STRONG SELL").otherwise("HOLD")


def calibration_error(pred: DataFrame, bins: int = 10, keys: list[str] = KEYS) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    p = clip("prob_cal", 0.0, 1.0)
    binned = pred.withColumn("_p", p).withColumn("_bin", F.least(F.floor(F.col("_p") * bins), F.lit(bins - 1)))
    per = binned.groupBy(*keys, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.abs(F.avg("actual") - F.avg("_p")).alias("_gap")
    )
    return per.groupBy(*keys).agg(ratio(F.sum(F.col("_n") * F.col("_gap")), F.sum("_n")).alias("ece"))


def oos_metrics(pred: DataFrame, threshold: DataFrame | float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    """Precision, recall, F1, Brier skill, lift and recent lift per model, in one pass.

    Input: keys, ts, actual (0/1), prob_cal.  ``threshold`` is a number or a
    (keys, threshold) table.
    """
    df = (
        pred.withColumn("threshold", F.lit(float(threshold)))
        if isinstance(threshold, (int, float))
        else pred.join(threshold, keys)
    )
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    df = df.withColumns({"_p": clip("prob_cal", 0.0, 1.0), "_recent": F.row_number().over(newest) <= RECENT_ROWS})
    y, p = F.col("actual").cast("int"), F.col("_p")
    hit = p >= F.col("threshold")
    recent = F.col("_recent")
    n = F.count(F.lit(1)).cast("double")
    count = lambda cond: F.count_if(cond).cast("double")
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        count(hit).alias("_sig"),
        count(hit & (y == 1)).alias("_tp"),
        count(y == 1).alias("_pos"),
        F.avg((p - y) * (p - y)).alias("brier"),
        count(recent).alias("_rn"),
        count(recent & (y == 1)).alias("_rpos"),
        count(recent & hit).alias("_rsig"),
        count(recent & hit & (y == 1)).alias("_rtp"),
        (count((p <= 0.01) | (p >= 0.99)) / n).alias("extreme_rate"),
        F.max("threshold").alias("threshold"),
    )
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    base = ratio("_pos", F.col("days").cast("double"))
    g = g.withColumns(
        {
            "baseline": base,
            "precision": zero("_tp", "_sig"),
            "recall": zero("_tp", "_pos"),
            "naive_brier": base * (1 - base),
            "signal_count": F.col("_sig").cast("long"),
        }
    )
    return g.select(
        *keys, "days", "threshold", "baseline", "precision", "recall",
        zero(2 * F.col("_tp"), F.col("_sig") + F.col("_pos")).alias("f1"),
        "brier", "naive_brier",
        (1 - ratio("brier", F.nullif(F.col("naive_brier"), F.lit(0.0)))).alias("brier_skill"),
        "signal_count",
        (F.col("precision") - F.col("baseline")).alias("lift"),
        (wilson_lower("_tp", "_sig") - F.col("baseline")).alias("lift_ci_lower"),
        (zero("_rtp", "_rsig") - zero("_rpos", "_rn")).alias("recent_lift"),
        "extreme_rate",
    )


def grade(metrics: DataFrame, min_oos: int = MIN_OOS, min_signals: int = MIN_SIGNALS) -> DataFrame:
    """Eligibility reasons (in fixed order) and the A / B / REJECT grade."""
    c = F.col
    reasons = F.filter(
        F.array(
            F.when(c("days") < min_oos, f"oos_observations_below_{min_oos}"),
            F.when(c("signal_count") < min_signals, f"signal_observations_below_{min_signals}"),
            F.when(c("lift") <= 0, "precision_lift_not_positive"),
            F.when(~F.coalesce(c("brier_skill") > 0, F.lit(False)), "brier_skill_score_not_positive"),
            F.when(c("recent_lift") < RECENT_FLOOR, "recent_performance_decayed"),
            F.when(c("extreme_rate") > EXTREME_SHARE, "calibration_instability_extreme_probabilities"),
        ),
        lambda x: x.isNotNull(),
    )
    df = metrics.withColumn("eligibility_reasons", reasons)
    df = df.withColumn("eligible", F.size("eligibility_reasons") == 0)
    top = (c("lift") >= GRADE_A_LIFT) & (c("lift_ci_lower") > 0) & (c("brier_skill") >= GRADE_A_SKILL)
    return df.withColumn(
        "quality_grade", F.when(c("eligible") & top, "A").when(c("eligible"), "B").otherwise("REJECT")
    )


def publish(graded: DataFrame) -> DataFrame:
    """Rounded metrics as published: shares to four decimals, lifts in points."""
    four = ["baseline", "precision", "recall", "f1", "brier", "naive_brier", "brier_skill"]
    points = ["lift", "lift_ci_lower", "recent_lift"]
    return graded.withColumns(
        {**{c: round_even(c, 4) for c in four}, **{c: round_even(F.col(c) * 100, 2) for c in points}}
    )


FOLD_COLUMNS = ["train_start", "train_end", "cal_start", "cal_end", "test_start", "test_end"]


def fold_audit(pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The distinct fold boundaries behind a set of walk-forward predictions."""
    return pred.select(*keys, *FOLD_COLUMNS).dropDuplicates()
