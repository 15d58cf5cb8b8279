"""Walk-forward model queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as fx
from ..operators import models as md
from ..operators import quality as ql
from ..session import stage_table
from . import views as v
from .catalog import register
from .feature_queries import MACRO_COLS

H, HORIZONS = 21, (21, 63, 126)
CFG = md.ModelConfig(oos_start="1998-01-01")


def model_panel(spark, sf):
    def build():
        bars = v.bars(spark, sf)
        df = fx.build_features(bars, v.benchmark(bars), v.vix(spark, sf), v.macro(spark, sf), MACRO_COLS)
        return fx.add_targets(df, HORIZONS)

    return stage_table(spark, f"{sf}/model_panel", build)


def each_horizon(spark, sf, run):
    """``run`` (panel, inputs, target, horizon) for every horizon, in one table."""
    panel = model_panel(spark, sf)
    inputs = fx.feature_columns(panel)
    return reduce(DataFrame.unionByName, [run(panel, inputs, f"target_{h}d", h) for h in HORIZONS])


@register(
    "fold_plan", "M1",
    f"""WITH {v.BARS}, d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM bars)),
    s AS (SELECT max(n) AS n, greatest(525, (SELECT count(*) FROM d WHERE ts < DATE '1998-01-01')) AS start FROM d),
    f AS (SELECT unnest(generate_series(start, n - 1, 21)) AS fold, n FROM s WHERE n > 525 + 21)
    --final SELECT fold, (SELECT min(ts) FROM d) AS train_start, t.ts AS train_end, a.ts AS cal_start, b.ts AS cal_end, x.ts AS test_start, y.ts AS test_end FROM f
      JOIN d t ON t.i = fold - 21 - 252 - 21 - 1 JOIN d a ON a.i = fold - 21 - 252 JOIN d b ON b.i = fold - 21 - 1 JOIN d x ON x.i = fold JOIN d y ON y.i = least(fold + 21, f.n) - 1
      WHERE fold - 21 - 252 - 21 >= 252""",
    "train_start train_end cal_start cal_end test_start test_end", "fold",
)
def _(spark, sf):
    return md.fold_plan(v.bars(spark, sf), md.ModelConfig(oos_start="1998-01-01"), H)


def predictions(spark, sf):
    fit = lambda panel, inputs, target, h: md.walk_forward(panel, inputs, target, CFG, h)
    return stage_table(spark, f"{sf}/walk_forward", lambda: each_horizon(spark, sf, fit))


@register("walk_forward", "M2 M3 M5", None, "entity ts test_start test_end", "horizon actual pred", "prob_raw prob_cal")
def _(spark, sf):
    return predictions(spark, sf)


def fold_bounds(panel, inputs, target, h):
    """The folds of each entity that has rows in the test block: dates alone, no fit."""
    frame = panel.dropna(subset=[*inputs, target]).select("entity", "ts")
    tested = frame.join(md.fold_plan(frame, CFG, h), F.col("ts").between(F.col("test_start"), F.col("test_end")))
    return ql.fold_audit(tested.withColumn("horizon", F.lit(h)))


@register("fold_audit", "A35", None, "entity train_start train_end cal_start cal_end test_start test_end", "horizon")
def _(spark, sf):
    return each_horizon(spark, sf, fold_bounds)


def signal(spark, sf):
    live = lambda panel, inputs, target, h: md.current_signal(panel, inputs, target, CFG, h).withColumn("horizon", F.lit(h))
    return stage_table(spark, f"{sf}/signal", lambda: each_horizon(spark, sf, live))


@register("current_signal", "M6", None, "entity ts prediction", "horizon", "prob_up prob_up_raw")
def _(spark, sf):
    return signal(spark, sf)


@register("signal_card", "M7", None, "entity prediction quality_grade", "horizon days", "prob_up threshold precision total_return")
def _(spark, sf):
    return md.signal_card(signal(spark, sf), predictions(spark, sf), CFG)
