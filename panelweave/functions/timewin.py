"""Time-axis windows.

All features of one entity share a single window spec, so Catalyst plans one
exchange and one sort for the whole feature stage.  Bars are unique per
(entity, day), so a window group can never exceed the number of calendar days
in the history, whatever share of the raw rows an entity holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .stats import change, col, ratio

ENTITY = ("entity",)


def axis(keys=ENTITY, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or axis()).rowsBetween(-(n - 1), 0)


def full(agg: Column, c: str | Column, n: int, w: WindowSpec | None = None) -> Column:
    """``agg`` over the last n rows, NULL until n non-null values of ``c`` exist."""
    frame = trailing(n, w)
    return F.when(F.count(col(c)).over(frame) == n, agg.over(frame))


def roll_mean(c, n: int, w=None) -> Column:
    return full(F.avg(col(c)), c, n, w)


def roll_std(c, n: int, w=None) -> Column:
    return full(F.stddev_samp(col(c)), c, n, w)


def roll_max(c, n: int, w=None) -> Column:
    return full(F.max(col(c)), c, n, w)


def roll_min(c, n: int, w=None) -> Column:
    return full(F.min(col(c)), c, n, w)


def back(c, n: int, w=None) -> Column:
    return F.lag(col(c), n).over(w or axis())


def pct_change(c, n: int = 1, w=None) -> Column:
    return change(c, back(c, n, w))


def ffill(c, w=None) -> Column:
    """Last non-null value up to the current row of the entity's own calendar."""
    frame = (w or axis()).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col(c), ignorenulls=True).over(frame)


def with_position(df: DataFrame, keys=ENTITY, ts: str = "ts", name: str = "pos") -> DataFrame:
    """1-based row number along the time axis."""
    return df.withColumn(name, F.row_number().over(axis(keys, ts)))


# Rows per block of the exponential mean, for the spans whose weights neither outlast a
# block (d**1024 < 1e-16) nor overflow in it.  Other spans get a block of their own size.
EWM_BLOCK = 1024
EWM_SPANS = (4, 55)


def ewm_block(span: int) -> int:
    """A block over which the weights of this span fall below double precision."""
    if span < 2:
        raise ValueError("an exponential mean needs a span of two or more")
    if EWM_SPANS[0] <= span <= EWM_SPANS[1]:
        return EWM_BLOCK
    return max(2, math.ceil(37 / -math.log(1 - 2 / (span + 1))))


def with_blocks(df: DataFrame, size: int = EWM_BLOCK, keys=ENTITY, ts: str = "ts") -> DataFrame:
    """Row position along the time axis cut into blocks: ``_blk`` and the slot inside it.

    Windows that order by (_blk, ts) share one sort with windows inside a block.
    """
    df = df if "pos" in df.columns else with_position(df, keys, ts)
    return df.withColumns(
        {"_slot": (F.col("pos") - 1) % size, "_blk": F.floor((F.col("pos") - 1) / size)}
    )


def ewm_mean(df: DataFrame, means: dict[str, tuple[str, int]], keys=ENTITY, ts="ts") -> DataFrame:
    """Adjusted exponential means in O(rows), without collecting a frame.

    ``means`` maps an output column to (source, span).  Inside a block the
    weighted sum is a plain running sum of x * d**-i scaled back by d**i.  The
    last block that held a value is carried: into the next block with its
    weight, and over any number of blocks without a value as it stands, since a
    mean does not change while nothing is added.  Older totals weigh less than
    one unit in the last place.  Needs ``with_blocks``.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for size in sorted({ewm_block(span) for _, span in means.values()}):
        mine = {out: m for out, m in means.items() if ewm_block(m[1]) == size}
        part = df if size == EWM_BLOCK else with_blocks(df.withColumnsRenamed({"_blk": "_blk0", "_slot": "_slot0"}), size, keys, ts)
        inside = Window.partitionBy(*keys, "_blk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy(*keys).orderBy("_blk", ts).rowsBetween(Window.unboundedPreceding, -1)
        at_end = F.col("_slot") == size - 1
        local, final = {}, {}
        for out, (source, span) in mine.items():
            d = F.lit(1.0 - 2.0 / (span + 1.0))
            up, down = F.pow(d, -F.col("_slot")), F.pow(d, F.col("_slot"))
            known = F.col(source).isNotNull()
            n, weight = f"_n_{out}", f"_d_{out}"
            local[n] = zero(F.sum(F.when(known, F.col(source) * up)).over(inside)) * down
            local[weight] = zero(F.sum(F.when(known, up)).over(inside)) * down
            total = F.struct(F.col("_blk").alias("blk"), F.col(n).alias("n"), F.col(weight).alias("w"))
            held = F.last(F.when(at_end & (F.col(weight) > 0), total), ignorenulls=True).over(before)
            use = (held["blk"] == F.col("_blk") - 1) | (F.col(weight) == 0)
            carried = lambda x: zero(F.when(use, x)) * down * d
            final[out] = ratio(F.col(n) + carried(held["n"]), F.col(weight) + carried(held["w"]))
        part = part.withColumns(local).withColumns(final).drop(*local)
        df = part if size == EWM_BLOCK else part.drop("_blk", "_slot").withColumnsRenamed({"_blk0": "_blk", "_slot0": "_slot"})
    return df


def rolling_drawdown(
    df: DataFrame, source: str, n: int, out: str, keys=ENTITY, ts="ts"
) -> DataFrame:
    """Worst fall from a running peak inside the last n rows, for every row.

    The rows are cut into blocks of n.  A trailing frame is the tail of the
    previous block plus the head of the current one, and the worst fall of a
    concatenation is the least of both parts' and of low(right)/peak(left)-1.
    Head and tail values are running aggregates, so the cost is O(rows) rather
    than O(rows * n).  Shorter histories use what there is.  Needs ``pos``.
    """
    c = F.col(source)
    df = df.withColumn("_blk", F.floor((F.col("pos") - 1) / n))
    run = (Window.unboundedPreceding, 0)
    head = Window.partitionBy(*keys, "_blk").orderBy(ts).rowsBetween(*run)
    tail = Window.partitionBy(*keys, "_blk").orderBy(F.col(ts).desc()).rowsBetween(*run)
    df = df.withColumn("_tail_low", F.min(c).over(tail)).withColumn("_tail_peak", F.max(c).over(tail))
    df = df.withColumn("_tail_dd", F.min(change("_tail_low", c)).over(tail))
    df = df.withColumn("_head_peak", F.max(c).over(head)).withColumn("_head_low", F.min(c).over(head))
    df = df.withColumn("_head_dd", F.min(change(c, "_head_peak")).over(head))
    w = axis(keys, ts)
    straddles = F.pmod(F.col("pos"), F.lit(n)) != 0
    old = lambda x: F.when(straddles, F.lag(x, n - 1).over(w))
    return df.withColumn(
        out,
        F.least(
            F.col("_head_dd"),
            old("_tail_dd"),
            change(F.col("_head_low"), old("_tail_peak")),
        ),
    ).drop("_blk", "_tail_low", "_tail_peak", "_tail_dd", "_head_peak", "_head_low", "_head_dd")
