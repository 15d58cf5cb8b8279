"""Exact order statistics of groups of any size.

A plain ranking window puts each group into one task.  Here the values of a
group are spread over order-preserving buckets first: equal values collapse
to one counted row, each bucket ranks on its own, and a running total over
the bucket counts supplies the offset.  The bucket of a value depends on the
value alone (never on sampled bounds), so a recomputed task agrees with the
first attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import col, round_even

# 1024 buckets per factor of two, so that values all near one number, such as ratios near 1,
# still spread over many; the offset keeps every double's log positive.
_PER_OCTAVE = 1024
_OFFSET = 1100 * _PER_OCTAVE


def order_bucket(v: str | Column) -> Column:
    """A bucket number that never decreases as the value grows."""
    v = col(v).cast("double")
    level = F.floor(F.ln(F.abs(v)) * (_PER_OCTAVE / 0.6931471805599453)) + _OFFSET
    return F.when(v == 0, F.lit(0)).when(v.isNotNull(), F.signum(v) * level).cast("long")


def _counted(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per distinct value: its rows ``_n``, preceding rows ``_below``, group ``_all``."""
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    tied = (
        df.where(F.col(value).isNotNull())
        .withColumn("_bucket", order_bucket(value))
        .groupBy(*keys, "_bucket", value)
        .agg(amount.alias("_n"))
    )
    per_bucket = tied.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        (F.sum("_bn").over(across) - F.col("_bn")).alias("_off"),
        F.sum("_bn").over(Window.partitionBy(*keys)).alias("_all"),
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(value)
    return tied.join(offsets, [*keys, "_bucket"]).select(
        *keys,
        value,
        "_n",
        "_all",
        (F.col("_off") + F.sum("_n").over(within) - F.col("_n")).alias("_below"),
    )


def average_rank(df: DataFrame, keys: list[str], columns: list[str], suffix: str, ids: list[str]) -> DataFrame:
    """Add, per column, the 1-based tie-averaged rank (``<col><suffix>``) and the
    number of ranked rows (``<col><suffix>_of``) in the group.  Nulls get neither.
    Group keys must be non-null, and ``keys`` with ``ids`` must identify a row.

    All columns are ranked in one long table and come back by one aggregation, so the plan is the
    same for any number of columns.
    """
    rows = [*keys, *ids]
    values = F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in columns])
    long = df.select(*rows, F.explode(values).alias("_s")).select(*rows, "_s._col", "_s._v").where(F.col("_v").isNotNull())
    ranked = _counted(long, [*keys, "_col"], "_v").select(
        *keys, "_col", "_v", (F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)).alias("_rank"), F.col("_all").alias("_of")
    )
    of = lambda c, name: F.max(F.when(F.col("_col") == c, F.col(name)))
    back = [x for c in columns for x in (of(c, "_rank").alias(c + suffix), of(c, "_of").alias(c + suffix + "_of"))]
    wide = long.join(ranked, [*keys, "_col", "_v"]).groupBy(*rows).agg(*back)
    return df.join(wide, rows, "left").select(*df.columns, *[c + suffix + end for c in columns for end in ("", "_of")])


def percentile_rank(
    df: DataFrame, keys: list[str], columns: list[str], suffix: str = "_pct", digits: int | None = 0, ids: list[str] = ["entity"]
) -> DataFrame:
    """Percentile 0-100 with averaged ties; nulls are ignored.

    ``digits`` rounds half to even (None keeps the exact share).
    """
    out = average_rank(df, keys, columns, "_ar", ids)
    for c in columns:
        share = F.col(f"{c}_ar") / F.col(f"{c}_ar_of") * 100
        out = out.withColumn(c + suffix, share if digits is None else round_even(share, digits))
    return out.drop(*[f"{c}_ar" for c in columns], *[f"{c}_ar_of" for c in columns])


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Per group the first value whose cumulative weight reaches half the total."""
    counted = _counted(df, keys, value, F.col(weight))
    reached = F.col("_below") + F.col("_n") >= F.col("_all") / 2
    return counted.groupBy(*keys).agg(
        F.when(F.max("_all") > 0, F.min(F.when(reached, F.col(value)))).alias(out)
    )


def group_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact median per group: the mean of the two middle order statistics."""
    counted = _counted(df, keys, value)
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    holds = lambda k: (F.col("_below") < k) & (k <= F.col("_below") + F.col("_n"))
    pick = lambda k: F.max(F.when(holds(k), F.col(value)))
    return counted.groupBy(*keys).agg(((pick(low) + pick(high)) / 2).alias(out))
