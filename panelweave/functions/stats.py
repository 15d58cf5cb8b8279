"""Null-safe numeric helpers.  The engine keeps NULL, never NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is 0 (ANSI division would raise)."""
    return F.try_divide(col(a), col(b))


def change(a: str | Column, b: str | Column) -> Column:
    """a / b - 1."""
    return ratio(a, b) - 1


def clip(c: str | Column, lo: float, hi: float) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def round_even(c: str | Column, digits: int = 0) -> Column:
    """Half-even rounding in double arithmetic: of the scaled number, as SQL's round_even does it.
    ``F.bround`` rounds the shortest decimal instead, and so parts from it where a difference of
    rounded numbers lies by its last bit beside a half."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale + 0.0  # no -0.0


def row_mean(*cols: str | Column) -> Column:
    """Mean of the non-null arguments, NULL when all are null."""
    cs = [col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    n = present(*cs)
    return F.try_divide(total, n.cast("double"))


def present(*cols: str | Column) -> Column:
    """How many of the arguments are non-null."""
    cs = [col(c).isNotNull().cast("int") for c in cols]
    return sum(cs[1:], cs[0])


def dead_band_sign(c: str | Column, threshold: float = 1e-9) -> Column:
    """-1/0/+1, zero inside the dead band and for missing or non-finite input."""
    v = finite(c)
    return (
        F.when(v.isNull() | (F.abs(v) <= F.lit(float(threshold))), 0)
        .otherwise(F.signum(v))
        .cast("int")
    )


def wilson_lower(k: str | Column, n: str | Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson score interval; 0 for an empty sample."""
    k, n = col(k).cast("double"), F.nullif(col(n).cast("double"), F.lit(0.0))
    p = k / n
    zz = z * z
    spread = z * F.sqrt((p * (1 - p) + zz / (4 * n)) / n)
    return F.coalesce((p + zz / (2 * n) - spread) / (1 + zz / n), F.lit(0.0))


# Shrinkage strength in pseudo-observations and published bounds.
SHRINK_K = 15.0
PROB_BOUNDS = (0.05, 0.95)


def shrink(p: str | Column, base: str | Column, n_eff: str | Column | float) -> Column:
    """Pull a probability toward the base rate by its evidence, then clip."""
    n = F.greatest(F.lit(float(n_eff)) if isinstance(n_eff, (int, float)) else col(n_eff), F.lit(1.0))
    pulled = (n * col(p) + SHRINK_K * col(base)) / (n + SHRINK_K)
    return clip(pulled, *PROB_BOUNDS)
