"""Fundamentals: cleaning of raw snapshot fields and guarded yields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import finite, ratio, round_even

RAW_FIELDS = [
    "trailing_pe", "forward_pe", "price_to_book", "roe", "profit_margin", "operating_margin",
    "debt_to_equity", "revenue_growth", "earnings_growth", "free_cashflow", "market_cap",
    "dividend_yield",
]


def clean_number(df: DataFrame, name: str) -> Column:
    """A finite double, or NULL for booleans, non-numeric text, NaN and infinities."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("double")
    value = F.col(name)
    if isinstance(dtype, T.StringType):
        value = F.expr(f"try_cast(trim(`{name}`) AS DOUBLE)")
    return finite(value.cast("double"))


def clean_fundamentals(df: DataFrame, fields: list[str] = RAW_FIELDS) -> DataFrame:
    """Clean every raw field and drop entities with nothing left."""
    have = [f for f in fields if f in df.columns]
    rest = [c for c in df.columns if c not in have]
    cleaned = df.select(*rest, *[clean_number(df, f).alias(f) for f in have])
    return cleaned.dropna(how="all", subset=have)


def inverse_yield(multiple: str, upper: float | None = None) -> Column:
    """1 / multiple to four decimals for a positive multiple (below ``upper``)."""
    m = F.col(multiple)
    ok = m > 0 if upper is None else (m > 0) & (m < upper)
    return F.when(ok, round_even(ratio(F.lit(1.0), F.nullif(m, F.lit(0.0))), 4))


def with_yields(df: DataFrame) -> DataFrame:
    """Earnings, forward earnings, book and free-cash-flow yields; absurd multiples give NULL."""
    fcf, cap = F.nullif(F.col("free_cashflow"), F.lit(0.0)), F.col("market_cap")
    return df.withColumns(
        {
            "earnings_yield": inverse_yield("trailing_pe", 1000.0),
            "fwd_earnings_yield": inverse_yield("forward_pe", 1000.0),
            "book_yield": inverse_yield("price_to_book"),
            "fcf_yield": F.when(cap > 0, round_even(ratio(fcf, F.nullif(cap, F.lit(0.0))), 4)),
        }
    )
