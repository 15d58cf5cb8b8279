"""Macro series: wide frames to long, derived spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def melt_macro(wide: DataFrame, date: str = "obs_date") -> DataFrame:
    """Wide frame (one column per indicator, gaps as null) to long rows."""
    names = [c for c in wide.columns if c != date]
    typed = wide.select(date, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return (
        typed.unpivot([date], names, "indicator", "value")
        .where(F.col("value").isNotNull())
        .select("indicator", F.col(date).alias("obs_date"), "value")
    )


def read_macro(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Wide macro files (declared ``schema``, a date column ``obs_date``) as long rows."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return melt_macro(reader.format(fmt).load(path))


def derive_spread(macro: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Append the series ``a - b`` on the dates where both were observed."""
    at = lambda n: F.max(F.when(F.col("indicator") == n, F.col("value")))
    spread = (
        macro.where(F.col("indicator").isin(a, b))
        .groupBy("obs_date")
        .agg((at(a) - at(b)).alias("value"))
        .where(F.col("value").isNotNull())
        .select(F.lit(name).alias("indicator"), "obs_date", "value")
    )
    return macro.select("indicator", "obs_date", "value").unionByName(spread)
