"""Price bars: scan, cleaning, aggregation from trades, source fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OHLCV = ["open", "high", "low", "close", "volume"]

BAR_SCHEMA = T.StructType(
    [T.StructField("entity", T.StringType()), T.StructField("ts", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)


def clean_bars(df: DataFrame) -> DataFrame:
    """Keep the bar columns that exist and drop rows where all of them are null."""
    keep = [c for c in OHLCV if c in df.columns]
    extra = [c for c in ("region", "sector") if c in df.columns]
    return df.select("entity", *extra, "ts", *keep).dropna(how="all", subset=keep)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from parquet, CSV or JSON files with the declared schema."""
    reader = spark.read.schema(BAR_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", True)
    return clean_bars(reader.format(fmt).load(path))


def build_bars(
    trades: DataFrame,
    keys: tuple[str, ...] = ("entity",),
    ts: str = "ts",
    price: str = "price",
    qty: str = "qty",
    sequence: str = "seq",
) -> DataFrame:
    """First/highest/lowest/last price and summed quantity per key and day.

    ``sequence`` orders the trades of a day and should be numeric: the first
    and last price then keep fixed-width buffers, so Spark combines on the map
    side by hashing instead of sorting every raw trade.
    """
    return trades.groupBy(*keys, ts).agg(
        F.min_by(price, sequence).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, sequence).alias("close"),
        F.sum(qty).alias("volume"),
    )


def resolve_source(primary: DataFrame, fallback: DataFrame, key: str = "entity") -> DataFrame:
    """Series-level fallback: an entity absent from ``primary`` (or present with
    nothing but null closes) is taken from ``fallback``; ``source`` says which."""
    alive = primary.where(F.col("close").isNotNull())
    covered = alive.select(key).distinct()
    spare = fallback.where(F.col("close").isNotNull()).join(covered, key, "left_anti")
    return alive.withColumn("source", F.lit("primary")).unionByName(
        spare.withColumn("source", F.lit("fallback")), allowMissingColumns=True
    )


def weighted_benchmark(bars: DataFrame, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """Volume-weighted close per day: one benchmark series per group of ``by``."""
    return bars.groupBy(*by, "ts").agg(
        F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("bench")
    )


def latest_date(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row with the newest date over all series."""
    return df.agg(F.max(ts).alias("as_of"))


def month_snapshot(df: DataFrame, key: str = "entity", ts: str = "ts") -> DataFrame:
    """Every entity's last row in each calendar month, stamped ``as_of`` = month end."""
    w = Window.partitionBy(key).orderBy(ts)
    nxt = F.lead(ts).over(w)
    return (
        df.withColumn("_next", nxt)
        .where(F.col("_next").isNull() | (F.last_day("_next") > F.last_day(ts)))
        .withColumn("as_of", F.last_day(ts))
        .drop("_next")
    )


def latest_snapshot_rows(df: DataFrame, key: str = "entity", ts: str = "ts") -> DataFrame:
    """Every entity's newest row."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.withColumn("_next", F.lead(ts).over(w)).where(F.col("_next").isNull()).drop("_next")
