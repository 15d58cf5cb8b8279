"""Panels over the driver's tables, and the same panels as DuckDB CTEs.

The operators are generic; these views give them something to run on.  Each
view reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table
from ..sources.bars import build_bars, weighted_benchmark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --------------------------------------------------------------- trades, bars
def with_dims(df: DataFrame) -> DataFrame:
    """Region and sector of an entity, from its number."""
    num = F.regexp_replace("entity", "Brand#", "").cast("int")
    return df.withColumn("region", F.when(num % 2 == 0, "US").otherwise("KR")).withColumn(
        "sector",
        F.when(num % 3 == 0, "Technology").when(num % 3 == 1, "Financials").otherwise("Energy"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax",
        F.col("l_shipdate").cast("date").alias("ts"),
    )
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    # One long orders the trades of a day: order, line (the key of a line), then a
    # residue of part and supplier, since these tables repeat some keys.
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1048576
    return li.join(part, li.l_partkey == part.p_partkey).select(
        "entity",
        "ts",
        (100 + F.sqrt(F.try_divide("l_extendedprice", "l_quantity")) / 16).alias("price"),
        (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("qty"),
        seq.alias("seq"),
    )


def fresh_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars computed from the raw tables."""
    return with_dims(build_bars(trades(spark, sf)))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """The bar table: built from the raw tables once, then read by every panel query."""
    return stage_table(spark, f"{sf}/bars", lambda: fresh_bars(spark, sf))


BARS = """trades AS (
  SELECT p.p_brand AS entity, CAST(l.l_shipdate AS DATE) AS ts,
         100 + sqrt(l.l_extendedprice / nullif(l.l_quantity, 0)) / 16 AS price,
         l.l_quantity * (1 + l.l_tax) AS qty, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
bars0 AS (
  SELECT entity, ts,
         arg_min(price, (l_orderkey, l_linenumber, (l_partkey * 31 + l_suppkey) % 1048576)) AS open,
         max(price) AS high, min(price) AS low,
         arg_max(price, (l_orderkey, l_linenumber, (l_partkey * 31 + l_suppkey) % 1048576)) AS close,
         sum(qty) AS volume
  FROM trades GROUP BY entity, ts),
bars AS (
  SELECT *, CASE WHEN num % 2 = 0 THEN 'US' ELSE 'KR' END AS region,
         CASE num % 3 WHEN 0 THEN 'Technology' WHEN 1 THEN 'Financials' ELSE 'Energy' END AS sector,
         last_day(ts) AS month_end,
         row_number() OVER (PARTITION BY entity ORDER BY ts) AS pos
  FROM (SELECT *, CAST(replace(entity, 'Brand#', '') AS INTEGER) AS num FROM bars0))"""


def benchmark(bars_df: DataFrame) -> DataFrame:
    return weighted_benchmark(bars_df)


BENCH = """bench AS (
  SELECT region, ts, sum(close * volume) / nullif(sum(volume), 0) AS bench
  FROM bars GROUP BY region, ts)"""


# ---------------------------------------------------------------- macro views
def vix(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("ts"))
        .agg((F.avg("o_totalprice") / 9973).alias("vix"))
    )


VIX = """vix AS (
  SELECT CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) / 9973 AS vix
  FROM orders GROUP BY CAST(o_orderdate AS DATE))"""

# Which order figures play which macro series.
_MONTHLY_COUNT = {"1": "Payrolls", "2": "Unemployment", "3": "Core_CPI", "4": "M2", "5": "Fed_Assets"}
_MONTHLY_MEAN = {"1": "HY_Spread", "2": "CFNAI", "3": "Initial_Claims", "4": "Core_PCE", "5": "TGA"}
_DAILY_MEAN = {"1": "Treasury_10Y", "2": "Treasury_2Y"}


def _named(spec: dict[str, str]):
    m = F.create_map(*[F.lit(x) for kv in spec.items() for x in kv])
    return F.try_element_at(m, F.substring("o_orderpriority", 1, 1))


def macro_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily long macro: two rates by priority."""
    return (
        table(spark, sf, "orders")
        .select(_named(_DAILY_MEAN).alias("indicator"), F.col("o_orderdate").cast("date").alias("obs_date"),
                "o_totalprice")
        .where(F.col("indicator").isNotNull())
        .groupBy("indicator", "obs_date")
        .agg((F.avg("o_totalprice") / 99991).alias("value"))
    )


MACRO_DAILY = """macro_daily AS (
  SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'Treasury_10Y' ELSE 'Treasury_2Y' END AS indicator,
         CAST(o_orderdate AS DATE) AS obs_date, avg(o_totalprice) / 99991 AS value
  FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') GROUP BY 1, 2)"""


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """Long macro table: ten monthly series plus VIX, WTI, two rates and their spread."""
    from ..sources.macro import derive_spread

    orders = table(spark, sf, "orders").select(
        "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("d")
    )
    monthly = orders.groupBy("o_orderpriority", F.trunc("d", "month").alias("obs_date")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), (F.avg("o_totalprice") / 997).alias("m")
    )
    long_monthly = monthly.select(
        "obs_date",
        F.explode(
            F.array(
                F.struct(_named(_MONTHLY_COUNT).alias("indicator"), F.col("n").alias("value")),
                F.struct(_named(_MONTHLY_MEAN).alias("indicator"), F.col("m").alias("value")),
            )
        ).alias("s"),
    ).select("s.indicator", "obs_date", "s.value")
    daily = orders.groupBy(F.col("d").alias("obs_date")).agg(
        (F.avg("o_totalprice") / 9973).alias("v"), F.count(F.lit(1)).cast("double").alias("n")
    )
    long_daily = daily.select(
        "obs_date",
        F.explode(
            F.array(
                F.struct(F.lit("VIX").alias("indicator"), F.col("v").alias("value")),
                F.struct(F.lit("WTI").alias("indicator"), F.col("n").alias("value")),
            )
        ).alias("s"),
    ).select("s.indicator", "obs_date", "s.value")
    rates = derive_spread(macro_daily(spark, sf), "Treasury_10Y", "Treasury_2Y", "Yield_Curve")
    return long_monthly.unionByName(long_daily).unionByName(rates)


MACRO = MACRO_DAILY + """,
macro AS (
  SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'Payrolls' WHEN '2' THEN 'Unemployment'
         WHEN '3' THEN 'Core_CPI' WHEN '4' THEN 'M2' WHEN '5' THEN 'Fed_Assets' END AS indicator,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date, CAST(count(*) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2
  UNION ALL
  SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'HY_Spread' WHEN '2' THEN 'CFNAI'
         WHEN '3' THEN 'Initial_Claims' WHEN '4' THEN 'Core_PCE' WHEN '5' THEN 'TGA' END,
         CAST(date_trunc('month', o_orderdate) AS DATE), avg(o_totalprice) / 997
  FROM orders GROUP BY 1, 2
  UNION ALL SELECT 'VIX', CAST(o_orderdate AS DATE), avg(o_totalprice) / 9973 FROM orders GROUP BY 2
  UNION ALL SELECT 'WTI', CAST(o_orderdate AS DATE), CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2
  UNION ALL SELECT indicator, obs_date, value FROM macro_daily
  UNION ALL
  SELECT 'Yield_Curve', a.obs_date, a.value - b.value
  FROM macro_daily a JOIN macro_daily b ON a.obs_date = b.obs_date
  WHERE a.indicator = 'Treasury_10Y' AND b.indicator = 'Treasury_2Y')"""


# ---------------------------------------------------------------- fundamentals
def raw_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve raw fields per brand from the part table; some are text junk on purpose."""
    p = table(spark, sf, "part")
    g = p.groupBy(F.col("p_brand").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("sz"), F.avg("p_retailprice").alias("rp"),
        F.count_if(F.col("p_type") == "ECONOMY").alias("ec"), F.count_if(F.col("p_type") == "SMALL").alias("sm"),
    )
    k = F.regexp_replace("entity", "Brand#", "").cast("int")
    pe = F.when(k % 7 == 0, "n/a").when(k % 11 == 0, "NaN").otherwise(((F.col("sz") - 24) * 12).cast("string"))
    fpe = F.when(k % 6 == 0, "Infinity").otherwise((F.col("sz") * 0.8).cast("string"))
    return g.select(
        "entity",
        pe.alias("trailing_pe"),
        fpe.alias("forward_pe"),
        F.when(k % 9 != 0, F.col("rp") / 413).alias("price_to_book"),
        ((F.col("sz") - 20) / 40).alias("roe"),
        (F.col("sm") / F.col("n")).alias("profit_margin"),
        F.when(k % 8 != 0, F.col("ec") / F.col("n")).alias("operating_margin"),
        F.when(k % 5 != 0, 50.0 + 10 * (F.col("n") % 17)).alias("debt_to_equity"),
        ((F.col("n") - 80) / 80).alias("revenue_growth"),
        ((F.col("sz") - 25) / 25).alias("earnings_growth"),
        ((F.col("sz") - 24) * 1009).alias("free_cashflow"),
        (F.col("rp") * F.col("n") * 10).alias("market_cap"),
        (k % 2 == 0).alias("dividend_yield"),
    )


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.fundamentals import clean_fundamentals, with_yields

    df = with_yields(clean_fundamentals(raw_fundamentals(spark, sf)))
    return df.withColumnRenamed("operating_margin", "op_margin")


FUND = """fg AS (
  SELECT p_brand AS entity, count(*) AS n, avg(p_size) AS sz, avg(p_retailprice) AS rp,
         count(*) FILTER (p_type = 'ECONOMY') AS ec, count(*) FILTER (p_type = 'SMALL') AS sm,
         CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS k FROM part GROUP BY p_brand),
f0 AS (
  SELECT entity, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 THEN (sz - 24) * 12 END AS trailing_pe,
         CASE WHEN k % 6 <> 0 THEN sz * 0.8 END AS forward_pe, CASE WHEN k % 9 <> 0 THEN rp / 413 END AS price_to_book,
         (sz - 20) / 40 AS roe, sm / n AS profit_margin, CASE WHEN k % 8 <> 0 THEN ec / n END AS op_margin,
         CASE WHEN k % 5 <> 0 THEN 50.0 + 10 * (n % 17) END AS debt_to_equity, (n - 80) / 80 AS revenue_growth,
         (sz - 25) / 25 AS earnings_growth, (sz - 24) * 1009 AS free_cashflow, rp * n * 10 AS market_cap FROM fg),
fund AS (
  SELECT *, CASE WHEN trailing_pe > 0 AND trailing_pe < 1000 THEN round_even(1 / trailing_pe, 4) END AS earnings_yield,
         CASE WHEN forward_pe > 0 AND forward_pe < 1000 THEN round_even(1 / forward_pe, 4) END AS fwd_earnings_yield,
         CASE WHEN price_to_book > 0 THEN round_even(1 / price_to_book, 4) END AS book_yield,
         CASE WHEN market_cap > 0 AND free_cashflow <> 0 THEN round_even(free_cashflow / market_cap, 4) END AS fcf_yield
  FROM f0)"""
