"""Reviewed opinions: freshness, de-duplication, weighted consensus, review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import weighted_median
from ..functions.stats import round_even

# Fixed values.
SELF_INTERESTED = "companyIR"
SELF_INTERESTED_WEIGHT = 0.25
REQUIRED = ["published_at", "verified_at", "stance", "summary"]


def classify_views(views: DataFrame, now) -> DataFrame:
    """Status per view: VERIFIED, STALE (older than its own limit) or UNVERIFIED.

    Age is whole days since verification, else publication.
    """
    age = F.floor(
        (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.coalesce("verified_at", "published_at"))) / 86400
    ).cast("int")
    df = views.withColumn("age_days", age)
    reviewed = F.coalesce(F.col("verified"), F.lit(False)) & F.col("stance").isNotNull()
    old = F.coalesce((F.col("stale_after_days") != 0) & (F.col("age_days") > F.col("stale_after_days")), F.lit(False))
    return df.withColumn("status", F.when(reviewed & old, "STALE").when(reviewed, "VERIFIED").otherwise("UNVERIFIED"))


def dedup_views(classified: DataFrame) -> DataFrame:
    """The freshest verified view per source and theme (unknown age last, then id)."""
    w = Window.partitionBy("source_id", "theme").orderBy(F.col("age_days").asc_nulls_last(), "id")
    fresh = classified.where(F.col("status") == "VERIFIED")
    return fresh.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def weighted_views(views: DataFrame, sources: DataFrame) -> DataFrame:
    """Views with institution, source type and weight; self-interested sources count a quarter."""
    side = sources.select(
        F.col("id").alias("source_id"), "institution", F.col("source_type").alias("_stype"), F.col("weight").alias("_w")
    )
    df = views.join(side, "source_id", "left")
    own = df["source_type"] if "source_type" in views.columns else F.lit(None).cast("string")
    interested = F.coalesce(own == SELF_INTERESTED, F.lit(False)) | F.coalesce(F.col("_stype") == SELF_INTERESTED, F.lit(False))
    weight = F.coalesce("_w", F.lit(1.0)) * F.when(interested, SELF_INTERESTED_WEIGHT).otherwise(1.0)
    return df.withColumns(
        {
            "institution": F.coalesce("institution", "source_id"),
            "source_type": F.coalesce(own, F.col("_stype")),
            "theme": F.coalesce(F.nullif("theme", F.lit("")), F.lit("Uncategorized")),
            "view_weight": weight,
        }
    ).drop("_stype", "_w")


def consensus(weighted: DataFrame) -> DataFrame:
    """Per theme: weighted median stance, dispersion, institutions and agreement class.

    The supporting views stay rows of ``weighted`` (keyed by theme): a theme's
    list is unbounded and is never gathered into one value.
    """
    stats = weighted.groupBy("theme").agg(
        round_even(F.max("stance") - F.min("stance"), 2).alias("dispersion"),
        F.countDistinct("institution").alias("institutions"),
        F.count(F.lit(1)).alias("n_views"),
    )
    mid = weighted_median(weighted, ["theme"], "stance", "view_weight", "_mid")
    d = F.col("dispersion")
    agreement = (
        F.when(F.col("institutions") < 2, "insufficient").when(d <= 1, "high").when(d >= 2.5, "low").otherwise("mixed")
    )
    return (
        stats.join(mid, "theme", "left")
        .withColumns({"median_stance": round_even("_mid", 2), "agreement": agreement})
        .drop("_mid")
        .orderBy(F.col("institutions").desc(), F.abs(F.coalesce("median_stance", F.lit(0.0))).desc(), "theme")
    )


def review_queue(classified: DataFrame, sources: DataFrame) -> DataFrame:
    """Views awaiting verification or gone stale, with the fields still missing."""
    side = sources.select(F.col("id").alias("source_id"), "institution", F.col("url").alias("_url"))
    df = classified.where(F.col("status") != "VERIFIED").join(side, "source_id", "left")

    def lacks(c: str):
        empty = F.col(c).isNull()
        if dict(df.dtypes)[c] == "string":
            empty = empty | (F.col(c) == "")
        return F.when(empty, F.lit(c))

    todo = F.array(*[lacks(c) for c in REQUIRED], F.when(~F.coalesce("verified", F.lit(False)), F.lit("verified")))
    missing = F.when(F.col("status") == "UNVERIFIED", F.filter(todo, lambda x: x.isNotNull()))
    return df.withColumns(
        {
            "institution": F.coalesce("institution", "source_id"),
            "url": F.coalesce("url", "_url") if "url" in df.columns else F.col("_url"),
            "missing_fields": missing,
        }
    ).drop("_url")


def verification_coverage(classified: DataFrame, deduped: DataFrame) -> DataFrame:
    """One row: candidates, verified (after de-duplication), stale, awaiting, coverage."""
    a = classified.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("status") == "STALE").alias("stale"),
        F.count_if(F.col("status") == "UNVERIFIED").alias("awaiting"),
    ).withColumn("_k", F.lit(1))
    b = deduped.agg(F.count(F.lit(1)).alias("verified")).withColumn("_k", F.lit(1))
    df = a.join(b, "_k").drop("_k")
    share = F.coalesce(F.try_divide(F.col("verified").cast("double"), F.col("candidates").cast("double")), F.lit(0.0))
    return df.withColumn("coverage", round_even(share, 2))
