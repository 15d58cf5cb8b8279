"""Symbol normalisation, region routing, sector lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class-share symbols whose dotless or dotted forms need a dash.
CLASS_SHARES = {"BRK.B": "BRK-B", "BRKB": "BRK-B", "BF.B": "BF-B", "BFB": "BF-B"}


def norm_symbol_us(raw: str) -> Column:
    """Trimmed upper case, class shares repaired, remaining dots to dashes."""
    sym = F.upper(F.trim(F.col(raw).cast("string")))
    fixes = F.create_map(*[F.lit(x) for kv in CLASS_SHARES.items() for x in kv])
    return F.coalesce(F.try_element_at(fixes, sym), F.replace(sym, F.lit("."), F.lit("-")))


def norm_symbol_kr(raw: str) -> Column:
    """Six-digit zero-padded code with the exchange suffix; NULL unless all digits.

    Codes already longer than six keep their length.
    """
    code = F.col(raw).cast("string")
    padded = F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    return F.when(padded.rlike("^[0-9]+$"), F.concat(padded, F.lit(".KS")))


def suffix_region(entity: str = "entity") -> Column:
    return F.when(F.upper(entity).rlike(r"\.(KS|KQ)$"), "KR").otherwise("US")


def region_of(df: DataFrame, listing: DataFrame | None = None, entity: str = "entity") -> DataFrame:
    """Region from an explicit (entity, region) listing, else from the suffix."""
    if listing is None:
        return df.withColumn("region", suffix_region(entity))
    side = listing.select(F.col("entity").alias(entity), F.col("region").alias("_listed")).dropDuplicates([entity])
    return (
        df.join(side, entity, "left")
        .withColumn("region", F.coalesce("_listed", suffix_region(entity)))
        .drop("_listed")
    )


def with_sector(df: DataFrame, sectors: DataFrame, override: str | None = None) -> DataFrame:
    """Sector from a non-empty override, else from the (entity, sector) map, else NULL."""
    side = sectors.select("entity", F.col("sector").alias("_mapped")).dropDuplicates(["entity"])
    out = df.join(side, "entity", "left")
    first = F.nullif(F.col(override), F.lit("")) if override else F.lit(None).cast("string")
    return out.withColumn("sector", F.coalesce(first, F.col("_mapped"))).drop("_mapped")
