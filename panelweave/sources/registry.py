"""Registries of opinion sources and views from multi-line JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW = (
    "struct<id:string,sourceId:string,sourceType:string,title:string,publishedAt:string,verifiedAt:string,"
    "verified:boolean,url:string,horizon:string,region:string,assetClass:string,theme:string,stance:double,"
    "confidence:double,summary:string,risks:array<string>,signposts:array<string>,staleAfterDays:int>"
)
SOURCE = "struct<id:string,institution:string,team:string,sourceType:string,weight:double,url:string>"


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def read_registry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``kind`` is ``views`` or ``sources``: the array of that name, one row per element."""
    element = VIEW if kind == "views" else SOURCE
    doc = spark.read.schema(f"{kind} array<{element}>").option("multiLine", True).json(path)
    flat = doc.select(F.explode(kind).alias("e")).select("e.*")
    flat = flat.withColumnsRenamed({c: _snake(c) for c in flat.columns})
    for c in ("published_at", "verified_at"):
        if c in flat.columns:
            # ISO instants; a missing zone reads as UTC (the session zone).
            flat = flat.withColumn(c, F.try_to_timestamp(F.col(c)))
    return flat
