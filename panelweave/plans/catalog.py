"""Registered queries: a Spark callable and, where SQL can say it, its oracle.

One output spec serves both sides, so rounding and types always agree:
``keep`` columns pass through, ``ints`` become BIGINT, ``nums`` are rounded
(adding 0.0 turns -0.0 into 0.0).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def _split(names: str, digits: int) -> list[tuple[str, int]]:
    """'a b:3' -> [('a', digits), ('b', 3)]"""
    out = []
    for item in names.split():
        name, _, d = item.partition(":")
        out.append((name, int(d) if d else digits))
    return out


def shape(df: DataFrame, keep: str, ints: str, nums: str, digits: int) -> DataFrame:
    cols = [F.col(c) for c in keep.split()]
    cols += [F.col(c).cast("long").alias(c) for c in ints.split()]
    cols += [(F.round(F.col(c), d) + F.lit(0.0)).alias(c) for c, d in _split(nums, digits)]
    return df.select(*cols)


def shape_sql(sql: str, keep: str, ints: str, nums: str, digits: int) -> str:
    head, _, body = sql.rpartition("--final")
    cols = keep.split()
    cols += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    cols += [f"round(CAST({c} AS DOUBLE), {d}) + 0.0 AS {c}" for c, d in _split(nums, digits)]
    return f"{head}\nSELECT {', '.join(cols)} FROM (\n{body}\n) AS _out"


def register(
    name: str,
    covers: str,
    sql: str | None = None,
    keep: str = "",
    ints: str = "",
    nums: str = "",
    digits: int = 6,
):
    """Decorator adding ``fn(spark, sf_dir)`` to the catalog.

    ``sql`` is a WITH prelude, the marker ``--final``, then the last SELECT.
    """

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(fn(spark, sf_dir), keep, ints, nums, digits)

        text = shape_sql(sql, keep, ints, nums, digits) if sql else None
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(run, text, covers)
        return fn

    return wrap
