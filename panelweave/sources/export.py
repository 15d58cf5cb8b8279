"""JSON export and the prior-state snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import finite


def _clean(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _clean(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, x: _clean(x, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [_clean(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL at any depth; integers and booleans are untouched."""
    return df.select(*[_clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def export_json(df: DataFrame, path: str) -> None:
    """Strictly valid JSON lines; missing values are written as null."""
    sanitize(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# ------------------------------------------------------------------ prior state
def state_status(states: DataFrame, schema_version: str, model_version: str) -> DataFrame:
    """The reason each snapshot is refused, first failing check first; NULL when usable.

    Columns: schema_version, model_version, data_mode, seed, stale,
    validation_passed, holdings (array), generated_at, region.
    """
    no = F.lit(False)
    reason = (
        F.when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "schema_version_mismatch")
        .when(~F.col("model_version").eqNullSafe(F.lit(model_version)), "model_version_mismatch")
        .when(~F.col("data_mode").eqNullSafe(F.lit("live")) | F.coalesce("seed", no) | F.coalesce("stale", no), "non_live_state")
        .when(~F.coalesce("validation_passed", no), "production_validation_missing")
        .when(F.col("holdings").isNull(), "holdings_missing")
    )
    return states.withColumn("reason", reason)


def load_prior_state(states: DataFrame, schema_version: str, model_version: str) -> DataFrame:
    """Newest usable snapshot per region."""
    ok = state_status(states, schema_version, model_version).where(F.col("reason").isNull())
    row = F.struct(*[c for c in states.columns if c not in ("region", "generated_at")])
    best = ok.groupBy("region").agg(F.max("generated_at").alias("generated_at"), F.max_by(row, "generated_at").alias("_s"))
    return best.select("region", "generated_at", "_s.*")


def snapshot_state(picks: DataFrame, meta: dict) -> DataFrame:
    """State rows of a live, validated run: one per region with its (at most a dozen) holdings."""
    if meta.get("data_mode") != "live" or meta.get("seed") or meta.get("stale"):
        raise ValueError("only live runs may become production state")
    if not meta.get("validation_passed"):
        raise ValueError("production validation must pass before state publication")
    order = F.sort_array(F.collect_list(F.struct("pick", "entity")))
    held = picks.groupBy("region").agg(F.transform(order, lambda x: x["entity"]).alias("holdings"))
    text = {k: F.lit(meta.get(k)).cast("string") for k in ("schema_version", "model_version", "macro_regime", "generated_at", "market_as_of")}
    return held.withColumns(
        {**text, "data_mode": F.lit("live"), "seed": F.lit(False), "stale": F.lit(False), "validation_passed": F.lit(True)}
    )


def load_validation(status: DataFrame, min_days: int = 126) -> DataFrame:
    """Stored validation summaries read conservatively: short history is never eligible
    and nothing read from storage counts as live-validated."""
    days = F.coalesce(F.col("paper_days"), F.lit(0))
    ok = F.coalesce(F.col("live_validation_eligible"), F.lit(False)) & (days >= min_days)
    return status.withColumns(
        {"paper_days": days, "matured_signals": F.coalesce("matured_signals", F.lit(0)), "live_validation_eligible": ok, "live_validated": F.lit(False)}
    )
