"""Publication gates: block reasons, withholding, invariants, provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
RUN_MODES = ["researchOnly", "paperTrading", "liveValidated"]
DEFAULT_RUN_MODE = "paperTrading"
COVERAGE_FLOOR = 95.0
ERROR_SHARE = 0.10


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def block_reasons(meta: DataFrame, floor: float = COVERAGE_FLOOR) -> DataFrame:
    """Hard data-safety blockers per run.

    Input: seed, stale, synthetic, build_failed (booleans), models_trained,
    coverage_pct, n_errors, universe_screened.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    reasons = F.filter(
        F.array(
            F.when(_flag("seed"), "seed_data"),
            F.when(_flag("stale"), "stale_data"),
            F.when(zero("models_trained") == 0, "models_trained_zero"),
            F.when(zero("coverage_pct") < floor, f"coverage_below_{floor:g}"),
            F.when(_flag("build_failed"), "build_validation_failed"),
            F.when(_flag("synthetic"), "synthetic_data"),
            F.when(
                (zero("n_errors") > 0) & (zero("n_errors") > ERROR_SHARE * F.greatest(zero("universe_screened"), F.lit(1))),
                "pipeline_errors_excessive",
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return meta.withColumn("block_reasons", reasons).withColumn("blocked", F.size("block_reasons") > 0)


ACTION_COLUMNS = ["weight", "weight_pct", "pick", "entry_state", "entry_reasons", "overheat_percentile", "suggested_weight_pct"]


def withhold(df: DataFrame, blocked: Column | bool) -> DataFrame:
    """Null every actionable column of blocked rows; research columns stay."""
    flag = F.lit(blocked) if isinstance(blocked, bool) else blocked
    return df.withColumns({c: F.when(~flag, F.col(c)) for c in ACTION_COLUMNS if c in df.columns})


def withhold_rows(df: DataFrame, blocked: Column | bool) -> DataFrame:
    """Drop whole actionable tables (ideas, picks) of blocked runs."""
    flag = F.lit(blocked) if isinstance(blocked, bool) else blocked
    return df.where(~flag)


def data_mode(seed: str = "seed", stale: str = "stale", synthetic: str = "synthetic") -> Column:
    return (
        F.when(_flag(synthetic), "synthetic").when(_flag(seed), "seed").when(_flag(stale), "stale").otherwise("live")
    )


def run_mode(configured: str | Column) -> Column:
    """A known mode, never ``liveValidated`` from configuration alone."""
    c = F.trim(F.col(configured) if isinstance(configured, str) else configured)
    return F.when(c.isin("researchOnly"), c).otherwise(DEFAULT_RUN_MODE)


def stamp(df: DataFrame, meta: dict) -> DataFrame:
    """Provenance columns on every output row (schema/model version, commit, dates, modes)."""
    names = ["schema_version", "model_version", "build_commit", "generated_at", "market_as_of", "source_as_of", "run_mode", "data_mode"]
    return df.withColumns({n: F.lit(meta.get(n)).cast("string") for n in names})


def live_only(df: DataFrame, mode: str = "data_mode") -> DataFrame:
    """The ledger sink accepts rows of live runs only."""
    return df.where(F.col(mode) == "live")


# -------------------------------------------------------------------- invariants
# Words that make a reason an instruction.
ACTIONABLE_TERMS = (
    "buy", "sell", "avoid", "wait", "accumulate", "entry", "매수", "매도",
    "진입", "대기", "회피", "되돌림", "편입", "비중",
)
REASON_FIELDS = ["reason", "reasons", "entry_reasons"]
POSITION_FIELDS = ["holdings", "picks"]

Test = Callable[[Column], Column]


def _places(dtype: T.DataType, name: str, path: str) -> Iterator[tuple[str, str, T.DataType, Callable[[Test], Test]]]:
    """(path, field name, type, lift) of every value below one of ``dtype``: ``lift`` turns a test of the
    place's value into a test of the whole, true if any value at the place passes."""
    yield path, name, dtype, lambda test: test
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            for at, own, kind, lift in _places(f.dataType, f.name, f"{path}.{f.name}"):
                yield at, own, kind, lambda test, f=f, lift=lift: lambda c: lift(test)(c[f.name])
    elif isinstance(dtype, T.ArrayType):
        for at, own, kind, lift in _places(dtype.elementType, name, f"{path}[]"):
            yield at, own, kind, lambda test, lift=lift: lambda c: F.exists(c, lift(test))
    elif isinstance(dtype, T.MapType):
        for at, own, kind, lift in _places(dtype.valueType, name, f"{path}{{}}"):
            yield at, own, kind, lambda test, lift=lift: lambda c: F.exists(F.map_values(c), lift(test))


def _told(c: Column) -> Column:
    """A reason that instructs."""
    text = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in ACTIONABLE_TERMS])


def _place_checks(table: DataFrame, blocked: bool) -> Iterator[tuple[str, Column]]:
    """A check per place of the table's schema, however deep."""
    for f in table.schema.fields:
        for path, name, kind, lift in _places(f.dataType, f.name, f.name):
            here = lambda test: F.coalesce(lift(test)(F.col(f"`{f.name}`")), F.lit(False))
            leaf = not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                yield f"nan_or_infinity:{path}", here(lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
            if not blocked:
                continue
            carries = _flag("blocked")
            if leaf and name in ACTION_COLUMNS and name not in REASON_FIELDS:
                yield f"blocked_row_carries_{path}", carries & here(lambda c: c.isNotNull())
            if isinstance(kind, T.ArrayType) and name in POSITION_FIELDS and not path.endswith("[]"):
                yield f"blocked_row_carries_{path}", carries & here(lambda c: F.size(c) > 0)
            if isinstance(kind, T.StringType) and name in REASON_FIELDS:
                yield f"blocked_row_tells_{path}", carries & here(_told)


def audit(table: DataFrame, name: str, production: bool = True, floor: float = COVERAGE_FLOOR, actionable: bool = False) -> DataFrame:
    """Violations of one stamped table: (table_name, violation, rows).

    Each check is a counter of a single aggregation pass; checks whose columns the table lacks do not
    apply.  Values are looked at wherever they stand, in structs, arrays (``[]``) and maps (``{}``), with a
    counter per path.  An ``actionable`` table (ideas) may hold no row of a blocked run at all.
    """
    have = set(table.columns)
    checks: dict[str, Column] = {}
    for c in ("schema_version", "model_version", "run_mode", "market_as_of"):
        if c in have:
            checks[f"missing_provenance_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
        else:
            checks[f"missing_provenance_{c}"] = F.lit(True)
    if "run_mode" in have:
        checks["invalid_run_mode"] = ~F.coalesce(F.col("run_mode").isin(RUN_MODES), F.lit(False))
        earned = _flag("live_validated_earned") if "live_validated_earned" in have else F.lit(False)
        checks["liveValidated_not_earned"] = F.coalesce(F.col("run_mode") == "liveValidated", F.lit(False)) & ~earned
    if production:
        if "data_mode" in have:
            mode = F.coalesce(F.col("data_mode"), F.lit(""))
            checks["seed_or_synthetic_not_allowed_for_production"] = mode.isin("seed", "synthetic")
            checks["stale_not_allowed_for_production"] = mode == "stale"
        if "models_trained" in have:
            checks["models_trained_zero"] = F.coalesce("models_trained", F.lit(0)) <= 0
        if "coverage_pct" in have:
            checks["coverage_below_floor"] = F.coalesce(F.col("coverage_pct"), F.lit(0.0)) < floor
    if actionable and "blocked" in have:
        checks["blocked_run_has_rows"] = _flag("blocked")
    checks |= dict(_place_checks(table, "blocked" in have))
    counted = table.agg(*[F.count_if(cond).alias(f"c{k}") for k, cond in enumerate(checks.values())])
    pairs = F.array(*[F.struct(F.lit(v).alias("violation"), F.col(f"c{k}").alias("rows")) for k, v in enumerate(checks)])
    return (
        counted.select(F.explode(pairs).alias("_v"))
        .select(F.lit(name).alias("table_name"), "_v.*")
        .where(F.col("rows") > 0)
    )


def audit_all(tables: dict[str, DataFrame | None], required: Sequence[str] = (), ideas: Sequence[str] = (), **kw) -> DataFrame:
    """Violations of all tables; a required one that is None or absent is one of its own."""
    there = {name: df for name, df in tables.items() if df is not None}
    parts = [audit(df, name, actionable=name in ideas, **kw) for name, df in there.items()]
    absent = [name for name in dict.fromkeys([*required, *tables]) if name not in there]
    if absent:
        spark = next(iter(there.values())).sparkSession if there else SparkSession.active()
        parts.append(spark.createDataFrame([(name, "missing_table", 1) for name in absent], "table_name string, violation string, rows long"))
    return reduce(DataFrame.unionByName, parts)
