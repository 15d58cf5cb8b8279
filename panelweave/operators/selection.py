"""Top-k, filters, set operations, universe and rank-buffer selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import round_even


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per group.

    ``row_number() <= k`` lets Spark cut every map task to k rows per group
    before the shuffle, so a hot group never travels whole.  ``order`` must end
    in a unique tie-break.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


# ------------------------------------------------------------------- filters
def exclude_entities(df: DataFrame, excluded: DataFrame, key: str = "entity") -> DataFrame:
    """Drop benchmarks and funds from a ranking."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def search(df: DataFrame, text: str, columns: tuple[str, ...] = ("entity", "name")) -> DataFrame:
    """Trimmed, case-insensitive substring search; an empty query keeps everything."""
    q = text.strip().lower()
    return df if not q else df.where(F.lower(F.concat_ws(" ", *columns)).contains(q))


def _first_per_date(rows: DataFrame, k: int | None) -> DataFrame:
    """KR before US, then table rank: the order in which the screens are listed."""
    if k is None:
        return rows
    return top_k(rows, ["as_of"], [F.col("region"), F.col("rank"), F.col("entity")], k, "screen_rank")


def screen_actionable(table: DataFrame, k: int | None = 8) -> DataFrame:
    """Good and now: positive view with a clean add state, first k of the research table."""
    good = (F.col("view") == "POSITIVE") & (F.col("entry_state") == "ACCUMULATE_GRADUALLY")
    return _first_per_date(table.where(good), k)


def screen_wait(table: DataFrame, k: int | None = 8) -> DataFrame:
    """Good but not now: not negative, waiting, at event risk or to be avoided."""
    waiting = F.col("entry_state").isin("WAIT_FOR_PULLBACK", "EVENT_RISK", "AVOID")
    return _first_per_date(table.where(waiting & (F.col("view") != "NEGATIVE")), k)


def screen_table(df: DataFrame, score: str = "model_score") -> DataFrame:
    """The screen's columns, best score first, unscored names last."""
    keep = ["entity", "region", score, "regime", "qualifies", "eligible", "quality_grade", "eligibility_reasons"]
    return df.select(*[c for c in keep if c in df.columns]).orderBy(F.col(score).desc_nulls_last(), "entity")


def explain_tags(rows: DataFrame, k: int = 3) -> DataFrame:
    """Up to k arguments for and against each name, in fixed priority."""

    def first(*tags: Column) -> Column:
        return F.slice(F.filter(F.array(*tags), lambda x: x.isNotNull()), 1, k)

    c = F.col
    return rows.withColumns(
        {
            "pros": first(
                F.when(c("momentum_percentile") >= 66, "momentum_high"),
                F.when(c("value_percentile") >= 66, "value_attractive"),
                F.when(c("quality_percentile") >= 66, "quality_high"),
                F.when(c("lowvol_percentile") >= 66, "low_volatility"),
                F.when(c("above_ma200"), "above_ma200"),
                F.when(c("alpha_percentile") >= 66, "alpha_high"),
            ),
            "cons": first(
                F.when(c("value_trap"), "value_trap"),
                F.when(F.coalesce("data_completeness", F.lit(0.0)) < 0.6, "thin_data"),
                F.when(~F.coalesce("above_ma200", F.lit(False)), "below_ma200"),
                F.when(c("quality_percentile") <= 33, "quality_low"),
                F.when(c("max_dd252_pct") <= -25, "deep_drawdown"),
                F.when(c("cvar95_pct") >= 4, "tail_risk"),
                F.when(c("overheat_percentile") >= 85, "overheated"),
            ),
        }
    )


# ------------------------------------------------------------- ranked tables
GROUP = ["as_of", "region"]


def research_table(rows: DataFrame, k: int = 15) -> DataFrame:
    """The compact research table: best k sufficient names per region and date."""
    order = [F.col("alpha_exact").desc(), F.col("entity")]
    return top_k(rows.where(~F.col("data_insufficient")), GROUP, order, k)


def insufficient(rows: DataFrame) -> DataFrame:
    return rows.where("data_insufficient").select(
        *GROUP, "entity", "sector", "sleeves_present", "data_completeness"
    )


def money_flow(screened: DataFrame, keys: list[str] = ["region"], k: int = 6) -> DataFrame:
    """Rising names by volume surge, best k per region."""
    rising = screened.where((F.col("mom60") > 0) & (F.col("volume_surge") != 0))
    return top_k(rising, keys, [F.col("volume_surge").desc(), F.col("entity")], k)


def rank_ideas(ideas: DataFrame, keys: list[str] = ["region"], k: int = 5) -> DataFrame:
    """Grade A first, then net edge, best k per region."""
    grade = F.when(F.col("quality_grade") == "A", 2).when(F.col("quality_grade") == "B", 1).otherwise(0)
    # An edge of exactly zero sorts with the unknown ones.
    edge = F.coalesce(F.nullif(F.col("net_edge_pct"), F.lit(0.0)), F.lit(-999.0))
    return top_k(ideas, keys, [grade.desc(), edge.desc(), F.col("entity")], k)


def select_names(
    scored: DataFrame, prior: DataFrame | None = None, enter_pct: float = 12, exit_pct: float = 28,
    min_names: int = 8, max_names: int = 12,
) -> DataFrame:
    """Rank-buffer selection per (as_of, region).

    Newcomers must reach the top ``enter_pct`` by alpha, incumbents stay until
    they leave the top ``exit_pct``; the list is filled to ``min_names`` and
    cut at ``max_names``, qualified first, then trend-confirmed, then alpha.
    ``prior`` is (region, entity[, as_of]).
    """
    from ..functions.ranks import percentile_rank

    elig = percentile_rank(scored.where(~F.col("data_insufficient")), GROUP, ["alpha"], "_share", digits=None)
    if prior is None:
        elig = elig.withColumn("incumbent", F.lit(False))
    else:
        on = [c for c in ("as_of", "region", "entity") if c in prior.columns]
        held = prior.select(*on).distinct().withColumn("incumbent", F.lit(True))
        elig = elig.join(held, on, "left").withColumn("incumbent", F.coalesce("incumbent", F.lit(False)))
    floor = F.when(F.col("incumbent"), 100.0 - exit_pct).otherwise(100.0 - enter_pct)
    elig = elig.withColumn("qualified", F.col("alpha_share") >= floor)
    sizes = elig.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("_elig"), F.count_if("qualified").alias("_qual")
    )
    order = [F.col("qualified").desc(), F.col("above_ma200").desc(), F.col("alpha").desc(), F.col("entity")]
    best = top_k(elig, GROUP, order, max_names, "pick")
    target = F.least(F.lit(max_names), F.greatest(F.col("_qual"), F.least(F.lit(min_names), F.col("_elig"))))
    return best.join(sizes, GROUP).where(F.col("pick") <= target).drop("_elig", "_qual")


def buffered_candidates(scored: DataFrame, start: DataFrame | None, enter_pct: float, exit_pct: float, min_names: int, max_names: int) -> DataFrame:
    """The eligible rows that a rank buffer can pick at all, with ``alpha_share`` and the date's number ``_k``.

    A newcomer can only be one of the first ``max_names`` over the entry floor, a backfill one of the
    first ``min_names + max_names`` of all; such a row is an entry.  Anything else is picked as an
    incumbent over the exit floor only, so its name must have stood over that floor on every date since
    an entry of its own.  The window runs over a name's own dates, never over a date's names.
    """
    from ..functions.ranks import percentile_rank

    dates = scored.select(*GROUP).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("region").orderBy("as_of")))
    shares = percentile_rank(scored.where(~F.col("data_insufficient")), GROUP, ["alpha"], "_share", digits=None)
    order = [F.col("above_ma200").desc(), F.col("alpha").desc(), F.col("entity")]
    over = lambda pct: F.col("alpha_share") >= 100.0 - pct
    entries = top_k(shares, GROUP, order, min_names + max_names, "_at").unionByName(top_k(shares.where(over(enter_pct)), GROUP, order, max_names, "_at"))
    entries = entries.select(*GROUP, "entity").distinct().withColumn("_entry", F.lit(True))
    rows = shares.join(entries, [*GROUP, "entity"], "left").where(F.col("_entry") | over(exit_pct)).join(dates, GROUP)
    entry = F.coalesce("_entry", F.lit(False))
    if start is not None:
        held = start.select("region", "entity").distinct().withColumn("_held", F.col("region").isNotNull())
        rows = rows.join(held, ["region", "entity"], "left")
        entry = entry | ((F.col("_k") == 1) & F.coalesce("_held", F.lit(False)))
    name = Window.partitionBy("region", "entity").orderBy("_k")
    gap = F.when(F.col("_k") - F.lag("_k").over(name) == 1, 0).otherwise(1)
    rows = rows.withColumn("_entry", entry).withColumn("_stretch", F.sum(gap).over(name))
    since = Window.partitionBy("region", "entity", "_stretch").orderBy("_k")
    return rows.withColumn("_live", F.max("_entry").over(since)).where("_live").drop("_entry", "_stretch", "_live", "_held")


def select_over_time(
    scored: DataFrame, start: DataFrame | None = None, enter_pct: float = 12, exit_pct: float = 28,
    min_names: int = 8, max_names: int = 12,
) -> DataFrame:
    """Rank-buffer selection per region, date after date: the picks of a region's date are the
    incumbents of its next one.

    The rules are those of ``select_names``.  ``start`` (region, entity) holds before the first date.
    A date without an eligible name picks none and leaves no incumbents.  The fold runs along a region's
    dates with its holdings (``max_names`` at most) as state, over the rows of ``buffered_candidates``.
    """
    rows = buffered_candidates(scored, start, enter_pct, exit_pct, min_names, max_names)
    by_order = F.struct(
        (-F.coalesce(F.col("above_ma200").cast("int"), F.lit(-1))).alias("below"), (-F.col("alpha")).alias("lower"), "entity", F.col("alpha_share").alias("share"))
    days = rows.groupBy(*GROUP).agg(F.sort_array(F.collect_list(by_order)).alias("names"))  # candidates of a date
    days = scored.select(*GROUP).distinct().join(days, GROUP, "left")
    names_type = days.schema["names"].dataType.simpleString()
    history = days.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("as_of", F.coalesce("names", F.array().cast(names_type)).alias("names")))).alias("days"))
    first = F.array().cast("array<string>")
    if start is not None:
        held = start.where(F.col("region").isNotNull()).groupBy("region").agg(F.collect_set("entity").alias("_start"))  # one sleeve
        history = history.join(held, "region", "left")
        first = F.coalesce("_start", first)

    let = lambda value, body: F.transform(F.array(value), body)[0]

    def pick(held, day):
        floor = lambda x: F.when(F.array_contains(held, x["entity"]), 100.0 - exit_pct).otherwise(100.0 - enter_pct)
        told = F.transform(day["names"], lambda x: F.struct(
            x["entity"].alias("entity"), x["share"].alias("share"), (x["share"] >= floor(x)).alias("qualified"), F.array_contains(held, x["entity"]).alias("incumbent")))

        def cut(all_):
            good, rest = F.filter(all_, lambda x: x["qualified"]), F.filter(all_, lambda x: ~x["qualified"])
            n = F.least(F.lit(max_names), F.greatest(F.size(good), F.least(F.lit(min_names), F.size(all_))))
            return F.slice(F.concat(good, rest), F.lit(1), n)

        return let(told, cut)

    picked = "array<struct<entity:string,share:double,qualified:boolean,incumbent:boolean>>"
    state = F.struct(first.alias("held"), F.array().cast(f"array<struct<as_of:date,picks:{picked}>>").alias("out"))
    step = lambda s, day: let(pick(s["held"], day), lambda p: F.struct(
        F.transform(p, lambda x: x["entity"]).alias("held"), F.concat(s["out"], F.array(F.struct(day["as_of"].alias("as_of"), p.alias("picks")))).alias("out")))
    out = history.select("region", F.explode(F.aggregate("days", state, step)["out"]).alias("day"))
    out = out.select("region", "day.as_of", F.posexplode("day.picks").alias("_pos", "x"))
    chosen = out.select(*GROUP, "x.entity", F.col("x.share").alias("alpha_share"), "x.qualified", "x.incumbent", (F.col("_pos") + 1).alias("pick"))
    return scored.join(chosen, [*GROUP, "entity"])


# ------------------------------------------------------------ set operations
def ordered_union(*frames: DataFrame, key: list[str] = ["entity"]) -> DataFrame:
    """Distinct union in which an earlier frame's row wins."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in both.columns if c not in key]
    w = Window.partitionBy(*key).orderBy("_source", *[c for c in rest if c != "_source"])
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_source")


def missing(requested: DataFrame, present: DataFrame, key: str = "entity") -> DataFrame:
    return requested.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: str = "entity") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def merge_names(user: DataFrame, fetched: DataFrame, bundled: DataFrame) -> DataFrame:
    """(entity, name) with precedence user, fetched, bundled."""
    return ordered_union(
        *[f.select("entity", "name").where(F.col("name").isNotNull()) for f in (user, fetched, bundled)]
    )


def coverage(requested: DataFrame, present: DataFrame, key: str = "entity") -> DataFrame:
    """One row: requested and fetched counts and the percentage, one decimal."""
    have = present.select(key).distinct().withColumn("_have", F.lit(1))
    joined = requested.select(key).distinct().join(have, key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("_have").alias("fetched"),
        round_even(100.0 * F.try_divide(F.count("_have").cast("double"), F.count(F.lit(1)).cast("double")), 1).alias("coverage_pct"),
    )


def universe(listing: DataFrame, fallback: DataFrame, core: DataFrame, n: int = 120) -> DataFrame:
    """Top n by market cap per region; a region without a listing takes the first n
    of its ordered fallback; core names are always present, ahead of the rest.

    ``listing`` is (region, entity, market_cap), ``fallback`` (region, entity,
    position) and ``core`` (region, entity).
    """
    top = top_k(
        listing.where(F.col("entity").isNotNull()), ["region"],
        [F.col("market_cap").desc_nulls_last(), F.col("entity")], n, "place",
    ).select("region", "entity", "place", F.lit("listing").alias("origin"))
    spare = top_k(
        fallback.join(listing.select("region").distinct(), "region", "left_anti"), ["region"],
        [F.col("position"), F.col("entity")], n, "place",
    ).select("region", "entity", "place", F.lit("fallback").alias("origin"))
    ranked = top.unionByName(spare)
    extra = (
        core.select("region", "entity").distinct()
        .join(ranked.select("region", "entity"), ["region", "entity"], "left_anti")
        .select("region", "entity", F.lit(0).alias("place"), F.lit("core").alias("origin"))
    )
    return ranked.unionByName(extra)
