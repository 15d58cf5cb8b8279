"""Consensus, gates, list operators and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbols as sy

from ..operators import consensus as cs
from ..operators import gates as gt
from ..operators import selection as sel
from ..sources import bars as src
from ..sources import export as ex
from . import views as v
from .catalog import register
from .crosssection_queries import PICKS, picks
from .feature_queries import B

NOW = "2025-01-01 00:00:00"


# --------------------------------------------------------------------- opinions
def opinions(spark, sf):
    """One view per document: label present = verified, quality and toxicity = stance."""
    d = v.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    d = d.join(v.table(spark, sf, "labels"), "doc_id", "left")
    pub = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("doc_id") * 7, F.lit(8760)) * 3600)
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("theme"),
        F.col("quality").isNotNull().alias("verified"),
        (F.col("quality") * 2 - F.col("toxic") * 1.5 + (F.col("n_chars") % 5) / 4.0 - 1).alias("stance"),
        F.when(F.col("doc_id") % 11 != 0, pub).alias("published_at"),
        F.when(F.col("doc_id") % 3 != 0, pub + F.expr("interval 1 day")).alias("verified_at"),
        (90 + F.col("n_chars") % 120).cast("int").alias("stale_after_days"),
        F.col("text").alias("summary"), F.lit(None).cast("string").alias("url"),
    )


def opinion_sources(spark, sf):
    num = F.regexp_replace("source", "src", "").cast("int")
    d = v.table(spark, sf, "documents").select("source").distinct()
    return d.select(
        F.col("source").alias("id"), F.concat(F.lit("House "), (num % 7).cast("string")).alias("institution"),
        F.when(num % 5 == 0, "companyIR").otherwise("assetManager").alias("source_type"),
        F.when(num % 3 == 0, 0.75).otherwise(1.0).alias("weight"), F.concat(F.lit("https://example.org/"), "source").alias("url"),
    )


OPS = f"""op0 AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, d.source AS source_id, d.lang AS theme, l.quality IS NOT NULL AS verified, l.quality * 2 - l.toxic * 1.5 + (d.n_chars % 5) / 4.0 - 1 AS stance,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * ((d.doc_id * 7) % 8760) AS pub, 90 + d.n_chars % 120 AS stale_after_days, d.text AS summary FROM documents d LEFT JOIN labels l USING (doc_id)),
op1 AS (SELECT *, CASE WHEN doc_id % 11 <> 0 THEN pub END AS published_at, CASE WHEN doc_id % 3 <> 0 THEN pub + INTERVAL 1 DAY END AS verified_at FROM op0),
op2 AS (SELECT *, CAST(floor(epoch(TIMESTAMP '{NOW}' - coalesce(verified_at, published_at)) / 86400) AS INTEGER) AS age_days FROM op1),
cl AS (SELECT *, CASE WHEN verified AND stance IS NOT NULL THEN CASE WHEN coalesce(age_days > stale_after_days, false) THEN 'STALE' ELSE 'VERIFIED' END ELSE 'UNVERIFIED' END AS status FROM op2),
src AS (SELECT DISTINCT source AS id, 'House ' || (CAST(replace(source, 'src', '') AS INTEGER) % 7) AS institution, CAST(replace(source, 'src', '') AS INTEGER) % 5 = 0 AS ir,
  CASE WHEN CAST(replace(source, 'src', '') AS INTEGER) % 3 = 0 THEN 0.75 ELSE 1.0 END AS weight FROM documents),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, theme ORDER BY age_days NULLS LAST, id) AS rn FROM cl WHERE status = 'VERIFIED') WHERE rn = 1),
wv AS (SELECT d.*, s.institution, s.weight * CASE WHEN s.ir THEN 0.25 ELSE 1 END AS w FROM dd d JOIN src s ON s.id = d.source_id)"""


def classified(spark, sf):
    return cs.classify_views(opinions(spark, sf), NOW + "Z")


@register("view_status", "A29", f"WITH {OPS} --final SELECT * FROM cl", "id status", "age_days")
def _(spark, sf):
    return classified(spark, sf)


@register("freshest_views", "A30", f"WITH {OPS} --final SELECT * FROM dd", "id source_id theme", "age_days")
def _(spark, sf):
    return cs.dedup_views(classified(spark, sf))


def weighted(spark, sf):
    return cs.weighted_views(cs.dedup_views(classified(spark, sf)), opinion_sources(spark, sf))


@register("weighted_views", "A32 J8", f"WITH {OPS} --final SELECT id, theme, institution, stance, w AS view_weight FROM wv", "id theme institution", "", "stance view_weight")
def _(spark, sf):
    return weighted(spark, sf)


@register(
    "consensus", "A31 A32 K6",
    f"""WITH {OPS}, st AS (SELECT theme, round_even(max(stance) - min(stance), 2) AS dispersion, count(DISTINCT institution) AS institutions, count(*) AS n_views FROM wv GROUP BY 1),
    cw AS (SELECT theme, stance, sum(sum(w)) OVER (PARTITION BY theme ORDER BY stance) AS cum, sum(sum(w)) OVER (PARTITION BY theme) AS tot FROM wv GROUP BY 1, 2),
    md AS (SELECT theme, min(stance) AS m FROM cw WHERE cum >= tot / 2 GROUP BY 1)
    --final SELECT theme, dispersion, institutions, n_views, m AS median_stance, CASE WHEN institutions < 2 THEN 'insufficient' WHEN dispersion <= 1 THEN 'high' WHEN dispersion >= 2.5 THEN 'low' ELSE 'mixed' END AS agreement FROM st JOIN md USING (theme)""",
    "theme agreement", "institutions n_views", "dispersion median_stance", 2,
)
def _(spark, sf):
    return cs.consensus(weighted(spark, sf))


@register(
    "review_queue", "A33",
    f"""WITH {OPS} --final SELECT id, status, CASE WHEN status = 'UNVERIFIED' THEN concat_ws(',', CASE WHEN published_at IS NULL THEN 'published_at' END, CASE WHEN verified_at IS NULL THEN 'verified_at' END,
      CASE WHEN stance IS NULL THEN 'stance' END, CASE WHEN summary IS NULL OR summary = '' THEN 'summary' END, CASE WHEN NOT verified THEN 'verified' END) END AS missing FROM cl WHERE status <> 'VERIFIED'""",
    "id status missing",
)
def _(spark, sf):
    return cs.review_queue(classified(spark, sf), opinion_sources(spark, sf)).withColumn("missing", F.array_join("missing_fields", ","))


@register(
    "verification_coverage", "A33",
    f"""WITH {OPS} --final SELECT (SELECT count(*) FROM cl) AS candidates, (SELECT count(*) FROM cl WHERE status = 'STALE') AS stale, (SELECT count(*) FROM cl WHERE status = 'UNVERIFIED') AS awaiting,
      (SELECT count(*) FROM dd) AS verified, round_even((SELECT count(*) FROM dd) / (SELECT count(*) FROM cl), 2) AS coverage""",
    "", "candidates stale awaiting verified", "coverage", 2,
)
def _(spark, sf):
    c = classified(spark, sf)
    return cs.verification_coverage(c, cs.dedup_views(c))


# -------------------------------------------------------------- lists and symbols
def names(spark, sf):
    """Entities with their number, from the part table."""
    p = v.table(spark, sf, "part").select(F.col("p_brand").alias("entity")).distinct()
    return v.with_dims(p).withColumn("k", F.regexp_replace("entity", "Brand#", "").cast("int"))


NAMES = """nm AS (SELECT DISTINCT p_brand AS entity, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS k FROM part),
nr AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'US' ELSE 'KR' END AS region FROM nm)"""


@register("exclude_entities", "P5", f"WITH {NAMES}, {v.BARS} --final SELECT entity, count(*) AS n FROM bars WHERE entity NOT IN (SELECT entity FROM nm WHERE k % 5 = 0) GROUP BY 1", "entity", "n")
def _(spark, sf):
    return sel.exclude_entities(v.bars(spark, sf), names(spark, sf).where("k % 5 = 0")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@register(
    "region_routing", "P7", f"WITH {NAMES}, t AS (SELECT entity || CASE WHEN k % 3 = 0 THEN '.KS' WHEN k % 3 = 1 THEN '.kq' ELSE '' END AS entity, k FROM nm) "
    "--final SELECT entity, CASE WHEN k % 4 = 0 THEN 'JP' WHEN upper(entity) LIKE '%.KS' OR upper(entity) LIKE '%.KQ' THEN 'KR' ELSE 'US' END AS region FROM t", "entity region",
)
def _(spark, sf):
    k = F.col("k")
    t = names(spark, sf).select(F.concat("entity", F.when(k % 3 == 0, ".KS").when(k % 3 == 1, ".kq").otherwise("")).alias("entity"), "k")
    listing = t.where("k % 4 = 0").select("entity", F.lit("JP").alias("region"))
    return sy.region_of(t, listing)


@register(
    "symbol_normalization", "P8",
    """WITH s AS (SELECT p_partkey, ' ' || replace(p_name, ' ', '.') || CASE WHEN p_partkey % 50 = 0 THEN '' ELSE ' ' END AS us, CASE WHEN p_partkey % 7 = 0 THEN p_partkey || 'K' ELSE CAST(p_partkey AS VARCHAR) END AS kr,
      CASE WHEN p_partkey % 3 = 0 THEN 'brk.b' WHEN p_partkey % 3 = 1 THEN ' BFB' ELSE 'x.y' END AS cls FROM part)
    --final SELECT p_partkey, replace(upper(trim(us)), '.', '-') AS us, CASE WHEN regexp_full_match(kr, '[0-9]+') THEN CASE WHEN length(kr) < 6 THEN lpad(kr, 6, '0') ELSE kr END || '.KS' END AS kr,
      CASE WHEN p_partkey % 3 = 0 THEN 'BRK-B' WHEN p_partkey % 3 = 1 THEN 'BF-B' ELSE 'X-Y' END AS cls FROM s""",
    "us kr cls", "p_partkey",
)
def _(spark, sf):
    k = F.col("p_partkey")
    p = v.table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(".")), F.when(k % 50 == 0, "").otherwise(" ")).alias("us"),
        F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit("K"))).otherwise(k.cast("string")).alias("kr"),
        F.when(k % 3 == 0, "brk.b").when(k % 3 == 1, " BFB").otherwise("x.y").alias("cls"),
    )
    return p.select("p_partkey", sy.norm_symbol_us("us").alias("us"), sy.norm_symbol_kr("kr").alias("kr"), sy.norm_symbol_us("cls").alias("cls"))


@register(
    "sector_lookup", "P9", f"WITH {NAMES} --final SELECT entity, CASE WHEN k % 4 = 0 THEN 'Override' WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'Financials' ELSE 'Energy' END AS sector FROM nm", "entity sector",
)
def _(spark, sf):
    n = names(spark, sf)
    o = n.select("entity", F.when(F.col("k") % 4 == 0, "Override").when(F.col("k") % 4 == 1, "").alias("provided"))
    return sy.with_sector(o, n.where("k % 3 <> 0").select("entity", "sector"), "provided")


@register("text_search", "P13", "--final SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_brand, p_name)), 'bolt')", "p_name", "p_partkey")
def _(spark, sf):
    p = v.table(spark, sf, "part").withColumn("entity", F.col("p_brand"))
    return sel.search(p, "  BOLT ", ("entity", "p_name"))


@register(
    "universe", "K4",
    f"""WITH {NAMES}, {v.FUND}, l AS (SELECT n.region, n.entity, market_cap FROM nr n JOIN fund f USING (entity) WHERE n.region = 'US'),
    t AS (SELECT region, entity, row_number() OVER (PARTITION BY region ORDER BY market_cap DESC NULLS LAST, entity) AS place, 'listing' AS origin FROM l),
    f AS (SELECT region, entity, row_number() OVER (PARTITION BY region ORDER BY k) AS place, 'fallback' AS origin FROM nr WHERE region NOT IN (SELECT region FROM l)),
    r AS (SELECT * FROM t WHERE place <= 6 UNION ALL SELECT * FROM f WHERE place <= 6)
    --final SELECT * FROM r UNION ALL SELECT region, entity, 0, 'core' FROM nr WHERE k % 6 = 0 AND entity NOT IN (SELECT entity FROM r)""",
    "region entity origin", "place",
)
def _(spark, sf):
    n = names(spark, sf)
    listing = n.where("region = 'US'").join(v.fundamentals(spark, sf).select("entity", "market_cap"), "entity")
    return sel.universe(listing, n.withColumnRenamed("k", "position"), n.where("k % 6 = 0"), 6)


@register(
    "priority_union_and_names", "U1 U4",
    f"WITH {NAMES} --final SELECT entity, CASE WHEN k % 5 = 0 THEN 'user ' || k WHEN k % 2 = 0 THEN 'fetched ' || k ELSE 'bundled ' || k END AS name FROM nm", "entity name",
)
def _(spark, sf):
    n = names(spark, sf)
    call = lambda prefix, cond: n.where(cond).select("entity", F.concat(F.lit(prefix), F.col("k").cast("string")).alias("name"))
    return sel.merge_names(call("user ", "k % 5 = 0"), call("fetched ", "k % 2 = 0"), call("bundled ", "true"))


@register("set_difference", "U2 A34", f"WITH {NAMES} --final SELECT entity FROM nm WHERE k % 4 = 3", "entity")
def _(spark, sf):
    n = names(spark, sf)
    return sel.missing(n, v.bars(spark, sf).where(F.regexp_replace("entity", "Brand#", "").cast("int") % 4 != 3))


@register("set_intersection", "U3 J10", f"WITH {NAMES} --final SELECT entity FROM nm WHERE k % 2 = 0 AND k % 3 = 0", "entity")
def _(spark, sf):
    n = names(spark, sf)
    return sel.common(n.where("k % 2 = 0"), n.where("k % 3 = 0"))


@register("request_coverage", "A34", f"WITH {NAMES} --final SELECT count(*) AS requested, count(*) FILTER (k % 4 <> 3) AS fetched, round_even(100.0 * count(*) FILTER (k % 4 <> 3) / count(*), 1) AS coverage_pct FROM nm", "", "requested fetched", "coverage_pct", 1)
def _(spark, sf):
    n = names(spark, sf)
    return sel.coverage(n, v.bars(spark, sf).where(F.regexp_replace("entity", "Brand#", "").cast("int") % 4 != 3))


@register(
    "source_fallback", "S4",
    f"{B} SELECT entity, ts, CASE WHEN region = 'US' THEN close ELSE close + 1 END AS close, CASE WHEN region = 'US' THEN 'primary' ELSE 'fallback' END AS source FROM bars", "entity ts source", "", "close", 4,
)
def _(spark, sf):
    b = v.bars(spark, sf).select("entity", "region", "ts", "close")
    primary = b.withColumn("close", F.when(F.col("region") == "US", F.col("close")))
    return src.resolve_source(primary, b.withColumn("close", F.col("close") + 1))


# -------------------------------------------------------------------------- gates
def runs(spark, sf):
    """One run per month: coverage and errors from how many brands traded on its days."""
    b = v.bars(spark, sf)
    m = b.groupBy(F.last_day("ts").alias("as_of")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("present"))
    mon = F.month("as_of")
    return m.select(
        "as_of", (mon == 1).alias("seed"), (mon == 2).alias("stale"), ((mon == 3) | (mon == 1) & (F.year("as_of") % 2 == 0)).alias("synthetic"), (mon == 5).alias("build_failed"),
        F.when(mon == 6, 0).otherwise(F.col("present")).cast("long").alias("models_trained"),
        (100.0 * F.col("present") / 25).alias("coverage_pct"), (F.pmod(F.col("n"), F.lit(7))).cast("long").alias("n_errors"), F.lit(25).cast("long").alias("universe_screened"),
        F.when(mon % 4 == 0, "liveValidated").when(mon % 4 == 1, " researchOnly ").when(mon % 4 == 2, "other").alias("configured"),
    )


RUNS = """ru0 AS (SELECT month_end AS as_of, count(*) AS n, count(DISTINCT entity) AS present, month(month_end) AS mon, year(month_end) AS yr FROM bars GROUP BY month_end),
runs AS (SELECT as_of, mon = 1 AS seed, mon = 2 AS stale, mon = 3 OR (mon = 1 AND yr % 2 = 0) AS synthetic, mon = 5 AS build_failed, CASE WHEN mon = 6 THEN 0 ELSE present END AS models_trained,
  100.0 * present / 25 AS coverage_pct, n % 7 AS n_errors, mon FROM ru0),
gated AS (SELECT *, concat_ws(',', CASE WHEN seed THEN 'seed_data' END, CASE WHEN stale THEN 'stale_data' END, CASE WHEN models_trained = 0 THEN 'models_trained_zero' END, CASE WHEN coverage_pct < 95 THEN 'coverage_below_95' END,
  CASE WHEN build_failed THEN 'build_validation_failed' END, CASE WHEN synthetic THEN 'synthetic_data' END, CASE WHEN n_errors > 2.5 THEN 'pipeline_errors_excessive' END) AS reasons FROM runs)"""


@register("block_reasons", "G1", f"WITH {v.BARS}, {RUNS} --final SELECT as_of, reasons, reasons <> '' AS blocked FROM gated", "as_of reasons blocked")
def _(spark, sf):
    return gt.block_reasons(runs(spark, sf)).withColumn("reasons", F.array_join("block_reasons", ","))


@register(
    "modes", "G4", f"""WITH {v.BARS}, {RUNS} --final SELECT as_of, CASE WHEN synthetic THEN 'synthetic' WHEN seed THEN 'seed' WHEN stale THEN 'stale' ELSE 'live' END AS data_mode,
      CASE WHEN mon % 4 = 1 THEN 'researchOnly' ELSE 'paperTrading' END AS run_mode FROM runs""", "as_of data_mode run_mode",
)
def _(spark, sf):
    return runs(spark, sf).select("as_of", gt.data_mode().alias("data_mode"), gt.run_mode("configured").alias("run_mode"))


def gated_picks(spark, sf):
    p = picks(spark, sf).select("as_of", "region", "entity", "pick", "alpha")
    return p.join(gt.block_reasons(runs(spark, sf)).select("as_of", "blocked"), "as_of")


@register(
    "withheld_picks", "G2",
    f"""WITH RECURSIVE {PICKS}, {RUNS} --final SELECT p.as_of, p.region, p.entity, g.reasons <> '' AS blocked, CASE WHEN g.reasons = '' THEN p.pick END AS pick, p.alpha FROM picks p JOIN gated g ON g.as_of = p.as_of""",
    "as_of region entity blocked", "pick", "alpha",
)
def _(spark, sf):
    p = gated_picks(spark, sf)
    return gt.withhold(p, F.col("blocked"))


@register(
    "withheld_tables", "G2 G6",
    f"""WITH {v.BARS}, {RUNS} --final SELECT b.entity, b.ts FROM bars b JOIN gated g ON b.month_end = g.as_of WHERE g.reasons = '' AND NOT (g.seed OR g.stale OR g.synthetic)""", "entity ts",
)
def _(spark, sf):
    r = gt.block_reasons(runs(spark, sf)).select("as_of", "blocked", gt.data_mode().alias("data_mode"))
    b = v.bars(spark, sf).withColumn("as_of", F.last_day("ts")).join(r, "as_of")
    return gt.live_only(gt.withhold_rows(b, F.col("blocked")))


@register(
    "invariant_audit", "G3",
    f"""WITH {v.BARS}, {RUNS}, t AS (SELECT b.*, g.reasons <> '' AS blocked, g.models_trained, g.coverage_pct, CASE WHEN g.synthetic THEN 'synthetic' WHEN g.seed THEN 'seed' WHEN g.stale THEN 'stale' ELSE 'live' END AS data_mode, g.mon FROM bars b JOIN gated g ON b.month_end = g.as_of),
    c AS (SELECT * FROM (VALUES ('missing_provenance_market_as_of', (SELECT count(*) FROM t WHERE mon = 7)), ('invalid_run_mode', (SELECT count(*) FROM t WHERE mon % 4 = 1)), ('liveValidated_not_earned', (SELECT count(*) FROM t WHERE mon % 4 = 0)),
      ('invalid_run_mode_extra', 0),
      ('nan_or_infinity:close', (SELECT count(*) FROM t WHERE mon = 9)), ('seed_or_synthetic_not_allowed_for_production', (SELECT count(*) FROM t WHERE data_mode IN ('seed', 'synthetic'))), ('stale_not_allowed_for_production', (SELECT count(*) FROM t WHERE data_mode = 'stale')),
      ('models_trained_zero', (SELECT count(*) FROM t WHERE models_trained <= 0)), ('coverage_below_floor', (SELECT count(*) FROM t WHERE coverage_pct < 95)), ('blocked_row_carries_weight', (SELECT count(*) FROM t WHERE blocked))) x(violation, rows))
    --final SELECT * FROM c WHERE rows > 0""",
    "violation", "rows",
)
def _(spark, sf):
    r = gt.block_reasons(runs(spark, sf)).select("as_of", "blocked", "models_trained", "coverage_pct", gt.data_mode().alias("data_mode"))
    t = v.bars(spark, sf).select("entity", "close", F.last_day("ts").alias("as_of")).join(r, "as_of")
    mon = F.month("as_of")
    t = gt.stamp(t, {"schema_version": "1.0", "model_version": "scoring-1"}).drop("data_mode").join(r.select("as_of", "data_mode"), "as_of")
    t = t.withColumns({
        "market_as_of": F.when(mon != 7, F.col("as_of").cast("string")),
        "run_mode": F.when(mon % 4 == 0, "liveValidated").when(mon % 4 == 1, "bogus").otherwise("paperTrading"),
        "close": F.when(mon == 9, F.lit(float("nan"))).otherwise(F.col("close")),
        "weight": F.lit(1.0),
    })
    return gt.audit(t, "bars")


# Three tables of the same runs: sleeves with nested values, ideas that blocked runs may not have, and a screen
# that was never made.  Every fourth sleeve tells what to do; scores of October are infinite.
NESTED = f"""{PICKS}, {RUNS}, sl AS (SELECT p.as_of, p.region, g.reasons <> '' AS blocked, g.mon, count(*) AS n, bool_or(p.pick = 1 AND p.qualified) AS q FROM picks p JOIN gated g ON g.as_of = p.as_of GROUP BY ALL),
c AS (SELECT * FROM (VALUES ('sleeves', 'blocked_row_carries_sleeve.holdings', (SELECT count(*) FROM sl WHERE blocked)), ('sleeves', 'blocked_row_carries_sleeve.names[].weight_pct', (SELECT count(*) FROM sl WHERE blocked)),
  ('sleeves', 'blocked_row_tells_sleeve.notes{{}}.reasons[]', (SELECT count(*) FROM sl WHERE blocked AND mon % 4 = 0)), ('sleeves', 'nan_or_infinity:sleeve.notes{{}}.score', (SELECT count(*) FROM sl WHERE mon = 10)),
  ('sleeves', 'nan_or_infinity:sleeve.names[].weight_pct', (SELECT count(*) FROM sl WHERE mon = 11)), ('sleeves', 'missing_provenance_market_as_of', (SELECT count(*) FROM sl WHERE mon = 7)),
  ('ideas', 'blocked_run_has_rows', (SELECT count(*) FROM picks p JOIN gated g ON g.as_of = p.as_of WHERE g.reasons <> '')), ('ideas', 'blocked_row_carries_pick', (SELECT count(*) FROM picks p JOIN gated g ON g.as_of = p.as_of WHERE g.reasons <> '')),
  ('screen', 'missing_table', 1)) x(table_name, violation, rows))"""


@register("nested_audit", "G3", f"WITH RECURSIVE {NESTED} --final SELECT * FROM c WHERE rows > 0", "table_name violation", "rows")
def _(spark, sf):
    r = gt.block_reasons(runs(spark, sf)).select("as_of", "blocked")
    p = picks(spark, sf).select("as_of", "region", "entity", "pick", "alpha").join(r, "as_of")
    mon = F.month("as_of")
    stamped = lambda df: gt.stamp(df, {"schema_version": "1.0", "model_version": "scoring-1", "run_mode": "paperTrading", "data_mode": "live"}).withColumn("market_as_of", F.when(mon != 7, F.col("as_of").cast("string")) if "sleeve" in df.columns else F.col("as_of").cast("string"))
    weight = F.when(mon == 11, F.lit(float("nan"))).otherwise(F.lit(8.0))
    names = F.collect_list(F.struct("entity", weight.alias("weight_pct")))
    score = F.when(mon == 10, F.lit(float("inf"))).otherwise(F.lit(1.0))
    note = F.create_map(F.lit("entry"), F.struct(score.alias("score"), F.when(mon % 4 == 0, F.array(F.lit("WAIT for it"), F.lit("x"))).otherwise(F.array(F.lit("trend"))).alias("reasons")))
    sleeves = p.groupBy("as_of", "region", "blocked").agg(names.alias("names"), F.collect_list("entity").alias("holdings"))
    sleeves = sleeves.select("as_of", "region", "blocked", F.struct("holdings", "names", note.alias("notes")).alias("sleeve"))
    return gt.audit_all({"sleeves": stamped(sleeves), "ideas": stamped(p.drop("alpha"))}, required=["sleeves", "ideas", "screen"], ideas=["ideas"])


@register("sanitized_export", "S8", f"{B} SELECT entity, ts, CASE WHEN month(ts) NOT IN (2, 3, 4) THEN close END AS value, CASE WHEN month(ts) <> 5 THEN volume END AS nested FROM bars", "entity ts", "", "value nested", 3)
def _(spark, sf):
    m = F.month("ts")
    bad = F.when(m == 2, F.lit(float("nan"))).when(m == 3, F.lit(float("inf"))).when(m == 4, F.lit(float("-inf"))).otherwise(F.col("close"))
    t = v.bars(spark, sf).select("entity", "ts", bad.alias("value"), F.array(F.struct(F.when(m == 5, F.lit(float("nan"))).otherwise(F.col("volume")).alias("x"))).alias("deep"))
    return ex.sanitize(t).withColumn("nested", F.col("deep")[0]["x"])


def states(spark, sf):
    """One stored snapshot per region and month with assorted defects."""
    b = v.bars(spark, sf)
    mon = F.month("generated_at")
    g = b.groupBy("region", F.last_day("ts").alias("generated_at")).agg(F.countDistinct("entity").alias("n"))
    return g.select(
        "region", "generated_at", F.when(mon == 12, "0.9").otherwise("1.0").alias("schema_version"), F.when(mon == 11, "old").otherwise("scoring-1").alias("model_version"),
        F.when(mon == 10, "seed").otherwise("live").alias("data_mode"), (mon == 9).alias("seed"), F.lit(None).cast("boolean").alias("stale"), (mon != 8).alias("validation_passed"),
        F.when(mon != 7, F.array(F.col("n").cast("string"))).alias("holdings"),
    )


STATES = """sts AS (SELECT region, month_end AS generated_at, month(month_end) AS mon, CAST(count(DISTINCT entity) AS VARCHAR) AS held FROM bars GROUP BY 1, 2),
sr AS (SELECT *, CASE mon WHEN 12 THEN 'schema_version_mismatch' WHEN 11 THEN 'model_version_mismatch' WHEN 10 THEN 'non_live_state' WHEN 9 THEN 'non_live_state' WHEN 8 THEN 'production_validation_missing' WHEN 7 THEN 'holdings_missing' END AS reason FROM sts)"""


@register("state_status", "S9", f"WITH {v.BARS}, {STATES} --final SELECT * FROM sr", "region generated_at reason")
def _(spark, sf):
    return ex.state_status(states(spark, sf), "1.0", "scoring-1")


@register("prior_state", "S9", f"WITH {v.BARS}, {STATES} --final SELECT region, max(generated_at) AS generated_at, arg_max(held, generated_at) AS holdings FROM sr WHERE reason IS NULL GROUP BY 1", "region generated_at holdings")
def _(spark, sf):
    return ex.load_prior_state(states(spark, sf), "1.0", "scoring-1").withColumn("holdings", F.array_join("holdings", ","))


@register(
    "state_snapshot", "S10 G5",
    f"""WITH RECURSIVE {PICKS} --final SELECT region, 'live' AS data_mode, string_agg(entity, ',' ORDER BY pick) AS holdings, '1.0' AS schema_version FROM picks WHERE as_of = (SELECT max(as_of) FROM picks) GROUP BY region""",
    "region data_mode holdings schema_version",
)
def _(spark, sf):
    p = picks(spark, sf)
    last = p.select(F.max("as_of")).scalar()
    out = ex.snapshot_state(p.where(F.col("as_of") == last), {"data_mode": "live", "validation_passed": True, "schema_version": "1.0", "model_version": "scoring-1"})
    return out.withColumn("holdings", F.array_join("holdings", ","))


@register(
    "validation_read", "S11",
    f"""WITH {v.BARS}, s AS (SELECT entity, CASE WHEN num % 5 <> 0 THEN count(*) // 13 END AS d FROM bars GROUP BY entity, num)
    --final SELECT entity, coalesce(d, 0) AS paper_days, 0 AS matured_signals, coalesce(d, 0) >= 126 AS live_validation_eligible, false AS live_validated FROM s""",
    "entity live_validation_eligible live_validated", "paper_days matured_signals",
)
def _(spark, sf):
    k = F.regexp_replace("entity", "Brand#", "").cast("int")
    s = v.bars(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).select(
        "entity", F.when(k % 5 != 0, F.floor(F.col("n") / 13)).alias("paper_days"), F.lit(None).cast("long").alias("matured_signals"),
        F.lit(True).alias("live_validation_eligible"), F.lit(True).alias("live_validated"))
    return ex.load_validation(s)


# -------------------------------------------------------------------- event bars
EVENT_BARS = """ev AS (SELECT event_type AS entity, date_trunc('hour', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
closed AS (SELECT * FROM ev WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"""


@register("event_bars", "R1", f"WITH {EVENT_BARS} --final SELECT * FROM closed", "entity start", "volume", "open high low close", 4)
def _(spark, sf):
    from ..streaming.bars import closed_windows, event_bars

    e = v.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = event_bars(e, "event_type", "ts", "value", sequence="event_id")
    return closed_windows(out, e.select(F.max("ts")).scalar()).withColumn("start", F.col("start").cast("timestamp_ntz"))
