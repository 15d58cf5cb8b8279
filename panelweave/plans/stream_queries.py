"""Streams played from the given tables, against the batch SQL over what the watermark has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lg
from ..sources.ledger_store import LEDGER_SCHEMA, read_ledger
from ..streaming import bars as sb
from ..streaming import ledger as sl
from ..streaming import maturity as mt
from ..streaming.replay import drained, replay, span_step, stream_folder
from . import views as v
from .catalog import register
from .outcome_queries import OUT, SIG, signals

# Events come in six steps of equal time; one in twenty comes two steps late, when most hours of its own
# step are closed.  A batch drops what the watermark of the batch before it has passed.
STEPS, LATE = 6, 2
PLAYED = f"""t AS (SELECT *, epoch_us(ts) AS us FROM events),
sp AS (SELECT min(us) AS a, max(us) AS b FROM t),
e AS (SELECT t.*, least({STEPS - 1}, (us - a) * {STEPS} // (b - a + 1) + CASE WHEN event_id % 20 = 0 THEN {LATE} ELSE 0 END) AS step FROM t, sp),
seen AS (SELECT s.step, (SELECT max(ts) FROM e WHERE e.step < s.step - 1) - INTERVAL 10 MINUTE AS passed FROM (SELECT unnest(range({STEPS})) AS step) s),
ok AS (SELECT e.* FROM e JOIN seen USING (step) WHERE passed IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > passed),
ev AS (SELECT event_type AS entity, date_trunc('hour', ts) AS start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM ok GROUP BY 1, 2)"""


@register(
    "streamed_bars", "R1", f"WITH {PLAYED} --final SELECT * FROM ev WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
    "entity start", "volume", "open high low close", 4,
)
def _(spark, sf):
    e = v.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    own = span_step(F.unix_micros("ts"), first or 0, last or 0, STEPS)
    step = F.least(own + F.when(F.col("event_id") % 20 == 0, LATE).otherwise(0), F.lit(STEPS - 1))
    folder = stream_folder(spark, "events")
    stream = replay(e, step, STEPS, f"{folder}/in", 4)
    drained(sb.start_event_bars(stream, f"{folder}/out", f"{folder}/checkpoint", "event_type", sequence="event_id"))
    return spark.read.parquet(f"{folder}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


# All signals, then all of them again with other values, then undated ones: the first record of an id stays.
@register("streamed_ledger", "R2 S7", f"WITH {SIG} --final SELECT * FROM sig", "id date entity region view", "", "alpha ref_close")
def _(spark, sf):
    s = signals(spark, sf)
    again = s.withColumns({"alpha": F.col("alpha") + 1, "view": F.lit("CHANGED")})
    undated = s.withColumn("date", F.lit(None).cast("date"))
    offered = s.withColumn("turn", F.lit(0)).unionByName(again.withColumn("turn", F.lit(1))).unionByName(undated.withColumn("turn", F.lit(2)))
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in s.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields]
    folder = stream_folder(spark, "ledger")
    stream = replay(offered.select(*columns, "turn"), F.col("turn"), 3, f"{folder}/in")
    for checkpoint in ("checkpoint", "lost"):  # the second run knows nothing of the first
        drained(sl.start_ledger_append(stream, f"{folder}/ledger", f"{folder}/{checkpoint}"))
    return read_ledger(spark, f"{folder}/ledger")


PASSED = "(SELECT greatest((SELECT max(ts) FROM bars WHERE close IS NOT NULL), (SELECT max(date) FROM sig)) - 5)"


@register(
    "streamed_outcomes", "R3 A22 J6",
    "WITH " + OUT.replace("outc AS (SELECT ", "outc AS (SELECT p.end_ts, ") + f" --final SELECT * FROM outc WHERE end_ts < {PASSED}",
    "id date entity region view", "horizon", "alpha fwd excess mfe mae",
)
def _(spark, sf):
    b, s = v.bars(spark, sf).where("close is not null"), signals(spark, sf)
    day = F.unix_date("ts")
    first, last = b.agg(F.min(day), F.max(day)).first()
    newest = s.agg(F.max(F.unix_date("date"))).first()[0]
    last = max(last or 0, newest or 0)
    folder = stream_folder(spark, "outcomes")
    at = lambda when: F.greatest(span_step(F.unix_date(when), first or 0, last, 4), F.lit(0))
    streams = replay(b.select("entity", "ts", "close"), at("ts"), 4, f"{folder}/bars"), replay(s, at("date"), 4, f"{folder}/signals")
    benchmark = v.benchmark(b).withColumnRenamed("region", "benchmark")
    drained(mt.start_maturity(*streams, benchmark, f"{folder}/out", f"{folder}/checkpoint", lg.HORIZONS))
    return spark.read.schema(mt.OUTCOME_SCHEMA).parquet(f"{folder}/out")
