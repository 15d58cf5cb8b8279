"""Outcomes of signals as their bars arrive: keyed state, event time, no stored bars.

Bars and signals are one stream, keyed by entity.  What the watermark has passed is settled: no earlier
bar can come any more.  An entity's state is its pending signals, its bars from the oldest pending
signal's reference bar on, and at least the last settled one, which a coming signal may refer to.  So the
state of an entity is bounded by the longest horizon and the watermark's delay, and outcomes do not depend
on how the rows are cut into micro-batches: as long as no row is late, they are those of the batch
job over bars that the watermark has passed.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.stats import change, round_even
from ..operators.ledger import HORIZONS

DELAY = "5 days"
DAY_MS = 86_400_000
CARRIED = ["region", "model_version", "view", "alpha", "benchmark"]
STATE = "days array<int>, closes array<double>, ids array<string>, dates array<int>, done array<int>, texts array<string>"
FOUND = "id string, date date, entity string, region string, model_version string, view string, alpha double, benchmark string, horizon long, bar_ts date, end_ts date, fwd double, mfe double, mae double"
OUTCOME_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "entity", "region", "model_version", "view")]
    + [T.StructField("date", T.DateType()), T.StructField("horizon", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("alpha", "fwd", "excess", "mfe", "mae")]
)


def rows_of(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Both as one frame: entity, day (number), event_time, close (bars), id and a text of what a signal carries."""
    at = lambda c: F.unix_date(c)
    bar = bars.where(F.col("close").isNotNull()).select("entity", at("ts").alias("day"), F.col("close").cast("double").alias("close"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"))
    text = F.to_json(F.struct(*CARRIED))
    sig = signals.where("id is not null and date is not null").select("entity", at("date").alias("day"), F.lit(None).cast("double").alias("close"), "id", text.alias("text"))
    # Midnight in UTC, whatever the session's zone.
    return bar.unionByName(sig).where("entity is not null and day is not null").withColumn("event_time", F.timestamp_seconds(F.col("day") * 86_400))


def _step(horizons: tuple[int, ...]):
    everything = (1 << len(horizons)) - 1

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, closes, ids, dates, done, texts = (list(x) for x in (state.get if state.exists else ([],) * 6))
        bars, known = dict(zip(days, closes)), set(ids)
        if not state.hasTimedOut:
            for part in parts:
                # Of several bars for a day the first to come counts, of one batch the lowest.
                for day, close in part[part["id"].isna()].sort_values(["day", "close"])[["day", "close"]].itertuples(index=False):
                    bars.setdefault(int(day), float(close))
                for day, id_, text in part[part["id"].notna()].sort_values(["day", "text"])[["day", "id", "text"]].itertuples(index=False):
                    if id_ not in known:
                        known.add(id_)
                        ids.append(id_), dates.append(int(day)), done.append(0), texts.append(text)
        passed = state.getCurrentWatermarkMs()
        days = sorted(bars)
        closes = [bars[d] for d in days]
        settled = sum(1 for d in days if d * DAY_MS < passed)
        found, still, oldest = [], [], max(settled - 1, 0)
        for k in range(len(ids)):
            if dates[k] * DAY_MS >= passed:
                still.append(k)
                continue
            at = bisect_right(days, dates[k]) - 1
            if at < 0:
                continue  # before the entity's first bar
            for n, h in enumerate(horizons):
                if not done[k] >> n & 1 and at + h < settled:
                    path = closes[at : at + h + 1]
                    done[k] |= 1 << n
                    found.append((ids[k], dates[k], texts[k], h, days[at], days[at + h], path))
            if done[k] != everything:
                still.append(k)
                oldest = min(oldest, at)
        days, closes = days[oldest:], closes[oldest:]
        state.update((days, closes, *([x[k] for k in still] for x in (ids, dates, done, texts))))
        waiting = [d * DAY_MS for d in [*days, *(dates[k] for k in still)] if d * DAY_MS >= passed]
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting), passed + 1))
        if found:
            yield pd.DataFrame([_outcome(key[0], *f) for f in found])

    return run


def _outcome(entity: str, id_: str, day: int, text: str, horizon: int, start: int, end: int, path: list[float]) -> dict:
    date = lambda d: (pd.Timestamp(0) + pd.Timedelta(days=d)).date()
    grown = lambda x: x / path[0] - 1 if path[0] else None
    carried = {c: None for c in CARRIED} | json.loads(text)
    return {"id": id_, "date": date(day), "entity": entity, **carried, "horizon": horizon, "bar_ts": date(start), "end_ts": date(end), "fwd": grown(path[-1]), "mfe": grown(max(path)), "mae": grown(min(path))}


def matured(bars: DataFrame, signals: DataFrame, benchmarks: DataFrame, horizons=HORIZONS, delay: str = DELAY) -> DataFrame:
    """The stream of outcomes, one row per signal and horizon.  ``benchmarks`` (benchmark, ts, bench) is a table."""
    keyed = rows_of(bars, signals).withWatermark("event_time", delay).groupBy("entity")
    found = keyed.applyInPandasWithState(_step(tuple(horizons)), FOUND, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    # The cast copies the rows out of the operator's Arrow batches, which an exchange cannot write.
    found = found.withColumn("horizon", F.col("horizon").cast("int"))
    b = benchmarks.where(F.col("bench").isNotNull())
    start = b.select("benchmark", F.col("ts").alias("bar_ts"), F.col("bench").alias("_b0"))
    end = b.select("benchmark", F.col("ts").alias("end_ts"), F.col("bench").alias("_b1"))
    df = found.join(start, ["benchmark", "bar_ts"], "left").join(end, ["benchmark", "end_ts"], "left")
    values = {"fwd": F.col("fwd"), "excess": F.col("fwd") - change("_b1", "_b0"), "mfe": F.col("mfe"), "mae": F.col("mae")}
    names = [f.name for f in OUTCOME_SCHEMA.fields]
    return df.select(*[(round_even(values[c], 4) if c in values else F.col(c)).alias(c) for c in names])


def start_maturity(bars: DataFrame, signals: DataFrame, benchmarks: DataFrame, outcome_path: str, checkpoint: str, horizons=HORIZONS, delay: str = DELAY):
    """Store each outcome once, as soon as the watermark has passed its last bar, until the input is drained."""
    return (
        matured(bars, signals, benchmarks, horizons, delay)
        .writeStream.outputMode("append").format("parquet")
        .option("path", outcome_path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
