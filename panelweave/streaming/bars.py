"""Streaming price bars: tumbling windows over an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = "1 hour"
DELAY = "10 minutes"


def event_bars(
    events: DataFrame, entity: str, ts: str = "ts", price: str = "value", qty: str | None = None,
    sequence: str | None = None, window: str = WINDOW, delay: str = DELAY,
) -> DataFrame:
    """Open, high, low, close and volume per entity and window, batch or streaming alike.

    Rows later than the watermark are dropped by a streaming run; in append
    mode a bar is emitted once its window has closed.  Volume counts rows when
    there is no quantity.
    """
    df = events.withWatermark(ts, delay) if events.isStreaming else events
    order = F.unix_micros(ts)
    if sequence:
        # Time, then sequence, as one exact number: the buffers stay fixed-width.
        order = order.cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(sequence)
        order = order.cast("decimal(38,0)")
    volume = F.sum(qty) if qty else F.count(F.lit(1))
    return (
        df.groupBy(F.col(entity).alias("entity"), F.window(ts, window).alias("_w"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), volume.alias("volume"),
        )
        .select("entity", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "open", "high", "low", "close", "volume")
    )


def closed_windows(bars: DataFrame, newest: Column, delay: str = DELAY) -> DataFrame:
    """The batch twin of append mode: windows the final watermark has passed."""
    return bars.where(F.col("end") <= newest - F.expr(f"interval {delay}"))


def start_event_bars(events: DataFrame, sink_path: str, checkpoint: str, entity: str, **kw):
    """Run the bars to a parquet sink, exactly once, until the input is drained."""
    return (
        event_bars(events, entity, **kw)
        .writeStream.outputMode("append").format("parquet")
        .option("path", sink_path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
