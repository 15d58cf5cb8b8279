"""Streaming ledger append, exactly once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.ledger_store import LEDGER_SCHEMA, append_ledger


def start_ledger_append(signals: DataFrame, path: str, checkpoint: str, schema: T.StructType = LEDGER_SCHEMA, query: str = "ledger"):
    """Append each new signal id once; the first record of an id is immutable.

    A batch is one commit under (``query`` and the checkpoint's own id, epoch): a replayed epoch finds its
    commit and writes nothing, and a lost checkpoint replays under new names, where the ids decide.
    """
    run = f"{query}:{checkpoint.rstrip('/').rsplit('/', 1)[-1]}"

    def write(batch: DataFrame, epoch: int) -> None:
        append_ledger(batch, path, schema, query=run, epoch=epoch)

    return (
        signals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
