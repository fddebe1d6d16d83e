"""Incremental ingest as a stream: page records arrive, chunks that are new are added to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.engine import Engine


def ingest(pages: DataFrame, engine: Engine, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the stream. A batch enters the store whole, by one commit that also names it: one that failed is run again
    as if it had never been, and one that was committed before the stream could note it is left out. The stream's name is its checkpoint."""

    def batch(rows: DataFrame, number: int) -> None:
        engine.ingest(rows, checkpoint, number)

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
