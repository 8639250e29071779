"""Streaming ingestion: a stream of (op, key, value, ...) rows is committed to a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keytide.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, source: str = "stream", ordinal: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Starts a query that commits every micro-batch once.

    The manifest keeps the last batch number of each source, so a batch that Spark sends again after a failure is
    recognised and changes nothing. Of equal keys in a batch the last by ``ordinal`` counts.
    """

    def commit(batch: DataFrame, number: int) -> None:
        columns = ["op", "key", "value"] + ([ordinal] if ordinal else [])
        store.write(batch.select(*columns), ordinal, batch=(source, number))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
