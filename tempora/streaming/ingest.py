"""Structured Streaming into a hypertable: each micro-batch is appended and its range logged as a change."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ingest(stream: DataFrame, table, checkpoint: str, caggs: tuple = (), refresh: bool = False):
    """Start a query that appends micro-batches; late rows are never dropped, the next refresh takes them in."""

    def write(batch: DataFrame, _: int) -> None:
        table.append(batch)
        if refresh:
            for c in caggs:
                c.refresh()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
