"""Structured Streaming forms of the keyed upsert and of the append with de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from taskmine.sources.store import KeyedStore


def upsert_stream(rows: DataFrame, store: KeyedStore, order: list[str], checkpoint: str) -> StreamingQuery:
    """Feed a stream into a keyed store: each micro-batch becomes one store batch.

    A micro-batch repeated after a failure overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, batch_id, order)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def first_seen(rows: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """Keep the first row per key, remembering a key until the watermark has passed it by.

    ``late`` bounds the state; it must cover the largest gap between repeats.
    """
    typed = rows.withColumn(event_time, rows[event_time].cast("timestamp"))
    return typed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def first_by_order(rows: DataFrame, store: KeyedStore, checkpoint: str) -> StreamingQuery:
    """Keep the first row per key by the store's own order, in whatever order rows arrive.

    Nothing is remembered between micro-batches but the store's files, so no watermark
    bounds how late a repeat may come, and memory is that of one micro-batch. A row that is
    ordered before the one kept so far takes its place.
    """
    if store.keep != "first" or store.order == ["batch"]:
        raise ValueError("the store must keep the first row by an order")
    return upsert_stream(rows, store, store.order, checkpoint)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet folder."""
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return writer.outputMode("append").trigger(availableNow=True).start()
