"""Incremental ingestion as a stream: new files of a folder are parsed, chunked and synced, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tesserae.operators.chunking import chunk_records
from tesserae.operators.sync import ChunkStore


def stream_records(spark: SparkSession, folder: str, schema: str, store: ChunkStore, checkpoint: str, topic: str, to_records: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Syncs a topic with each batch of Parquet files: known chunks stay, as sources that a batch does not name are protected.

    A batch that is run again after a failure finds its chunks unchanged, so nothing is embedded twice.
    """

    def step(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        chunks = chunk_records(to_records(batch))
        old = store.chunks(topic)
        named = chunks.select("source").distinct()
        safe = [r["source"] for r in old.select("source").distinct().join(named, "source", "left_anti").collect()] if old is not None else []
        store.sync(topic, chunks, protected_sources=safe)

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_log(entries: DataFrame, folder: str) -> None:
    """One JSON line for each entry, after those that are there."""
    entries.withColumn("at", F.current_timestamp()).write.mode("append").json(folder)
