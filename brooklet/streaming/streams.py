"""Streams of items into the store, and streaming views of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..plans.store import Store


def ingest_stream(store: Store, items: DataFrame, checkpoint: str, now: float):
    """A query that remembers each micro-batch of a stream of items; batches that come again change nothing, as items are de-duplicated."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            store.remember_batch(rows, now)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(items: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Items of a stream whose (hash, namespace) hasn't come within the delay."""
    return items.withColumn("content_hash", content_hash(F.col("content"))).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash", "namespace"])


def daily_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", delay: str = "1 hour") -> DataFrame:
    """day, key, n: works on a stream (finished days are emitted once the watermark passes) and on a table alike."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), key, "n")


def active_working(items: DataFrame, ts: str = "ts", ttl: str = "24 hours", by: str = "namespace") -> DataFrame:
    """by, opened, closed, n: sessions of working items; one closes when nothing has come for the time to live."""
    return items.withWatermark(ts, ttl).groupBy(F.session_window(ts, ttl).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "n")
