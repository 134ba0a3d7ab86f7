"""Structured Streaming over change logs.

A change log has a key, attributes, an operation (INSERT, UPDATE, DELETE), a time and a number that grows. Batches are
applied by the last change of each key, so that a batch that runs again gives the same layer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.merge import latest_changes, upsert


def applied(layer: DataFrame, changes: DataFrame, key: str, order: str = "n", operation: str = "operation") -> DataFrame:
    """The layer after a batch of changes."""
    attrs = [c for c in layer.columns if c != key]
    last = latest_changes(changes, key, order)
    put, gone = last.where(F.col(operation) != "DELETE").select(key, *attrs), last.where(F.col(operation) == "DELETE").select(key)
    return upsert(layer.join(gone, key, "left_anti"), put, key)


def follow(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, checkpoint: str, order: str = "n") -> StreamingQuery:
    """Applies each micro-batch: ``read`` gives the layer, ``write`` stores the next one under the batch's number."""

    def step(batch: DataFrame, number: int) -> None:
        write(applied(read(), batch, key, order), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted(stream: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Changes by window and kind; rows later than ``late`` are left out, and closed windows leave the state."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of changes of one key without a longer pause."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
