"""Streaming extensions: windowed counts with late data, and streamed upserts. Batch tables take the same plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(df: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, kind, n, total) of fixed windows; `late` is how long a stream waits for late rows."""
    if late and df.isStreaming:
        df = df.withWatermark(at, late)
    out = df.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", F.round("total", 4).alias("total"))


def session_counts(df: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user, session_start, n): rows of a user with no gap longer than `gap`."""
    if late and df.isStreaming:
        df = df.withWatermark(at, late)
    out = df.groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("session_start"), "n")


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a stream that hands each micro-batch to `work`, such as an upsert; the checkpoint folder must be shared."""
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
