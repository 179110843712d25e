"""Structured Streaming forms of the event log: windows, sessions, idempotent consumption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sliding_counts(events: DataFrame, at: str, key: str, length: str, slide: str, late: str) -> DataFrame:
    """``key, start, end, n`` of sliding windows; rows later than ``late`` are left out."""
    w = F.window(at, length, slide)
    return events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """``key, start, end, n`` of sessions that a pause over ``gap`` ends."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def once(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key once, if its repeats come within ``late``."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def consume(outbox: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every batch of a stream to ``apply``, at least once and in order; ``apply`` must bear repetition."""
    return outbox.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
