"""Flows over a stream of events: an extension, as all other inputs are finite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kind_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of event types per window of event time; events later than ``late`` are dropped, and state with them."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A row for each session of a user: its span and number of steps."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("steps"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "steps")
    )


def upsert_batches(apply: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink; ``apply`` must give the same result if a batch comes twice."""
    return lambda batch, _: apply(batch)
