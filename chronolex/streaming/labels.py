"""The label log and event counts as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type by tumbling window; rows later than ``late`` are let go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def without_repeats(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Log entries, each once within the watermark."""
    return log.withWatermark("labelled_at", late).dropDuplicatesWithinWatermark(["annotator", "id", "label", "labelled_at"])


def running_labels(log: DataFrame) -> DataFrame:
    """The last label of each annotator and item so far; complete or update mode."""
    return log.groupBy("annotator", "id").agg(F.max_by("label", "labelled_at").alias("label"), F.max("labelled_at").alias("labelled_at"))
