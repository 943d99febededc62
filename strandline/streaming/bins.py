"""Streaming form of the impulse grid: events as they come, counted in tumbling windows with a watermark.

The study itself has no streams; this is an addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_impulses(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Count of events by key and window; events later than ``late`` are left out. Works on batch and stream frames alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("x")).select(*keys, F.col("window.start").alias("start"), "x")
