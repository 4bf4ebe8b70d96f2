"""Event-time windows over streams (an extension): tumbling, sliding and session windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sliding(events: DataFrame, at: str, size: str, slide: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
