"""Streams: an extension; the operators that look at one row at a time run on streams unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.plans import names
from tabloom.plans.names import col


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark, for which a stream's time needs a zone: the session's."""
    if not events.isStreaming:
        return events
    return events.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str, keys: Sequence[str] = (), window: str = "1 hour", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Rows, and the sum of a value, per key and tumbling window; rows later than the watermark allows are left out of streams."""
    names.require([time, *keys, *([value] if value else [])], events.columns)
    kind = events.schema[time].dataType
    rows = _marked(events, time, late).groupBy(F.window(col(time), window).alias("w"), *[col(k) for k in keys])
    out = rows.agg(F.count(F.lit(1)).alias("count"), *([F.sum(col(value)).alias(f"{value}_sum")] if value else []))
    return out.select(F.col("w.start").cast(kind).alias("window_start"), *[col(k) for k in keys], "count", *([f"{value}_sum"] if value else []))


def unique_within(events: DataFrame, time: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key that a stream sees; a key's state goes when the watermark passes it."""
    names.require([time, *keys], events.columns)
    return _marked(events, time, late).dropDuplicatesWithinWatermark(list(keys))
