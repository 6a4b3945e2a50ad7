"""An extension beyond the operators above: event streams feed the space-time table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, late: str = "2 days", key: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """Sums for each key and day; on a stream, windows close once events are `late` behind."""
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    out = stamped.groupBy(F.window(ts, "1 day").alias("w"), key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select(key, F.to_date("w.start").alias("day"), "total", "n")


def moments(events: DataFrame, value: str = "value", by: str = "event_type") -> DataFrame:
    """Running count, mean and sample deviation for each group (complete mode on a stream)."""
    return events.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
